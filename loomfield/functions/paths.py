"""What a path tells: language, role, scope."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Languages by file extension.
LANGUAGES = dict(
    ts="typescript", tsx="typescriptreact", mts="typescript", cts="typescript", js="javascript", jsx="javascriptreact", mjs="javascript", cjs="javascript",
    py="python", pyi="python", go="go", rs="rust", java="java", kt="kotlin", kts="kotlin", cs="csharp", c="c", h="c",
    cpp="cpp", cc="cpp", cxx="cpp", hpp="cpp", hh="cpp", hxx="cpp", php="php", rb="ruby", html="html", htm="html", jsp="jsp", vue="vue",
)
#: Words with which C++ declares what C has not, and the mark of its scopes; in C they are at most names of values.
CPP_WORDS = ("class", "namespace", "template", "typename", "constexpr", "nullptr", "virtual", "public", "private", "protected")
CPP_HEADER = "::|" + "|".join(rf"(?<![\w\"]){w}(?=\s*[<:{{]|\s+\w)" for w in CPP_WORDS)


def extension(path: Column) -> Column:
    """The lower-cased extension of the file's name; '' without one."""
    return F.lower(F.regexp_extract(path, r"[^/]\.([A-Za-z0-9]+)\z", 1))


def language(path: Column, text: Column | None = None) -> Column:
    """The language by extension; a .h file is C++ if its beginning looks so. Null for other files."""
    table = F.create_map([F.lit(x) for x in chain(*LANGUAGES.items())])
    plain = F.try_element_at(table, extension(path))
    if text is None:
        return plain
    return F.when((extension(path) == "h") & F.substring(text, 1, 8192).rlike(CPP_HEADER), "cpp").otherwise(plain)


def under(path: Column, scope: str) -> Column:
    """The scope itself or anything below it; an empty scope holds everything."""
    scope = scope.strip("/")
    return (path == scope) | path.startswith(scope + "/") if scope else F.lit(True)


def is_test(path: Column) -> Column:
    return path.rlike(r"(?:^|/)(?:tests?|__tests__|spec|__spec__)(?:/|\z)|\.test\.|\.spec\.")


def is_noise(path: Column) -> Column:
    """Installed packages, build output, caches and bench fixtures, by parts of the path."""
    return path.rlike(r"node_modules/|dist/|cache/|bench/fixtures/")


def is_build_output(path: Column) -> Column:
    """A folder above the file is one that builds write to; the file's own name doesn't count."""
    return path.rlike(r"(?:^|/)(?:dist|build|out|coverage|\.next|target)/")


def is_markdown(path: Column) -> Column:
    return F.lower(path).rlike(r"\.(?:md|mdx|markdown)\z")


# What tells a kind of surface, in the order in which kinds are tried. folder: a folder of that name above the file;
# top: the first folder; begins: a folder or file below the top whose name begins so; part: what the path holds anywhere; word: a
# word that a folder's or file's name begins, standing after no letter; name: what the file's name is or begins with before a dot, dash or
# underscore; ends: what it ends with.
SURFACES = (
    ("contract", {"begins": ("schema", "openapi"), "folder": ("shared", "types", "proto"), "stem": ("enums",), "ends": (".proto",)}),
    ("test", {"folder": ("__tests__", "test", "tests"), "kinds": ("spec", "test"), "begin_word": ("test",)}),
    ("domain", {"folder": ("control", "mode", "failsafe", "algorithm", "solver", "filter"), "top": ("src",), "in_name": ("transition", "state-machine", "statemachine", "lifecycle")}),
    ("api", {"folder": ("protocol", "transport"), "top": ("src",)}),
    ("config", {"folder": ("driver", "hal", "platform", "rtos", "bsp")}),
    ("contract", {"any_folder": ("inc", "include")}),
    ("doc", {"ends": (".md",), "not_top": ("docs", "proto")}),
    ("style", {"ends": (".css", ".scss", ".less"), "begins": ("theme",)}),
    ("ui", {"ends": (".tsx", ".jsx", ".vue", ".svelte"), "begins": ("component", "page"), "folder": ("web",)}),
    ("config", {"names": ("package.json", "dockerfile", "makefile"), "named": (("tsconfig", ".json"),), "config_of": ("js", "ts", "mjs", "cjs", "json"), "folder": ("config",)}),
    ("data", {"last_word": ("migration", "migrations", "seed", "seeds", "fixture", "fixtures"), "ends": (".sql",)}),
    ("api", {"begins": ("service", "controller", "route", "handler", "validator", "middleware"), "folder": ("repository", "repositories"), "begins_name": ("repository", "repositories"), "part_name": ("reporter", "publisher", "sender", "receiver")}),
    ("domain", {"folder": ("domain", "model", "models", "usecase", "usecases"), "last_word": ("engine", "calculator", "pricing", "rating")}),
)


def _either(words: tuple[str, ...]) -> str:
    return "(?:" + "|".join(w.replace(".", r"\.") for w in words) + ")"


def surface_pattern(rule: dict[str, tuple]) -> str:
    """One regular expression, on lower-cased paths, for a rule of ``SURFACES``; ``not_top`` aside."""
    made = {
        "folder": lambda w: f"/{_either(w)}/",
        "any_folder": lambda w: f"(?:^|/){_either(w)}/",
        "begins": lambda w: f"/{_either(w)}",
        "stem": lambda w: rf"/{_either(w)}\.",
        "ends": lambda w: f"{_either(w)}$",
        "kinds": lambda w: rf"\.{_either(w)}\.[a-z]+$",
        "begin_word": lambda w: rf"\b{_either(w)}",
        "in_name": lambda w: f"{_either(w)}[^/]*$",
        "names": lambda w: f"(?:^|/){_either(w)}$",
        "named": lambda w: "|".join(rf"(?:^|/){a}[^/]*{b}$".replace(".json", r"\.json") for a, b in w),
        "config_of": lambda w: rf"\.config\.{_either(w)}$",
        "last_word": lambda w: f"(?:^|[^a-z]){_either(w)}(?:[^a-z/][^/]*)?(?:/[^/]*)?$",
        "begins_name": lambda w: f"{_either(w)}[._-][^/]*$",
        "part_name": lambda w: f"{_either(w)}[._-][^/]*$",
    }
    parts = [made[k](w) for k, w in rule.items() if k in made]
    if "top" in rule:  # the folders of the rule count right below these too
        parts.append(f"^{_either(rule['top'])}/{_either(rule['folder'])}/")
    return "|".join(parts)


def surface(path: Column) -> Column:
    """The kind of surface a path belongs to; unknown where no rule holds, as for a null path."""
    low = F.lower(path)
    out = F.when(path.isNull(), "unknown")
    for name, rule in SURFACES:
        hit = low.rlike(surface_pattern(rule))
        if "not_top" in rule:
            hit = hit & ~low.rlike(f"^{_either(rule['not_top'])}/")
        out = out.when(hit, name)
    return out.otherwise("unknown")


def looks_like_comment(line: Column, lang: Column) -> Column:
    """A line that begins as a comment does in its language, or as one inside a block does."""
    bare = F.ltrim(line)
    block = bare.rlike(r"^(?:/\*|\*/|\* )") | (bare == "*")
    own = F.when(lang.isin("python", "ruby"), bare.startswith("#")).when(lang.isin("typescript", "typescriptreact", "javascript", "javascriptreact", "java", "kotlin", "go", "rust", "c", "cpp", "csharp", "php"), bare.startswith("//"))
    return F.coalesce(own, F.lit(False)) | block
