"""Generated, minified and vendored files, and data saved as code (problem 6).

Three kinds of evidence are put together: hashes of directory trees, computed bottom-up, of which equal ones in unrelated
repositories mark third-party copies; the names that tools and package managers give to files and folders; and what headers
and layout of a body tell.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomfield.session import checkpointed, spread

# Folders in which package managers and build tools keep what nobody wrote here. Whole segments only.
VENDORED_FOLDERS = "node_modules bower_components jspm_packages vendor vendors vendored third_party third-party thirdparty 3rdparty 3rd_party 3rd-party site-packages dist-packages pods carthage godeps __pypackages__ externals".split()
GENERATED_FOLDERS = "__generated__ generated gen autogenerated auto_generated auto-generated generated-sources generated-src generated_src generated-test-sources".split()
BUILT_FOLDERS = "dist".split()
# File names that generators give.
GENERATED_NAMES = (
    r"\.pb(?:\.\w+)?\.(?:go|cc|cpp|h|c|rb|ts|js|swift|dart|rs|py)$",
    r"_pb2?(?:_grpc)?\.(?:py|pyi|js|ts|rb)$",
    r"grpc\.(?:java|kt|cs|swift)$",
    r"\.(?:g|freezed|gr|mocks)\.dart$",
    r"\.designer\.(?:cs|vb)$",
    r"\.g(?:\.i)?\.cs$",
    r"\.tab\.(?:c|h|cc|hh|cpp|hpp)$|^lex\.\w+\.c$|\.yy\.(?:c|h|cc)$",
    r"^(?:moc|qrc|ui)_\w+\.(?:cpp|cc|h|hpp|moc)$",
    r"^zz_generated\.",
    r"\.(?:generated|autogenerated|autogen|auto|gen)\.\w+$",
    r"(?:_generated|_autogen|_gen)\.\w+$",
    r"\.gql\.\w+\.\w+$",
)
MINIFIED_NAMES = (
    r"[.-](?:min|packed|pack|ugly|uglified)\.(?:js|mjs|cjs|css)$",
    r"\.(?:bundle|chunk)(?:\.[0-9a-f]{6,})?\.(?:js|mjs|cjs|css)$",
    r"\.[0-9a-f]{8,}\.(?:js|mjs|cjs|css)$",
)
DATA_NAMES = (r"\.(?:data|wasm|base64|b64|bin|blob|asm)\.\w+$", r"_(?:font_data|bin|blob|binary|base64)\.(?:c|h|cc|cpp|js|ts|py|go|rs|java)$", r"_font_data\.\w+$")
VERSIONED_FOLDER = r"(?:^|/)[a-z@][\w.@-]*-v?\d+\.\d+(?:\.\d+)*(?:[-.+]\w+)*/"

# Header lines, in any comment style. Each needs the statement itself, not a mention of such files.
_MADE = r"(?:generated|produced|created|emitted|built|compiled|written|autogenerated|auto-generated|erzeugt|generiert|erstellt|généré|générée|generado|generada|gerado|gerada|generato|сгенерирован\w*|создан\w*)"
_HANDS_OFF = r"(?:do not (?:edit|modify|change|touch)|don't (?:edit|modify)|(?:edits?|changes|modifications)\b.{0,40}\b(?:overwritten|lost|discarded)|will be (?:overwritten|lost)|nicht (?:bearbeiten|ändern|editieren)|ne pas (?:modifier|éditer)|no (?:editar|modificar)|não (?:editar|modificar)|non modificare|не (?:редактировать|изменять)|to (?:refresh|regenerate|update|rebuild) it)"
GENERATED_HEADER = re.compile(
    rf"(?i)\A\W*(?:@generated\b|<auto-?generated\b|auto-?generated (?:file|code|by|from)|automatically generated by\b|code generated\b.*\bdo not edit|(?:this file (?:is|was|has been) )?(?:automatically |auto-?){_MADE} (?:by|from|with)\b|.*自動生成.*|.*自动生成.*|.*자동 ?생성.*)"
)
MADE = re.compile(rf"(?i)\b{_MADE}\b")
HANDS_OFF = re.compile(rf"(?i){_HANDS_OFF}")
VENDORED_HEADER = re.compile(
    r"(?i)\A\W*(?:.*\bthird[- ]party code\b.*\b(?:copied|taken|imported|from)\b|(?:imported|copied|taken|vendored) (?:unchanged|verbatim|unmodified|as is)?\s*from (?:the )?\S.*\b(?:version|v?\d+\.\d+)|upstream:\s*\S+.*(?:local copy|do not modify|keep in sync|v?\d+\.\d+)|[\w.@/ -]+\s+v?\d+\.\d+(?:\.\d+)*\s*\|\s*\(c\)|!\s*[\w.@/ -]+\s+v\d+\.\d+\.\d+\b)"
)
COMMENT = re.compile(r"\s*(?://+!?|#+!?|/\*+!?|\*+|--|;+|<!--|%+|\"{3}|'{3}|rem\b)\s*(.*)", re.I)
INSIDE = re.compile(r"\s*(.*)")
NUMBERS = re.compile(r"(?:0x[0-9a-fA-F]+|\d+(?:\.\d+)?|\\x[0-9a-fA-F]{2}|-)(?:[uUlLfF]*)[\s,;]*")
LITERAL = re.compile(r"[\"'`][A-Za-z0-9+/=\\_-]{120,}[\"'`]?")
TEXT_LINE = re.compile(r"\s*[\"'`]?[A-Za-z0-9+/=]{60,}[\"'`]?[\s,+;\\]*\Z")


def body_kind(code: str) -> str | None:
    """generated, vendored, minified or data, as a body tells; None for a body that looks written by hand."""
    if not code.strip():
        return None
    lines = code.split("\n")
    in_block = False
    for line in lines:  # as far as the head of comments and imports goes
        m = COMMENT.match(line) or (INSIDE.match(line) if in_block else None)
        in_block = "*/" not in line if in_block else "/*" in line and "*/" not in line.rpartition("/*")[2]
        if not m:
            if line.strip() and not line.lstrip().startswith(("*", "package ", "using ", "import ", "#")):
                break
            continue
        text = m[1]
        banner = "! " + text if line.lstrip().startswith("/*!") else text
        if GENERATED_HEADER.match(text) or (made := MADE.search(text)) and HANDS_OFF.search(text, made.end()):
            return "generated"
        if VENDORED_HEADER.match(banner):
            return "vendored"
    size = len(code)
    literal = sum(len(m.group()) for m in LITERAL.finditer(code)) + sum(len(x) for x in lines if TEXT_LINE.match(x))
    if literal > 0.6 * size:
        return "data"
    numbers = sum(len(x) for x in lines if len(x) > 20 and (n := sum(len(m.group()) for m in NUMBERS.finditer(x))) and n > 0.85 * len(x.strip()))
    if size > 200 and numbers > 0.6 * size:
        return "data"
    code_lines = [x for x in lines if x.strip() and not COMMENT.match(x)]
    dense = sum(len(x) for x in code_lines if is_dense(x))
    if dense and dense >= 0.6 * sum(map(len, code_lines)):
        return "minified"
    return None


def is_dense(line: str) -> bool:
    """A line with several statements, many signs and hardly a blank, as nobody writes it."""
    n = len(line)
    if n < 60:
        return False
    blanks, signs = line.count(" ") + line.count("\t"), sum(line.count(c) for c in "{}();,=&|!?:")
    return blanks < 0.12 * n and signs > 0.12 * n and sum(line.count(c) for c in ";{}") >= 4


def path_kind(path: Column) -> Column:
    """generated, vendored, minified or data, as names tell; null else. Null paths give null."""
    low = F.lower(path)
    name = F.substring_index(low, "/", -1)
    folder = lambda names: low.rlike("(?:^|/)(?:" + "|".join(map(re.escape, names)) + ")/")
    return (
        F.when(folder(VENDORED_FOLDERS) | low.rlike(VERSIONED_FOLDER), "vendored")
        .when(name.rlike("|".join(MINIFIED_NAMES)), "minified")
        .when(folder(BUILT_FOLDERS), "minified")
        .when(folder(GENERATED_FOLDERS) | name.rlike("|".join(GENERATED_NAMES)), "generated")
        .when(name.rlike("|".join(DATA_NAMES)), "data")
    )


def judged(bodies: DataFrame, path: str = "file_path", code: str = "code", keep: tuple[str, ...] = ()) -> DataFrame:
    """(path, keep, body_kind, hash_hi, hash_lo) of every row: what its body tells, and a 128-bit digest of the body without
    its white space at line ends. Null bodies give nulls."""
    schema = ", ".join(f"`{c}` {bodies.schema[c].dataType.simpleString()}" for c in (path, *keep))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import blake2b

        for batch in batches:
            kinds, his, los = [], [], []
            for text in batch["_code"].to_pylist():
                if text is None:
                    kinds.append(None), his.append(None), los.append(None)
                    continue
                kinds.append(body_kind(text))
                bare = "\n".join(x.rstrip() for x in text.strip().split("\n")).encode("utf-8", "surrogatepass")
                digest = blake2b(bare, digest_size=16).digest()
                his.append(int.from_bytes(digest[:8], "big", signed=True))
                los.append(int.from_bytes(digest[8:], "big", signed=True))
            own = batch.select([path, *keep])
            yield pa.RecordBatch.from_arrays([*own.columns, pa.array(kinds, pa.string()), pa.array(his, pa.int64()), pa.array(los, pa.int64())], names=[path, *keep, "body_kind", "hash_hi", "hash_lo"])

    given = spread(bodies.select(path, *keep, F.col(code).alias("_code")))
    return given.mapInArrow(run, f"{schema}, body_kind string, hash_hi bigint, hash_lo bigint")


def merkle(leaves: DataFrame, repository: str = "repository", path: str = "path", hi: str = "hash_hi", lo: str = "hash_lo", keep: tuple[str, ...] = ()) -> DataFrame:
    """(repository, keep, folder, depth, hash_hi, hash_lo, n_files) of every folder, from its files' hashes, bottom-up.

    ``path`` is relative to the repository; the repository itself is the folder ''. ``keep``: columns that are the same all over a
    repository. A folder's hash is the sum of the hashes of its (name, hash) entries, which does not depend on their order and is
    added up before the shuffle, so that a folder with a third of all files is not one task's work. One aggregation a level of
    depth, each over the folders of the level below and the files at its own, and each written once. Rows of null path or hash take no part; an
    empty table has no folder.
    """
    wide = "decimal(38,0)"
    above = lambda c: F.when(F.instr(c, "/") > 0, F.expr(f"substring({c}, 1, length({c}) - length(substring_index({c}, '/', -1)) - 1)")).otherwise("")
    files = leaves.where(F.col(path).isNotNull() & F.col(hi).isNotNull() & F.col(repository).isNotNull())
    files = files.select(F.col(repository).alias("repository"), *keep, F.size(F.split(path, "/")).alias("_depth"), above(path).alias("_folder"), F.substring_index(path, "/", -1).alias("_name"), F.col(hi).alias("_hi"), F.col(lo).alias("_lo"), F.lit(1).cast("bigint").alias("_n"))
    files = checkpointed(files)  # read once a level
    depths = sorted((r[0] for r in files.select("_depth").distinct().collect()), reverse=True)  # a row a level
    deepest = depths[0] if depths else 0
    levels: list[DataFrame] = []
    below: DataFrame | None = None
    for depth in range(deepest, 0, -1):
        entries = files.where(F.col("_depth") == depth).drop("_depth") if depth in depths else None
        if below is not None:
            up = below.select("repository", *keep, above("folder").alias("_folder"), F.concat(F.substring_index("folder", "/", -1), F.lit("/")).alias("_name"), F.col("hash_hi").alias("_hi"), F.col("hash_lo").alias("_lo"), F.col("n_files").alias("_n"))
            entries = up if entries is None else entries.unionByName(up)
        hashed = [F.xxhash64(F.lit(seed), "_name", "_hi", "_lo").cast(wide) for seed in (1, 2)]
        sums = entries.groupBy("repository", *keep, "_folder").agg(F.sum(hashed[0]).alias("_a"), F.sum(hashed[1]).alias("_b"), F.sum("_n").alias("n_files"))
        below = checkpointed(sums.select("repository", *keep, F.col("_folder").alias("folder"), F.lit(depth - 1).alias("depth"), F.xxhash64(F.lit(3), "_a", "_b", "n_files").alias("hash_hi"), F.xxhash64(F.lit(4), "_a", "_b", "n_files").alias("hash_lo"), "n_files"))
        levels.append(below)
    if not levels:
        return files.select("repository", *keep, F.lit("").alias("folder"), F.lit(0).alias("depth"), F.col("_hi").alias("hash_hi"), F.col("_lo").alias("hash_lo"), F.col("_n").alias("n_files"))
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out


#: A shared folder tells something if it has at least so many files: one small file may be alike by chance.
LEAST_FILES = 2


def shared_folders(folders: DataFrame, owners: str = "owner", roots: str = "root", least_files: int = LEAST_FILES) -> DataFrame:
    """(repository, folder) of folders below the root that occur in unrelated repositories: ones of neither the same owner nor the same root.

    ``folders``: repository, folder, hash_hi, hash_lo, n_files, owner, root. A hash that has two owners and two roots has two repositories that
    differ in both. An unknown (null) owner is like no other, so it proves nothing.
    """
    below = folders.where((F.col("folder") != "") & (F.col("n_files") >= least_files))
    ends = [f(c).alias(f"_{f.__name__}_{n}") for n, c in enumerate((owners, roots)) for f in (F.min, F.max)]
    by = below.where(F.col(owners).isNotNull()).groupBy("hash_hi", "hash_lo").agg(*ends)
    often = by.where("_min_0 <> _max_0 and _min_1 <> _max_1").select("hash_hi", "hash_lo")
    return below.join(often, ["hash_hi", "hash_lo"], "left_semi").select("repository", "folder")


#: Path segments that make up a repository's root.
ROOT_SEGMENTS = 2


def origins(paths: DataFrame, bodies: DataFrame, path: str = "file_path", code: str = "code", owner: str = "workspace_id", least_files: int = LEAST_FILES, rules: bool = True) -> DataFrame:
    """(path, origin, told_by) of each distinct path of either table: generated, vendored, minified, data or hand-written.

    ``paths`` and ``bodies`` hold the path, ``bodies`` the code and the owner too. Null paths are no files; a null body
    leaves the path's evidence. Where bodies of one path disagree, any that is not hand-written counts. ``told_by`` is
    tree, path or body, in this order; without ``rules`` only trees tell. Repositories, an owner's copy of a root, are unrelated if neither root nor owner is the same.
    """
    seen = paths.select(path).unionByName(bodies.select(path)).where(F.col(path).isNotNull()).distinct()
    read = checkpointed(judged(bodies.where(F.col(path).isNotNull()), path, code, (owner,)))  # paths and hashes only
    parts = F.split(F.col(path), "/")
    root = F.array_join(F.slice(parts, 1, ROOT_SEGMENTS), "/")
    deep = F.size(parts) > ROOT_SEGMENTS
    leaves = read.where(F.col("hash_hi").isNotNull() & deep)
    leaves = leaves.select(F.concat_ws(" ", F.coalesce(owner, F.lit("")), root).alias("repository"), F.col(owner).alias("owner"), root.alias("root"), F.array_join(F.slice(parts, ROOT_SEGMENTS + 1, F.size(parts)), "/").alias("path"), F.col(path).alias("_full"), "hash_hi", "hash_lo").distinct()
    shared = shared_folders(merkle(leaves, keep=("owner", "root")), least_files=least_files)
    # each file with the folders above it; shared folders are few beside files
    above = leaves.select("repository", "_full", F.explode(F.expr("transform(sequence(1, greatest(size(split(path, '/')) - 1, 1)), i -> array_join(slice(split(path, '/'), 1, i), '/'))")).alias("folder"))
    copied = above.join(shared, ["repository", "folder"], "left_semi").select(F.col("_full").alias(path), F.lit(True).alias("_copied")).distinct()
    told = read.groupBy(path).agg(F.max("body_kind").alias("_body"))
    out = seen.join(told, path, "left").join(copied, path, "left").withColumn("_path", path_kind(F.col(path)))
    if not rules:
        out = out.withColumns({c: F.lit(None).cast("string") for c in ("_path", "_body")})
    kind = F.when(F.col("_copied"), "vendored").otherwise(F.coalesce("_path", "_body", F.lit("hand-written")))
    by = F.when(F.col("_copied"), "tree").when(F.col("_path").isNotNull(), "path").when(F.col("_body").isNotNull(), "body")
    return out.select(path, kind.alias("origin"), by.alias("told_by"))
