"""SQL for lexed source text, as the checks of queries over symbols and comments need it.

Made apart from the operators: marks are put around comments and literals by one pass of a regular expression, the state at each line's
beginning is a running count of marks, declarations are patterns over what is left, and ends come from running counts of brackets.
"""

from __future__ import annotations

from loomfield.functions import paths


def language_case(path: str) -> str:
    ext = rf"lower(regexp_extract({path}, '[^/]\.([A-Za-z0-9]+)$', 1))"
    return "CASE " + ext + " " + " ".join(f"WHEN '{e}' THEN '{n}'" for e, n in paths.LANGUAGES.items()) + " END"


# literals and comments by kind of language, as RE2 reads them from left to right
_QUOTES = r""""(?:[^"\\\n]|\\.)*"?|''(?:[^''\\\n]|\\.)*''?"""
_SLASH = rf"(?s)({_QUOTES}|`(?:[^`\\]|\\.)*`?)|(//[^\n]*|/\*.*?(?:\*/|\z))"
_RUST = r"""(?s)("(?:[^"\\]|\\.)*"?|''(?:\\[^'']+|[^''\\\n])'')|(//[^\n]*|/\*.*?(?:\*/|\z))"""
_HASH = r"""(?s)("{3}.*?(?:"{3}|\z)|''{3}.*?(?:''{3}|\z)|""" + _QUOTES + r")|(#[^\n]*)"
_MARKS = r"'\x03\1\x04\x01\2\x02'".replace("\\x03", "' || chr(3) || '").replace("\\x04", "' || chr(4) || '").replace("\\x01", "' || chr(1) || '").replace("\\x02", "' || chr(2) || '")


def lexed(files: str) -> str:
    """CTEs from ``files`` (path, lang, content): lx (path, lang, line, raw, bare), comments as a blank and literals as [s]."""

    def marked(pattern: str) -> str:
        return f"regexp_replace(content, '{pattern}', {_MARKS}, 'g')"

    return rf"""
src AS (SELECT path, lang, replace(replace(content, chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS content FROM {files}),
mk AS (SELECT path, lang, content, replace(replace(CASE WHEN lang IN ('python', 'ruby') THEN {marked(_HASH)} WHEN lang = 'rust' THEN {marked(_RUST)} ELSE {marked(_SLASH)} END,
  chr(1) || chr(2), ''), chr(3) || chr(4), '') AS m FROM src),
ml AS (SELECT path, lang, unnest(range(1, len(string_split(m, chr(10))) + 1)) AS line, unnest(string_split(m, chr(10))) AS m, unnest(string_split(content, chr(10))) AS raw FROM mk),
st AS (SELECT *, coalesce(sum(len(string_split(m, chr(1))) - len(string_split(m, chr(2)))) OVER w, 0) AS c, coalesce(sum(len(string_split(m, chr(3))) - len(string_split(m, chr(4)))) OVER w, 0) AS q
  FROM ml WINDOW w AS (PARTITION BY path ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
pre AS (SELECT path, lang, line, raw, CASE WHEN c > 0 THEN chr(1) || m WHEN q > 0 AND strpos(m, chr(4)) > 0 THEN 's]' || substr(m, strpos(m, chr(4)) + 1) WHEN q > 0 THEN left('s', length(m)) ELSE m END AS m FROM st),
lx AS (SELECT path, lang, line, raw, regexp_replace(regexp_replace(regexp_replace(regexp_replace(m, chr(1) || '[^' || chr(2) || ']*(' || chr(2) || '|$)', ' ', 'g'), chr(3) || '[^' || chr(4) || ']' || chr(4), 's', 'g'),
  chr(3) || '[^' || chr(4) || ']+' || chr(4), '[s]', 'g'), chr(3) || '.*$', '[s') AS bare FROM pre)"""


_M = r"(?:(?:export|default|abstract|async|static|public|private|protected|internal|final|sealed|partial|override|virtual|readonly|data|suspend|inline|open|constexpr|extern|unsafe|declare|pub(?:\([^)]*\))?)\s+)*"
_T = r"(?:[\w:]+(?:\s*<.*>)?(?:\[\])*[\s&*]+)+"
_ANY = "('typescript', 'typescriptreact', 'javascript', 'javascriptreact')"
#: (languages, pattern whose first group is the name, kind, what has to hold): the first that matches a line counts.
_HEADS = (
    ("('rust')", r"^\s*impl(?:<[^>]*>)?\s+(?:.*\sfor\s+)?(\w+)", "scope", "true"),
    (_ANY + " OR lang IN ('python', 'java', 'kotlin', 'csharp', 'cpp', 'c', 'ruby', 'php')", rf"^\s*{_M}class\s+(\w+)\s*(?:$|[{{:<(;]|extends\b|implements\b|final\b)", "class", "true"),
    ("('csharp', 'cpp', 'c', 'rust')", rf"^\s*{_M}(?:struct|union)\s+(\w+)\s*(?:$|[{{:<(;])", "class", "true"),
    ("('rust')", rf"^\s*{_M}trait\s+(\w+)", "interface", "true"),
    ("('java', 'csharp')", rf"^\s*{_M}record\s+(\w+)\s*[(<]", "class", "true"),
    ("('kotlin')", rf"^\s*{_M}object\s+(\w+)\s*(?:$|[{{:])", "class", "true"),
    ("('ruby', 'csharp', 'cpp')", r"^\s*(?:module|namespace)\s+(\w+)", "class", "true"),
    (_ANY + " OR lang IN ('java', 'kotlin', 'csharp', 'php')", rf"^\s*{_M}interface\s+(\w+)\s*(?:$|[{{:<]|extends\b)", "interface", "true"),
    (_ANY + " OR lang IN ('java', 'kotlin', 'csharp', 'cpp', 'c', 'rust', 'php')", rf"^\s*{_M}enum\s+(?:class\s+)?(\w+)\s*(?:$|[{{:<])", "enum", "true"),
    (_ANY + " OR lang IN ('rust')", rf"^\s*{_M}type\s+(\w+)\s*[=<]", "type", "true"),
    ("('go')", r"^\s*type\s+(\w+)\s+struct\b", "class", "true"),
    ("('go')", r"^\s*type\s+(\w+)\s+interface\b", "interface", "true"),
    ("('go')", r"^\s*func\s+\([^)]*\)\s*(\w+)\s*[(\[<]", "method", "true"),
    ("('go')", r"^\s*func\s+(\w+)\s*[(\[<]", "function", "true"),
    (_ANY + " OR lang IN ('php')", rf"^\s*{_M}function\s*\*?\s*([A-Za-z_$][\w$]*)\s*[(<]", "function", "true"),
    ("('python')", r"^\s*(?:async\s+)?def\s+(\w+)\s*[(\[]", "function", "true"),
    ("('ruby')", r"^\s*def\s+(?:self\.)?(\w+[?!]?)", "function", "true"),
    ("('rust')", rf"^\s*{_M}(?:const\s+)?fn\s+(\w+)\s*[(<]", "function", "true"),
    ("('kotlin')", rf"^\s*{_M}fun\s+(?:<[^>]*>\s*)?(\w+)\s*[(<]", "function", "true"),
    (_ANY, r"^\s*(?:export\s+)?(?:const|let|var)\s+([A-Za-z_$][\w$]*)[^=]*=\s*(?:(?:async\s+)?function\b|.*=>)", "function", "true"),
    (_ANY + " OR lang IN ('go', 'rust')", r"^(?:export\s+|pub\s+)?const\s+([A-Za-z_$][\w$]*)\s*(?:=|:|\w+\s*=)", "const", "top"),
    ("('kotlin')", r"^(?:private\s+|internal\s+)?(?:const\s+)?val\s+(\w+)\s*[=:]", "const", "top"),
    (_ANY, r"^(?:export\s+)?let\s+([A-Za-z_$][\w$]*)\s*[=:]", "let", "top"),
    (_ANY + " OR lang IN ('go', 'kotlin')", r"^(?:export\s+)?var\s+([A-Za-z_$][\w$]*)\s*(?:=|:|\w+\s*=)", "var", "top"),
    ("('java', 'csharp', 'cpp', 'c')", rf"^\s*{_M}(?:const\s+)?{_T}(?:\w+::)?~?(\w+)\s*\([^=]*(?:$|\)\s*(?:const\s*|override\s*|noexcept\s*|throws\s.*)*\{{)", "function", r"NOT regexp_matches(bare, '^\s*(return|new|throw|else|await|yield|delete|case|goto|using|import|package)\b')"),
    (_ANY + " OR lang IN ('java', 'csharp', 'cpp')", rf"^\s*{_M}~?([A-Za-z_$][\w$]*)\s*\(.*\{{", "method", r"inside AND NOT regexp_matches(bare, '^\s*(if|for|while|switch|catch|return|with|do|else|foreach|using)\b')"),
)


def symbols(files: str) -> str:
    """CTEs on top of ``lexed``: sym (path, lang, line, raw, name, kind, end_line, enclosing, position) of each declaration."""

    def pick(of: str, inside: bool) -> str:
        out = []
        for langs, pattern, kind, needs in _HEADS:
            if needs.startswith("inside") and not inside:
                continue
            value = f"regexp_extract(bare, '{pattern}', 1)" if of == "name" else f"'{kind}'"
            out.append(f"WHEN (lang IN {langs}) AND ({needs}) AND regexp_matches(bare, '{pattern}') THEN {value}")
        return "CASE " + "\n  ".join(out) + " END"

    ends = """CASE WHEN lang = 'python' THEN (SELECT max(x.line) FROM dp x WHERE x.path = h.path AND x.line >= h.line AND x.filled AND x.line < coalesce(
    (SELECT min(y.line) FROM dp y WHERE y.path = h.path AND y.line > h.line AND y.filled AND y.before <= h.before AND y.indent <= h.indent), 1000000000))
  WHEN lang = 'ruby' THEN CASE WHEN regexp_matches(bare, '\\bend\\s*$') THEN line ELSE coalesce((SELECT min(CASE WHEN regexp_matches(y.bare, '^\\s*end\\b') THEN y.line ELSE y.line - 1 END) FROM dp y WHERE y.path = h.path AND y.filled AND y.indent <= h.indent
    AND y.line = (SELECT min(z.line) FROM dp z WHERE z.path = h.path AND z.line > h.line AND z.filled AND z.indent <= h.indent)), (SELECT max(z.line) FROM dp z WHERE z.path = h.path)) END
  ELSE coalesce((SELECT min(y.line) FROM dp y WHERE y.path = h.path AND y.line >= h.line AND y.depth <= h.before AND (NOT y.opens_next OR y.line >= coalesce((SELECT min(z.line) FROM dp z WHERE z.path = h.path AND z.line >= h.line AND z.has_brace), 1000000000))),
    (SELECT max(z.line) FROM dp z WHERE z.path = h.path)) END"""
    return rf"""{lexed(files)},
br AS (SELECT *, length(regexp_replace(bare, '[^(\[{{]', '', 'g')) - length(regexp_replace(bare, '[^)\]}}]', '', 'g')) AS d, length(regexp_replace(bare, '[^(\[]', '', 'g')) - length(regexp_replace(bare, '[^)\]]', '', 'g')) AS p,
  trim(bare) <> '' AS filled, strpos(bare, '{{') > 0 AS has_brace, length(bare) - length(ltrim(bare, ' ' || chr(9))) AS indent FROM lx),
dp0 AS (SELECT *, sum(d) OVER w AS depth, sum(p) OVER w AS parens, first_value(CASE WHEN filled THEN bare END IGNORE NULLS) OVER (PARTITION BY path ORDER BY line ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt FROM br
  WINDOW w AS (PARTITION BY path ORDER BY line ROWS UNBOUNDED PRECEDING)),
dp AS (SELECT *, depth - d AS before, coalesce(starts_with(ltrim(nxt), '{{'), false) AS opens_next,
  parens - p - least(0, coalesce(min(parens) OVER (PARTITION BY path ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS open_parens FROM dp0),
hd0 AS (SELECT h.*, before = 0 AND NOT starts_with(bare, ' ') AND NOT starts_with(bare, chr(9)) AS top FROM dp h WHERE open_parens <= 0 AND filled),
hd AS (SELECT *, {pick("name", False)} AS name, {pick("kind", False)} AS kind FROM hd0),
sp0 AS MATERIALIZED (SELECT h.*, {ends} AS end_line FROM hd h WHERE name IS NOT NULL),
hi AS (SELECT h.*, EXISTS (SELECT 1 FROM sp0 t WHERE t.path = h.path AND t.kind IN ('class', 'interface', 'enum', 'scope') AND t.line < h.line AND h.line < t.end_line AND h.before = t.before + 1) AS inside FROM hd0 h),
hk AS (SELECT *, {pick("name", True)} AS name, {pick("kind", True)} AS kind FROM hi),
sp AS MATERIALIZED (SELECT h.*, {ends} AS end_line FROM hk h WHERE name IS NOT NULL),
en AS (SELECT s.*, (SELECT arg_max(t.name, t.line) FROM sp t WHERE t.path = s.path AND t.line < s.line AND s.line <= t.end_line AND NOT (t.lang NOT IN ('python', 'ruby') AND s.line = t.end_line)) AS enclosing,
  (SELECT arg_max(t.kind, t.line) FROM sp t WHERE t.path = s.path AND t.line < s.line AND s.line <= t.end_line AND NOT (t.lang NOT IN ('python', 'ruby') AND s.line = t.end_line)) AS around FROM sp s),
sym AS (SELECT path, lang, line, trim(raw, ' ' || chr(9)) AS signature, name, CASE WHEN kind = 'function' AND lang <> 'go' AND around IN ('class', 'interface', 'enum', 'scope') AND NOT regexp_matches(bare, '^\s*(namespace)\b')
    AND coalesce((SELECT NOT regexp_matches(t.bare, '^\s*namespace\b') FROM sp t WHERE t.path = en.path AND t.name = en.enclosing AND t.line < en.line ORDER BY t.line DESC LIMIT 1), true)
    AND NOT regexp_matches(bare, '^\s*(export\s+)?(const|let|var)\b') THEN 'method' ELSE kind END AS kind, end_line, enclosing,
  CAST(row_number() OVER (PARTITION BY path ORDER BY line) - 1 AS BIGINT) AS position FROM en WHERE kind <> 'scope' AND NOT (top IS NULL) AND NOT (kind IN ('const', 'let', 'var') AND enclosing IS NOT NULL))"""


#: The windows of hop1_context as files, as ``search_queries.windows`` has them.
WINDOWS = f"(SELECT file_path || '@' || hop_id AS path, coalesce({language_case('file_path')}, 'default') AS lang, code AS content FROM hop1_context WHERE code IS NOT NULL)"
SYMBOLS = symbols(WINDOWS)


def parts(name: str) -> str:
    """The parts of a compound name, in small letters."""
    return rf"list_transform(list_filter(string_split_regex(regexp_replace(regexp_replace({name}, '([A-Z])([A-Z][a-z])', '\1 \2', 'g'), '([a-z0-9])([A-Z])', '\1 \2', 'g'), '[_\-\s.]+'), lambda x: x <> ''), lambda x: lower(x))"


IS_TEST = r"regexp_matches({path}, '(^|/)(tests?|__tests__|spec|__spec__)(/|$)|\.test\.|\.spec\.')"
IS_NOISE = "regexp_matches({path}, 'node_modules/|dist/|cache/|bench/fixtures/')"


def comments(files: str) -> str:
    """CTEs from ``files`` (path, lang, content): cm (path, lang, line, raw, m), lines with marks around comments (1, 2), literals (3, 4) and
    documentation strings (5, 6), opened anew on each line that they go on to."""
    m = _MARKS
    marked = lambda p: f"regexp_replace(content, '{p}', {m}, 'g')"
    doc = "regexp_replace({x}, '(?m)^([ \\t]*)' || chr(3) || '((?:\"{{3}}|''{{3}})[^' || chr(4) || ']*)' || chr(4), '\\1' || chr(5) || '\\2' || chr(6), 'g')"
    clean = lambda x: f"replace(replace({x}, chr(1) || chr(2), ''), chr(3) || chr(4), '')"
    opened = lambda a, b: f"sum(len(string_split(m, chr({a}))) - len(string_split(m, chr({b})))) OVER w"
    return rf"""
mk AS (SELECT path, lang, content, CASE WHEN lang IN ('python', 'ruby') THEN {doc.format(x=clean(marked(_HASH)))} WHEN lang = 'rust' THEN {clean(marked(_RUST))} ELSE {clean(marked(_SLASH))} END AS m FROM {files}),
ml AS (SELECT path, lang, unnest(range(1, len(string_split(m, chr(10))) + 1)) AS line, unnest(string_split(m, chr(10))) AS m, unnest(string_split(content, chr(10))) AS raw FROM mk),
st AS (SELECT *, {opened(1, 2)} AS c, {opened(3, 4)} AS q, {opened(5, 6)} AS d FROM ml WINDOW w AS (PARTITION BY path ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
cm AS (SELECT path, lang, line, raw, CASE WHEN c > 0 THEN chr(1) WHEN q > 0 THEN chr(3) WHEN d > 0 THEN chr(5) ELSE '' END || m AS m FROM st)"""


#: Windows by id, with the language of their path alone.
HOPS = f"(SELECT hop_id AS path, coalesce({language_case('file_path')}, '') AS lang, code AS content FROM hop1_context WHERE code IS NOT NULL)"
COMMENTS = comments(HOPS)
#: A line of ``cm`` with comments and documentation as a blank.
BARE = "replace(replace(regexp_replace(regexp_replace(m, chr(1) || '[^' || chr(2) || ']*(' || chr(2) || '|$)', ' ', 'g'), chr(5) || '[^' || chr(6) || ']*(' || chr(6) || '|$)', ' ', 'g'), chr(3), ''), chr(4), '')"
