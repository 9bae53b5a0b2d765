import random

import pytest

from loomfield.llm import docpairs
from loomfield.llm.gll import Parse

DOC = "Walks the queue from the newest entry backwards"


def names(code, lang="ts"):
    return [n for n, d, _ in docpairs.pairs(code, lang) if docpairs.earnest(d, n)]


@pytest.mark.parametrize(
    ("code", "lang", "want"),
    [
        (f"// {DOC}\nexport async function f(a: string): Foo[] {{\n}}", "ts", ["f"]),
        (f"/** {DOC} */\nexport const g = async (a: number) => {{", "ts", ["g"]),
        (f"/*\n * {DOC}\n */\nconst h = function (x) {{", "js", ["h"]),
        (f"class A {{\n  /** {DOC} */\n  static m(a, b) {{\n", "js", ["m"]),
        (f"/// {DOC}\n#[inline]\npub(crate) fn k(a: &str) -> usize {{", "rust", ["k"]),
        (f"// {DOC}\nfunc (r *T) Name(a string) (out string, err error) {{", "go", ["Name"]),
        (f"/** {DOC} */\n@Override\npublic static List<String> x(Map<String, Integer> a) throws E {{", "java", ["x"]),
        (f"/// <summary>\n/// {DOC}\n/// </summary>\n[Obsolete]\npublic string Y(int a) {{", "cs", ["Y"]),
        (f"// {DOC}\ninternal fun z(a: String): Int {{", "kt", ["z"]),
        (f"// {DOC}\nstatic bool w(const std::string& a, int b) {{", "cpp", ["w"]),
        (f"# {DOC}\n@cached(1)\nasync def p(a, b=None):\n    pass", "py", ["p"]),
        (f'def q(a):\n    """{DOC}"""\n', "py", ["q"]),
        (f"def q(\n    a,\n    b,\n) -> dict[str, int]:\n    '''\n    {DOC}\n", "py", ["q"]),
        (f"# {DOC}\ndef self.r(a, b = nil)\nend", "rb", ["r"]),
        ("// ハンドルの有効期限を確認\nfunction j() {", "js", ["j"]),
        (f"rest of a comment\n * {DOC}\n */\nfunction cut(a) {{", "ts", ["cut"]),
        (f"// {DOC}\r\nfunction crlf() {{\r\n}}", "ts", ["crlf"]),
        (f"// {DOC}\nint many(" + ", ".join(f"int a{n}" for n in range(300)) + ") {", "cpp", ["many"]),
        (f"// {DOC}\nfunction many({', '.join(f'a{n}' for n in range(300))}) {{", "js", ["many"]),
        (f"-- {DOC}\nlocal function M.open(a, b)\nend", "lua", ["open"]),
        (f"# {DOC}\nopen_all() {{\n  x\n}}", "sh", ["open_all"]),
        (f"# {DOC}\nfunction close_all {{\n}}", "bash", ["close_all"]),
        (f"# {DOC}\nsub fold {{\n}}", "perl", ["fold"]),
        (f"# {DOC}\nfold_all <- function(a, b = 2) {{\n}}", "r", ["fold_all"]),
        (f"# {DOC}\ndef fold(a, b) do\nend", "elixir", ["fold"]),
        (f"-- {DOC}\nCREATE FUNCTION fold(a int)\nRETURNS int", "sql", ["fold"]),
        (f"// {DOC}\nfunction f(a) {{", "unheard", ["f"]),
        # none
        (f"// {DOC}\nfunction f(a]) {{", "ts", []),
        (f"-- {DOC}\nlocal x = open(1)", "lua", []),
        (f"# {DOC}\nopen_all a b", "sh", []),
        (f"// {DOC}\n\nfunction f() {{", "ts", []),
        (f"// {DOC}\nconst x = call(1);\nfunction f() {{", "ts", []),
        (f"// {DOC}\nqueue.push(a, b)\nif (x) {{", "go", []),
        (f"// {DOC}\nqueue.push(a, b)", "go", []),
        (f"// {DOC}\nclass A {{", "ts", []),
        (f"// {DOC}\nif (a) {{", "ts", []),
        ("// Flush hidden digest.\nfunction flushHiddenDigest() {", "ts", []),
        ("// @param a the thing that should be read before it\nfunction f(a) {", "ts", []),
        ("// eslint-disable-next-line no-shadow and some more words\nfunction f(a) {", "ts", []),
        ('// const a = "x y z w";\n// queue.fold(scan(a), 56)\nfunction f(a) {', "ts", []),
        ("// ------------\nfunction f() {", "ts", []),
        ("/* region: helpers and other things */\nfunction f() {", "ts", []),
        ('def f():\n    x = """one two three four five"""\n', "py", []),
        ("def f():\n    pass", "py", []),
        ("", "ts", []),
        (f"// {DOC}", "ts", []),
        (f"// {DOC}\nfunction f() {{", "md", []),
    ],
)
def test_pairs(code, lang, want):
    assert names(code, lang) == want


def test_language_by_path_and_guess():
    assert [n for n, *_ in docpairs.pairs(f"# {DOC}\ndef f():\n", None, "a/b.py")] == ["f"]
    assert docpairs.pairs(f"# {DOC}\ndef f():\n", None, "a/b.md") == []
    assert [n for n, *_ in docpairs.pairs(f"# {DOC}\ndef f():\n", None, None)] == ["f"]


def test_gll_against_a_plain_recogniser():
    grammar = {"S": [("S", "S"), ('"a"',), ('"("', "S", '")"'), ()]}
    random.seed(2)

    def balanced(text):
        depth = 0
        for c in text:
            depth += (c == "(") - (c == ")")
            if depth < 0:
                return False
        return depth == 0

    for _ in range(200):
        text = "".join(random.choice("a()") for _ in range(random.randint(0, 9)))
        assert Parse(grammar, "S", text).ends == [n for n in range(len(text) + 1) if balanced(text[:n])]
    left = {"E": [("E", '"+"', "N"), ("N",)], "N": [('"n"',)]}
    assert Parse(left, "E", "n+n+n").ends == [1, 3, 5] and Parse(left, "E", "n+n").find("N") in ((0, 1), (2, 3))


def test_operator(spark):
    good = f"// {DOC}\nfunction f() {{\n  x();\n}}\nmore();"
    data = [(1, good, "ts", "a.ts", "own"), (2, None, "ts", "a", "own"), (3, "", None, None, "own"), (4, good + f"\n// {DOC}\nfunction f() {{}}", None, "b.ts", "own")]
    df = spark.createDataFrame(data, "hop_id long, code string, code_lang string, file_path string, func_name string")
    out = docpairs.documented(df, ["hop_id"], body=True)
    rows = sorted((r["hop_id"], r["func_name"], r["line_no"]) for r in out.collect())
    assert rows == [(1, "f", 2), (4, "f", 2), (4, "f", 7)]
    assert out.where("hop_id = 1").first()["func_text"] == "function f() {\n  x();\n}"
    assert docpairs.without_templates(out, 2).count() == 0 and docpairs.without_templates(out, 3).count() == 3
    assert docpairs.documented(df.limit(0), ["hop_id"]).count() == 0
