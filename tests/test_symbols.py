"""Declarations against planted ones, language by language, and over long, broken and empty texts."""

import pytest

from loomfield.functions import paths
from loomfield.operators import symbols

CASES = {
    "cpp": (
        "\nclass Gear {\npublic:\n    Gear();\n    ~Gear();\n    void request(int id);\n};\nenum class Mode {\n  Manual,\n};\nnamespace a {\nvoid A::run(int x) {\n  if (x) { go(x); }\n}\nint f(int a,\n      int b)\n{\n  return a;\n}\n}\nauto lease = attach(dialect, 1);\n",
        [("Gear", "class", 2, 7, None), ("Gear", "method", 4, 4, "Gear"), ("Gear", "method", 5, 5, "Gear"), ("request", "method", 6, 6, "Gear"), ("Mode", "enum", 8, 10, None), ("a", "class", 11, 20, None), ("run", "method", 12, 14, "a"), ("f", "function", 15, 19, "a")],
    ),
    "typescript": (
        "export class A<T> extends B {\n  x() {}\n  private async y(a: string): Promise<void> {\n    const z = `\n}`;\n    return foo(z);\n  }\n}\nexport const b = 1;\nconst f = async (x) => {\n};\nfunction c(x) {\n  if (x) {\n  }\n}\nexport type T = string | 'a{';\nexport default interface I { m(): void; }\nlet q = { a: 1 };\nenum E { A }\n// function no() {}\n",
        [("A", "class", 1, 8, None), ("x", "method", 2, 2, "A"), ("y", "method", 3, 7, "A"), ("b", "const", 9, 9, None), ("f", "function", 10, 11, None), ("c", "function", 12, 15, None), ("T", "type", 16, 16, None), ("I", "interface", 17, 17, None), ("q", "let", 18, 18, None), ("E", "enum", 19, 19, None)],
    ),
    "python": (
        'class G(Base):\n    """Doc\n text (\n"""\n    @prop\n    async def f(self, a="(",\n          b=2):\n        return 1\n\n    # next\n\ndef h():\n  pass\n',
        [("G", "class", 1, 8, None), ("f", "method", 6, 8, "G"), ("h", "function", 12, 13, None)],
    ),
    "go": (
        "type S struct {\n  a int\n}\nfunc (s *S) Run(x int) error {\n  return nil\n}\nfunc F[T any](x T) {}\nvar X = 3\ntype I interface {\n  M()\n}\ntype D time.Duration\n",
        [("S", "class", 1, 3, None), ("Run", "method", 4, 6, None), ("F", "function", 7, 7, None), ("X", "var", 8, 8, None), ("I", "interface", 9, 11, None), ("D", "type", 12, 12, None)],
    ),
    "rust": (
        "impl<'a> Foo for Bar<'a> {\n    pub(crate) fn new(x: &'a str) -> Self {\n        Bar { x }\n    }\n}\nstruct U;\npub trait T { fn a(&self); }\nconst M: usize = 3;\n",
        [("new", "method", 2, 4, "Bar"), ("U", "class", 6, 6, None), ("T", "interface", 7, 7, None), ("M", "const", 8, 8, None)],
    ),
    "java": (
        '@Service("x")\npublic class A implements B {\n  @Override\n  public List<Map<String, X>> go(String a) throws E {\n    return foo(a);\n  }\n  A(int x) {\n  }\n  abstract int z();\n}\nrecord P(int x) {}\n',
        [("A", "class", 2, 10, None), ("go", "method", 4, 6, "A"), ("A", "method", 7, 8, "A"), ("z", "method", 9, 9, "A"), ("P", "class", 11, 11, None)],
    ),
    "csharp": (
        "namespace N.M {\npublic sealed class A\n{\n    private static async Task<int> Go(int x)\n    {\n        return await Foo(x);\n    }\n}\n}\n",
        [("N", "class", 1, 9, None), ("A", "class", 2, 8, "N"), ("Go", "method", 4, 7, "A")],
    ),
    "kotlin": ("data class A(val x: Int)\nsuspend fun go(a: Int): Int = a\nobject O {\n  fun z() {\n  }\n}\n", [("A", "class", 1, 1, None), ("go", "function", 2, 2, None), ("O", "class", 3, 6, None), ("z", "method", 4, 5, "O")]),
    "ruby": ("module M\n  class A < B\n    def self.go?(x)\n      x\n    end\n    def w; end\n  end\nend\n", [("M", "class", 1, 8, None), ("A", "class", 2, 7, "M"), ("go?", "method", 3, 5, "A"), ("w", "method", 6, 6, "A")]),
    "php": ("<?php\nfinal class A {\n  public function go($x) {\n  }\n}\nfunction f() {}\n", [("A", "class", 2, 5, None), ("go", "method", 3, 4, "A"), ("f", "function", 6, 6, None)]),
}


@pytest.mark.parametrize("language", CASES)
def test_declarations(language):
    text, want = CASES[language]
    assert [(n, k, a, b, e) for n, k, a, b, _, e, _ in symbols.extract(text, language)] == want
    assert [(n, k, a, b, e) for n, k, a, b, _, e, _ in symbols.extract(text.replace("\n", "\r\n"), language)] == want


def test_documentation():
    (_, _, _, _, signature, _, doc), *_ = symbols.extract("/**\n * Opens it.\n * Twice.\n */\n@x\nfunction a() {\n}\n", "typescript")
    assert (signature, doc) == ("function a() {", "Opens it.\nTwice.")
    assert [s[6] for s in symbols.extract('def f():\n    """Opens\n    it."""\n\ndef g():\n    return "x"\n', "python")] == ["Opens\nit.", None]


def test_bodies_of_any_length_and_broken_texts():
    body = "function a() {\n" + "  b();\n" * 5000 + "}\nfunction c() {\n"
    assert [s[:4] for s in symbols.extract(body, "javascript")] == [("a", "function", 1, 5002), ("c", "function", 5003, 5004)]
    assert [s[:4] for s in symbols.extract("}\n}\n  )\nfunction d(\n", "javascript")] == [("d", "function", 4, 5)]
    assert symbols.extract("", "go") == [] and symbols.extract("func", "default") == []


def test_table(spark, rows):
    files = spark.createDataFrame([("a.py", "def f():\n  pass", "x"), ("b.py", None, "x"), ("c.py", "", "x"), ("d.h@3", "template <class T> struct V {};", "x")], "path string, content string, name string")
    assert rows(symbols.symbols(files), "path", "name", "kind", "line", "end_line", "position") == [("a.py", "f", "function", 1, 2, 0), ("d.h@3", "V", "class", 1, 1, 0)]
    assert symbols.symbols(files.limit(0)).count() == 0


def test_headers_and_kinds(spark, rows):
    from pyspark.sql import functions as F

    h = spark.createDataFrame([(1, "int f(int classy);"), (2, "class A;"), (3, "std::x y;"), (4, "template<typename T> T f();"), (5, "struct a { int template_; };")], "k int, t string")
    assert rows(h.select("k", paths.language(F.lit("a.h"), F.col("t")))) == [(1, "c"), (2, "cpp"), (3, "cpp"), (4, "cpp"), (5, "c")]
    said = {"export class A {": "class", "type X = 3": "type", "const a = 1": "const", "const a = () => 1": "function", "fn x()": "function", "void x() {": "function", "type S struct {": "class"}
    df = spark.createDataFrame(list(said), "string").select("value", symbols.kind_of(F.col("value")))
    assert dict(rows(df)) == said
