import pytest
from pyspark.sql import functions as F

from textquarry.functions.text import lines
from textquarry.operators import reports, symbols


def found(spark, path, text):
    df = spark.createDataFrame([(1, path, text)], "doc_id long, path string, text string")
    rows = symbols.extract_symbols(df).orderBy("line").collect()
    return [(r.name, r.kind, r.line, r.scope) for r in rows]


def test_sample_repo(sample):
    got = symbols.extract_symbols(sample, ("path",)).orderBy("path", "line").collect()
    assert [(r.path, r.name, r.kind, r.line, r.signature, r.scope) for r in got] == [
        ("lib/helper.py", "shout", "function", 2, "(text)", None),
        ("lib/helper.py", "Log", "class", 5, None, None),
        ("lib/helper.py", "__init__", "member", 8, "(self, name)", "Log"),
        ("lib/helper.py", "log", "member", 11, "(self, message)", "Log"),
        ("main.py", "greet", "function", 2, "()", None),
        ("main.py", "Adder", "class", 6, None, None),
        ("main.py", "add", "member", 9, "(self, a, b)", "Adder"),
        ("main.py", "sub", "member", 12, "(self, a, b)", "Adder"),
        ("utils.py", "process", "function", 2, "(data)", None),
        ("utils.py", "validate", "function", 9, "(value)", None),
    ]


@pytest.mark.parametrize(
    "path,text,want",
    [
        (
            "a.go",
            "package main\ntype T struct {\n}\ntype I interface {\n}\nfunc (t *T) Do(a int) error {\n}\nfunc main() {\n}\n",
            [("main", "package", 1), ("T", "struct", 2), ("I", "interface", 4), ("Do", "func", 6), ("main", "func", 8)],
        ),
        (
            "a.rs",
            "pub struct S;\nimpl S {\n    pub fn go(&self) {}\n}\nfn main() {}\ntrait T {}\n",
            [("S", "struct", 1), ("S", "implementation", 2), ("go", "method", 3), ("main", "function", 5), ("T", "interface", 6)],
        ),
        (
            "A.java",
            "package a.b;\npublic class A {\n    private int add(int x) {\n        return x;\n    }\n    public A(int y) {\n    }\n}\n",
            [("a.b", "package", 1), ("A", "class", 2), ("add", "method", 3), ("A", "method", 6)],
        ),
        (
            "a.ts",
            "export class A {\n  run(x: number): void {\n  }\n}\nexport function f(a) {\n}\nconst g = (x) => x\ninterface I {\n}\nconst K = 3\n",
            [("A", "class", 1), ("run", "method", 2), ("f", "function", 5), ("g", "function", 7), ("I", "interface", 8), ("K", "constant", 10)],
        ),
        (
            "a.c",
            "#define MAX 3\nstruct P {\n  int x;\n};\nint main(int argc, char **argv) {\n  return helper(1);\n}\n",
            [("MAX", "macro", 1), ("P", "struct", 2), ("main", "function", 5)],
        ),
        ("a.sh", "function go {\n}\nstop() {\n}\n", [("go", "function", 1), ("stop", "function", 3)]),
        (
            "a.rb",
            "module M\n  class C\n    def run(x)\n    end\n    def self.make\n    end\n  end\nend\n",
            [("M", "module", 1), ("C", "class", 2), ("run", "method", 3), ("make", "singletonMethod", 5)],
        ),
        ("a.md", "# One\ntext\n## Two #\n### Three\n", [("One", "chapter", 1), ("Two", "section", 3), ("Three", "subsection", 4)]),
        ("a.txt", "def x():\n", []),
    ],
)
def test_languages(spark, path, text, want):
    assert [s[:3] for s in found(spark, path, text)] == want


def test_nested_scopes(spark):
    text = "class A:\n    class B:\n        def f(self):\n            def g():\n                pass\n    def h(self):\n        pass\n"
    assert found(spark, "a.py", text) == [
        ("A", "class", 1, None),
        ("B", "class", 2, "A"),
        ("f", "member", 3, "A.B"),
        ("g", "function", 4, "A.B.f"),
        ("h", "member", 6, "A"),
    ]
    assert [s[3] for s in found(spark, "a.md", "# A\n## B\n# C\n### D\n")] == [None, "A", None, "C"]


def test_html(spark):
    page = (
        "<title>T <b>x</b></title><h1 class=a>H</h1><a name='n1'>q</a><a href=x id=n2>q</a><div id=\"d\">"
        "<script>var a=1;let b =2;const c=3</script>"
    )
    df = spark.createDataFrame([(1, page)], "page_id long, html string")
    got = {(r.kind, r.ordinal, r.name) for r in symbols.html_symbols(df).collect()}
    assert got == {
        ("title", 1, "T x"), ("heading1", 1, "H"), ("anchor", 1, "n1"), ("anchor", 2, "n2"), ("id", 1, "d"),
        ("variable", 1, "a"), ("variable", 2, "b"), ("variable", 3, "c"),
    }


def test_lookups(spark, sample):
    table = symbols.extract_symbols(sample)
    hit = symbols.find_symbol(table, sample, "add").collect()
    assert [(r.file_path, r.line) for r in hit] == [("demo::main.py", 9)]
    assert symbols.find_symbol(table, sample, "add", kind="class").count() == 0
    assert symbols.find_symbol(table, sample, "add", repo="other").count() == 0
    outline = symbols.list_symbols(table, sample, path="lib/helper.py").collect()
    assert [r.line for r in outline] == [2, 5, 8, 11]
    assert symbols.list_symbols(table, sample, kind="class").count() == 2
    only = sample.where("path = 'utils.py'")
    assert symbols.symbols_of_docs(table, only).count() == 2
    assert reports.orphans(only, sample.select("repo").distinct(), table).count() == 8


def test_symbol_lines_exist(sample):
    table = symbols.extract_symbols(sample, ("path",)).join(sample, "path")
    text = F.element_at(lines("text"), F.col("line"))
    assert table.where(~F.contains(text, F.col("name"))).count() == 0
