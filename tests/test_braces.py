import pytest
from pyspark.sql import functions as F

from textquarry.operators import braces, symbols

CASES = {
    "a.ts": (
        "import x from 'y' // class No {\n/* class No { */ export class A\n  extends B {\n  run(\n    a: number,\n    b = '}'): void {\n    if (a) { go(a) }\n  }\n"
        "  stop() { return `}${1}` }\n}\nfunction outer(a = {x: 1}) {\n  function inner() {\n  }\n}\nconst g = (x) => x\nhelper(1) {\nconst K = 3\n",
        [("A", "class", 2, None, None), ("run", "method", 4, "( a: number, b = ' ')", "A"), ("stop", "method", 9, "()", "A"),
         ("outer", "function", 11, "(a = {x: 1})", None), ("inner", "function", 12, "()", "outer"), ("g", "function", 15, "(x)", None), ("K", "constant", 17, None, None)],
    ),
    "a.go": (
        "package main\n\ntype T struct {\n\ta int // }\n}\nfunc (t *T) Do(\n\ta int,\n\tb string) error {\n\treturn fmt.Errorf(`{`, '{')\n}\nfunc main() {\n}\nvar x = 1\n",
        [("main", "package", 1, None, None), ("T", "struct", 3, None, None), ("Do", "func", 6, "( a int, b string)", None), ("main", "func", 11, "()", None), ("x", "var", 13, None, None)],
    ),
    "a.rs": (
        "mod m {\n    pub struct S<'a> { x: &'a str }\n    impl<'a> S<'a> {\n        pub fn go(\n            &self,\n        ) -> char {\n            let c = '{'; let s = r#\"}\"#;\n            c\n        }\n    }\n}\nfn main() {}\n",
        [("m", "module", 1, None, None), ("S", "struct", 2, None, "m"), ("S", "implementation", 3, None, "m"), ("go", "method", 4, "( &self, )", "m.S"), ("main", "function", 12, "()", None)],
    ),
    "A.java": (
        'package a.b;\npublic\nclass A {\n  String t = """\n  class No { }\n  """;\n  private int add(int x,\n      int y) throws E {\n    return new Foo() { }.add(x);\n  }\n  enum C { RED }\n  interface I { void f(int x); }\n}\n',
        [("a.b", "package", 1, None, None), ("A", "class", 3, None, None), ("add", "method", 7, "(int x, int y)", "A"), ("C", "enum", 11, None, "A"), ("I", "interface", 12, None, "A")],
    ),
    "a.cpp": (
        "#define MAX(a) { \\\n  a\nnamespace n {\nclass K : public B {\n  int get() const {\n    return f(x);\n  }\n};\n}\nint\nmain(int argc,\n     char **argv)\n{\n  char c = '}';\n  for (;;) { go(c); }\n}\nstruct P {\n  int x;\n};\n",
        [("MAX", "macro", 1, "(a)", None), ("n", "namespace", 3, None, None), ("K", "class", 4, None, "n"), ("get", "function", 5, "()", "n.K"),
         ("main", "function", 11, "(int argc, char **argv)", None), ("P", "struct", 17, None, None)],
    ),
    "a.js": ("class A {\r\n  b() {\r\n  }\r\n", [("A", "class", 1, None, None), ("b", "method", 2, "()", "A")]),
    "b.js": ("}}\nclass A {\n}\n  c() {\n}\n/* never closed\nclass B {", [("A", "class", 2, None, None)]),
    "c.js": ("", []),
    "a.py": ("class A {\n", []),
}


@pytest.mark.parametrize("path", sorted(CASES))
def test_languages(spark, path):
    text, want = CASES[path]
    df = spark.createDataFrame([(1, path, text), (2, path, None)], "doc_id long, path string, text string")
    got = braces.brace_symbols(df).collect()
    assert sorted((r.name, r.kind, r.line, r.signature, r.scope) for r in got) == sorted(want, key=lambda x: (x[0], x[1]))
    assert {r.doc_id for r in got} <= {1}


def plain_scopes(text):
    """Names of the classes that are open at the end of each line, by counting braces alone."""
    out, stack = [], []
    for line in text.split("\n"):
        word = line.split()
        for ch in line:
            if ch == "{":
                stack.append(word[1] if word[0] == "class" else None)
            elif ch == "}" and stack:
                stack.pop()
        out.append([x for x in stack if x])
    return out


def test_scopes_follow_counted_braces(spark):
    import random

    r = random.Random(9)
    for seed in range(30):
        lines, depth = [], 0
        for i in range(60):
            kind = r.choice(["class", "block", "close", "close", "text"])
            lines.append({"class": f"class C{i} {{", "block": "while (x) {", "close": "}", "text": f"x = {i};"}[kind])
        text = "\n".join(lines)
        scopes = plain_scopes(text)
        want = []
        for i, line in enumerate(lines):
            if line.startswith("class"):
                want.append((f"C{i}", "class", i + 1, None, ".".join(scopes[i][:-1]) or None))
        assert braces.find_symbols(text, "javascript") == want


def test_every_language_together(spark, sample):
    more = spark.createDataFrame([(10, "demo", "x.ts", "class A {\n  f() {\n  }\n}\n"), (11, "demo", "y.md", "# T\n")], sample.schema)
    files = sample.unionByName(more)
    got = braces.all_symbols(files)
    assert got.columns == symbols.extract_symbols(files).columns
    by_lines = symbols.extract_symbols(files.where("path <> 'x.ts'")).collect()
    assert sorted(map(str, got.where("doc_id <> 10").collect())) == sorted(map(str, by_lines))
    assert [(r.name, r.scope) for r in got.where("doc_id = 10").orderBy("line").collect()] == [("A", None), ("f", "A")]


def test_very_long_lines_and_heads(spark):
    text = "x(" * 50_000 + "\n" * 3000 + "class A {" + "}" * 50_000
    assert braces.find_symbols(text, "typescript") == [("A", "class", 3001, None, None)]
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert braces.brace_symbols(df, language=F.lit("typescript")).count() == 1
