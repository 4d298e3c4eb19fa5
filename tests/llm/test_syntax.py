import pytest

from quarrylens.llm import lexer as L
from quarrylens.llm import pieces as pc
from quarrylens.llm import syntax as sx

GOOD = {
    "a.py": 'def f(a):\n    """<<<<<<< HEAD"""\n    return {"(": a}\n', "b.py": "# only a comment\n", "c.js": "export function f(a) {\n  if (!a) {\n    return null;\n  }\n  const s = `\n<<<<<<< HEAD\n${a}`;\n  return a.map(x => x + 1);\n}\n", "d.ts": "export class A {\n  f(a: Map<string, number>): number | null {\n    return null;\n  }\n}\n",
    "e.go": "package p\n\nimport (\n\t\"a/b\"\n)\n\nfunc F(a []byte) *N {\n\tfor _, x := range a {\n\t\tg(x, `raw \" text`)\n\t}\n\treturn nil\n}\n", "f.rs": "impl A {\n    pub fn f<'a>(&self, x: &'a [u8]) -> Option<N> {\n        let c = '{';\n        return None;\n    }\n}\n",
    "g.java": "public class A {\n    Node f(List<String> a) {\n        for (var x : a) {\n            g(x, \"}\");\n        }\n        return null;\n    }\n}\n", "h.c": "#include \"a.h\"\nint f(const char *a, size_t n) {\n    for (int i = 0; i < n; i++) {\n        g(a);\n    }\n    return -1;\n}\n",
    "i.json": '{"a": [1, "x"]}', "j.jsonc": '{\n  // c\n  "a": "//"\n}', "k.yaml": "a:\n  b: \"x: y\"\n  c: |\n    any: [ text\n# c\n", "l.toml": "[a]\nb = 1\n", "m.tf": 'resource "a" "b" {\n  x = "y"\n  k = <<EOT\n{{{\nEOT\n}\n', "n.xml": "<a><b/></a>", "o.css": ".a{margin:0;color:#fff}@media x{.b{top:1px}}", "p.unknown": "((((", "q.js": "\ufeffvar a = 1;\r\n", "r.py": "",
}
BAD = {
    "a.py": "def f(:\n  pass\n", "b.py": "if x\n    y\n", "c.js": "function f( {\n}\n", "d.ts": "const a = \"open;\n", "e.go": "func F() {\n<<<<<<< HEAD\n}\n", "f.rs": "fn f() {\n    (\n}\n", "g.java": "version https://lfs.example/spec/v1\noid sha256:00\nsize 1\n", "h.c": "int f() {\n  else {\n  }\n}\n",
    "i.json": '{"a": 1,}', "i2.json": "", "j.jsonc": '{"a" 1}', "k.yaml": "a:\n<<<<<<< HEAD\n  b: 1\n", "l.toml": "a =\n", "m.tf": 'resource "a" "b" {\n', "n.xml": "<a><b></a>", "o.css": ".a{margin:0", "s.js": "def f(a):\n    return a\n", "t.js": "function f(a: string): number {\n}\n", "u.go": "import x from \"./x.js\";\nconst a = 1;\n", "v.py": "Traceback (most recent call last):\n",
}


@pytest.mark.parametrize("path", sorted(GOOD))
def test_valid(path):
    assert sx.is_valid(GOOD[path], L.FAMILY.get(L.extension(path)))


@pytest.mark.parametrize("path", sorted(BAD))
def test_invalid(path):
    assert not sx.is_valid(BAD[path], L.FAMILY.get(L.extension(path)))


@pytest.mark.parametrize("path", [p for p in sorted(GOOD) if L.FAMILY.get(L.extension(p)) in sx.PIECEWISE])
def test_states_compose(path):
    family, text = L.FAMILY[L.extension(path)], GOOD[path] * 3
    state, parts, masked = L.CODE, L.pieces(text, 25), []
    whole = tuple(range(8))
    for p in parts:
        m = L.state_map(p, family)
        whole = L.compose(whole, m)
        text_m, end = L.mask(p, family, state)
        assert end == m[state]
        masked.append(text_m)
        state = end
    assert whole[L.CODE] == L.mask(text, family)[1] == state
    total = ("", "", False)
    for x in masked:
        total = L.combine_brackets(total, L.bracket_summary(x))
    assert total == L.bracket_summary(L.mask(text, family)[0])


def test_large_files_by_pieces(spark, monkeypatch):
    good = GOOD["c.js"] * 30
    rows = [(1, "a.js", good, "x"), (2, "b.js", good + "function f() {\n", "x"), (3, "c.js", good + "/* open", "x"), (4, "d.js", None, "x"), (5, "e.js", good + "const a = \"x\n" + good, "x"), (6, None, good, "x"), (7, "noext", good, "x")]
    d = spark.createDataFrame(rows, "file_id long, file_path string, content string, k string")
    assert sorted(r.file_id for r in sx.invalid_files(d).collect()) == [2, 3, 5]
    monkeypatch.setattr(sx, "PIECE_CHARS", 400)
    assert sorted(r.file_id for r in sx.invalid_files(d).collect()) == [2, 3, 5]
    assert pc.pieces_with_start(d.filter("file_id = 1"), 400).count() > 5
    assert sx.invalid_files(d.limit(0)).count() == 0


PACKED = {
    "statements": ("a.js", "var a=1;" * 500, "b=c d;", "b=c;"),
    "one list": ("b.js", "var a=[" + "x+1," * 900, "y z];", ",y,{if:1,for:2}];for(;n-->0;)f();"),
    "callback": ("c.js", "define(['a'], function(a) {\n" + "  a.f(1);\n" * 500, "  a b c;\n});\n", "  if (a) b()\n  c()\n});\n"),
    "long callback": ("d.js", "(function() {\n" + "  a.f(1);\n" * 4000, "  def f(a):\n})();\n", "})();\n"),
    "packed callback": ("e.js", "(function(){" + "var o={a:function(){return c?f(y):{b:1}}};" * 90, "o=1 2})();", "o=12})();"),
    "typed method": ("f.js", "class A{" + "f(a,b){return a+b}" * 200, "f(a:string){return a}}", "f(a){return a}}"),
    "list of c": ("g.c", "int a[] = {" + "x, " * 900, "y z w q};\n", "y };\n"),
    "callback of go": ("h.go", 'func T(t *T) {\n\tt.Run("a", func(t *T) {\n' + "\t\tg(x)\n" * 900, "\t\tlet x = 1;\n\t})\n}\n", "\t\tx := 1\n\t})\n}\n"),
    "lambda of java": ("i.java", "class A {\n  void f() {\n    x.forEach(y -> {\n" + "      g(y);\n" * 900, "      g(y)\n      h(y);\n    });\n  }\n}\n", "      h(y);\n    });\n  }\n}\n"),
}


@pytest.mark.parametrize("name", sorted(PACKED))
def test_statements_of_any_length(name):
    path, head, bad, good = PACKED[name]
    family = L.FAMILY[L.extension(path)]
    assert sx.is_valid(head + good, family) and not sx.is_valid(head + bad, family)


def by_pieces(text, family, size):
    fold, state = sx.FileFold(family), L.CODE
    for p in L.pieces(text, size):
        facts = sx.piece_facts(p, family, state)
        state = facts[4]
        fold.add(*facts)
    return fold.valid()


@pytest.mark.parametrize("size", [60, 600, 2000])
def test_pieces_of_any_size_agree(data_dir, size):
    """Over all files of brace languages, and statements of any length: the verdict of the whole file."""
    import duckdb

    rows = duckdb.sql(f"select file_path, content from '{data_dir}/source_files.parquet' where content is not null").fetchall()
    rows += [(path, head + tail) for path, head, bad, good in PACKED.values() for tail in (bad, good)]
    rows += [("a.js", "f(`a b c d\n" + "word word " * 30 + "`, 1);\n" * 3), ("a.js", "f(" + "a, " * 300 + "b c);\n"), ("a.js", "x = 1; " * 40 + "y = 2 3; " + "z = 4; " * 40)]
    n = 0
    for path, text in rows:
        family = L.FAMILY.get(L.extension(path))
        if family in sx.PIECEWISE and len(text) > size:
            text = sx._without_bom(text)
            n += len(L.pieces(text, size)) > 1
            assert by_pieces(text, family, size) == sx.is_valid(text, family), (path, size)
    assert n > 5
