import pytest

from quarrylens.llm import docpairs as dp

TRIVIAL = [None, "", " \n", "...", "---", "TODO", "// FIXME later", "TODO: document this.", "XXX", "N/A", "{@inheritDoc}", "@inheritDoc", "Getter.", "@param a\n@return", ":param x:\n:rtype: int", "foo(null, 0); // old", "if (a == null) return;\nfoo(a);", "let x = y.clone();", "Copyright 2030 The X Authors. All rights reserved.", "Load query.", "load_query", "loadQuery()", "Test load query.", "Auto-generated stub", '"""tbd"""', "/**\n * TODO\n */"]
REAL = ["Returns the edge that belongs to the nested scope.", "TODO: Returns the window that belongs to the queue.", "LoadQuery reads the last snapshot from disk.", "/** Why not just load it? The panel may be dirty. */", "读取最后一份快照并返回给调用者。", "@param a the row to read, never null", "Удаляет закрытый каталог.", "Supprime toutes les correspondances restantes."]


@pytest.mark.parametrize("doc", TRIVIAL)
def test_trivial(doc):
    assert not dp.says_something(doc, "loadQuery")


@pytest.mark.parametrize("doc", REAL)
def test_real(doc):
    assert dp.says_something(doc, "loadQuery")


def test_capture_protects_strings():
    c = dp.capture('/** D. */\nfunction f(a, b = "}") {\n  // }\n  g("{", \'{\', `}`);\n}\nrest', "js")
    assert c[0] == "/** D. */" and c[1].startswith("function f") and c[2].endswith("`}`);\n}")
    p = dp.capture('@x\ndef f(a: dict = {"(": 1}) -> int:\n    """Doc."""\n    return (a[")"])\n', "py")
    assert p[0] == '"""Doc."""' and p[1].startswith("@x")
    assert dp.capture("function f( {", "js") is None


SYM = "symbol_id long, file_id long, repo string, file_path string, name string, kind string, start_line int, start_col int, end_line int, end_col int, docstring string, content string"
SRC = "file_id long, repo string, file_path string, content string"


def test_operator(spark):
    src = spark.createDataFrame([(1, "r", "a.js", "// D\nfunction f() {\n  return 1;\n}\n"), (2, "r", "b.js", None), (3, "r", "c.js", "")], SRC)
    doc = "Returns one whole number to callers."
    rows = [
        (1, 1, "r", "a.js", "f", "fn", 2, 1, 4, 2, doc, "x"), (1, 1, "r", "a.js", "f", "fn", 2, 1, 4, 2, doc, "x"), (2, 1, "r", "a.js", "f", "class", 2, 1, 4, 2, doc, "x"), (3, 9, "r", "gone", "f", "fn", 2, 1, 4, 2, doc, "x"),
        (4, 1, "r", "a.js", "f", "fn", 2, 1, 5, 2, doc, "past the end"), (5, 1, "r", "a.js", "f", "fn", None, None, None, None, doc, None), (6, 2, "r", "b.js", "f", "fn", 1, 1, 1, 2, doc, "x"), (7, 3, "r", "c.js", "f", "fn", 1, 1, 1, 2, doc, "x"),
        (8, 1, "r", "a.js", None, "fn", 2, 1, 4, 2, doc, "x"), (9, None, "r", "a.js", "f", "fn", 2, 1, 4, 2, doc, "x"),
    ]
    got = {r.symbol_id: r for r in dp.documented_functions(spark.createDataFrame(rows, SYM), src).collect()}
    assert sorted(got) == [1, 8] and got[1].code == "function f() {\n  return 1;\n}" and got[1].comment == "// D" and got[1].balanced
    assert dp.documented_functions(spark.createDataFrame([], SYM), src).count() == 0


def test_hot_groups_are_split(spark, monkeypatch):
    monkeypatch.setattr(dp, "GROUP_ROWS", 3)
    src = spark.createDataFrame([(1, "r", "a.js", "// D\nfunction f() {\n  return 1;\n}\n")], SRC)
    rows = [(i, 1, "r", "a.js", "f", "fn", 2, 1, 4, 2, "Returns one whole number to callers.", "x") for i in range(20)]
    assert sorted(r.symbol_id for r in dp.documented_functions(spark.createDataFrame(rows, SYM), src).collect()) == list(range(20))


def test_parts_of_large_files_hold_what_their_symbols_need(spark, monkeypatch):
    """The same pairs, whether files are joined whole or cut into blocks."""
    text = "".join(f"// Returns the number {i} to its callers.\n// More of it.\nfunction f{i}() {{\n  return {i};\n}}\n\n" for i in range(300))
    src = spark.createDataFrame([(1, "r", "a.js", text), (2, "r", "b.js", text)], SRC)
    doc = "Returns the number {} to its callers.\nMore of it."
    rows = [(k * 1000 + i, k, "r", "a.js", f"f{i}", "fn", 6 * i + 3, 1, 6 * i + 5, 2, doc.format(i), "x") for k in (1, 2) for i in range(300)] + [(9, 1, "r", "a.js", "f", "fn", 3, 1, 4000, 2, doc, "x"), (10, 1, "r", "a.js", "f0", "fn", 3, 1, 1000, 1, doc.format(0), "x")]
    d = spark.createDataFrame(rows, SYM)
    whole = sorted(dp.documented_functions(d, src).collect())
    monkeypatch.setattr(dp, "GROUP_ROWS", 40)
    monkeypatch.setattr(dp, "BLOCK_LINES", 100)
    assert sorted(dp.documented_functions(d, src).collect()) == whole and len(whole) == 601 and all(r.comment.endswith("More of it.") for r in whole)


def test_rows_come_from_the_capture(spark, monkeypatch):
    lines = dp.split_lines("// Returns one whole number to callers.\nfunction f() {\n  return {1;\n}\n// TODO\nfunction g() {\n}\n")
    sym = lambda a, b, doc: {"start_line": a, "start_col": 1, "end_line": b, "end_col": 2, "docstring": doc, "name": "f"}
    got = dp.pair_of(lines, sym(2, 4, "Returns one whole number to callers."), "js")
    assert got[1] == lines[0] and got[2] == "function f()" and got[4] is False
    assert dp.pair_of(lines, sym(6, 7, "TODO"), "js") is None
    assert dp.pair_of(lines, sym(6, 7, "Returns one whole number to callers."), "js")[0].startswith("Returns")  # of an older generation
    py = dp.split_lines('def f(a):\n    """Returns one whole number to callers."""\n    return (a\n')
    assert dp.pair_of(py, sym(1, 3, "Returns one whole number to callers."), "py")[1].startswith('"""')
    monkeypatch.setattr(dp, "capture", lambda *_: None)
    monkeypatch.setattr(dp, "capture_open", lambda *_: None)
    assert dp.pair_of(lines, sym(2, 4, "Returns one whole number to callers."), "js") is None
