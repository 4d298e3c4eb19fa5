import random

import pytest

from quarrylens.llm import lexer as L
from quarrylens.llm import provenance as pv

BODY = "function a(b) {\n  return b;\n}\n"


def reason(path, text):
    family = L.FAMILY[L.extension(path)]
    return pv.own_reason(text, family, L.spans(text, family)[0])


CASES = [
    ("a.js", f"// Code generated by x 1.2. DO NOT EDIT.\n{BODY}", "generated"), ("a.py", '"""This file was automatically generated by x."""\nx = 1\n', "generated"), ("a.go", "// Copyright 2030 X\n\n// Diese Datei wurde von x automatisch erzeugt.\npackage p\n", "generated"), ("a.ts", f"// source: a.proto\n// descriptor 190182705d07ef42\n{BODY}", "generated"),
    ("a.js", f"/*! libx v1.2.3 | (c) The libx Authors | MIT License */\n{BODY}", "vendored"), ("a.c", "// Copied unchanged from x 1.2; send fixes upstream.\nint a;\n", "vendored"), ("a.js", "var a=function(b){return c(b)};" * 40, "minified"), ("a.ts", "export const t: number[] = [\n" + "1, 2, 3, 4, 5, 6, 7, 8, 9, 10,\n" * 30 + "];\n", "data"), ("a.go", 'package d\nconst B = "' + "Ab9+" * 50 + '"\n', "data"),
    ("a.js", f"// Ids are auto-generated by the database, see the notes.\n{BODY}", None), ("a.js", f"// Do not edit the constants below without updating the test.\n{BODY}", None), ("a.js", f"// This module generates the table; edit the schema there.\n{BODY}", None), ("a.py", 'S = """\nCode generated by x. DO NOT EDIT.\n"""\nx = 1\n', None), ("a.js", f"// Copyright 2030 The X Authors\n{BODY}", None),
    ("a.js", BODY + "const w = [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12];\n" + BODY * 4, None), ("a.js", "", None), ("a.js", "// " + "long note " * 60 + f"\n{BODY}", None),
]


@pytest.mark.parametrize("path,text,want", CASES)
def test_own_reason(path, text, want):
    assert reason(path, text) == want


LICENCE = "".join(f"// Redistribution clause number {i} of a long licence text.\n" for i in range(45))


@pytest.mark.parametrize("path,text,want", [
    ("a.js", f"{LICENCE}\n// Code generated by x 1.2. DO NOT EDIT.\n{BODY}", "generated"), ("a.js", f"{LICENCE}import a, {{\n  b,\n}} from 'x';\nconst c = require('y');\n// Copied unchanged from x 1.2; send fixes upstream.\n{BODY}", "vendored"),
    ("a.go", f"package p\n\n{LICENCE}\nimport (\n\t\"fmt\"\n)\n\n// Code generated by x. DO NOT EDIT.\n\nfunc a() {{}}\n", "generated"), ("a.js", f"{BODY * 30}// @generated\n{BODY}", "generated"), ("a.js", f"{BODY}x = 1; // Code generated by x. DO NOT EDIT.\n", None),
    ("a.js", f"{BODY}// Copied unchanged from x 1.2; send fixes upstream.\n{BODY}", None),
    ("a.js", 'const a = "' + "Ab9+" * 300 + " " + "word " * 60 + f'";\n{BODY * 2}', None),
])
def test_notices_after_any_number_of_lines(path, text, want):
    assert reason(path, text) == want


@pytest.mark.parametrize("tokens", [1, 3, 12, 17, 30])
def test_short_copies_are_found(spark, tokens):
    """A stream of any length has fingerprints: short copies in three repositories are found, in two they aren't."""
    text = " ".join(f"t{i}" for i in range(tokens))
    rows = [(i, f"r{i}", f"x{i}.js", f"// {i}\n{text}\n", None) for i in range(3)] + [(i, f"r{i % 2}", f"y{i}.js", f"u {text}", None) for i in range(3, 6)]
    src = spark.createDataFrame(rows, "file_id long, repo string, file_path string, content string, reason int")
    conf = spark.createDataFrame([], "repo string, excluded_directories array<string>")
    assert {r.file_id for r in pv.not_hand_written(src, conf).collect() if r.reason == "vendored"} >= {0, 1, 2}


def test_hot_fingerprints_give_the_same_rows(spark, monkeypatch):
    rng = random.Random(3)
    code = lambda: "".join(f"f{rng.random()}(a);\n" for _ in range(20))
    lib = code()
    rows = [(i, f"r{i % 7}", f"l{i}.js", lib, None) for i in range(4200)] + [(9000 + i, f"r{i}", f"o{i}.js", code(), None) for i in range(5)]
    src = spark.createDataFrame(rows, "file_id long, repo string, file_path string, content string, reason int")
    judged = src.mapInPandas(pv._judge, "file_id long, repo string, reason string, prints array<long>")
    assert {r.file_id for r in pv.vendored_copies(judged).collect()} == set(range(4200))


def test_winnowing_finds_copies(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    code = lambda: "".join(f'const {word()} = {word()}({word()}, "{word()} {word()}");\n' for _ in range(30))
    lib = code()
    rows = [(i, f"r{i}", f"a/f{i}.js", code(), None) for i in range(6)]
    rows += [(10, "r1", "x/lib.js", lib, 1), (11, "r2", "y/lib.js", f"// another head\n{lib}", 1), (12, "r3", "z/lib.js", lib.replace("\n", "\r\n") + "// tail\n", 1), (13, "r4", "q/own.js", lib[: len(lib) // 3] + code() + code(), 1), (20, "r1", "deps/own.js", code(), 1), (21, "r2", "deps/own.js", code(), 1), (22, None, "a.js", None, 1), (23, "r1", None, "x", 1), (24, "r1", "a.json", "{}", 1)]
    src = spark.createDataFrame(rows, "file_id long, repo string, file_path string, content string, reason int")
    conf = spark.createDataFrame([("r1", ["deps", "vendor"]), ("r1", ["deps", "vendor"]), ("r2", None)], "repo string, excluded_directories array<string>")
    got = {r.file_id: r.reason for r in pv.not_hand_written(src, conf).collect()}
    assert got == {10: "vendored", 11: "vendored", 12: "vendored", 20: "excluded"}
    assert pv.not_hand_written(src.limit(0), conf.limit(0)).count() == 0


def test_winnow_guarantee():
    rng = random.Random(4)
    import numpy as np

    a = np.array([rng.randrange(1 << 60) for _ in range(400)], dtype=np.uint64)
    b = np.array([rng.randrange(1 << 60) for _ in range(400)], dtype=np.uint64)
    n = pv.GRAM + pv.WINDOW - 1
    b[100 : 100 + n] = a[50 : 50 + n]
    assert set(pv.winnow(a)) & set(pv.winnow(b))
