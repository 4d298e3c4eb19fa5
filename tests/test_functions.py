import pytest
from pyspark.sql import functions as F

from quarrylens.functions import languages as lang
from quarrylens.functions import structured as st
from quarrylens.functions import text as tx
from quarrylens.plans.globs import glob_regex, matches_globs, static_prefix
from quarrylens.plans.query import compile_query, split_identifier

WORDS = [("parseHTTPRequest", ["parse", "http", "request"]), ("put_tb", ["put", "tb"]), ("sha256Sum", ["sha256", "sum"]), ("kebab-case", ["kebab", "case"]), ("ABC", ["abc"]), ("", []), ("한글Name", ["한글", "name"]), ("v2api", ["v2", "api"])]


@pytest.mark.parametrize("word,want", WORDS)
def test_split_identifier(spark, word, want):
    assert split_identifier(word) == want
    assert spark.range(1).select(tx.split_identifier(F.lit(word)).alias("w")).first().w == want


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


def test_paths(spark):
    assert one(spark, tx.normalize_path(F.lit("a/./b//../c\\d"))) == "a/c/d"
    assert one(spark, tx.ancestors(F.lit("a/b/c.py"))) == ["a", "a/b"]
    assert one(spark, tx.ancestors(F.lit("c.py"))) == []
    assert one(spark, tx.extension(F.lit("x/.hidden"))) == "" and one(spark, tx.extension(F.lit("x/y.TS"))) == "ts"
    assert one(spark, tx.tokenize_path(F.lit("a\\b/c.d.rs"))) == ["a", "b", "c", "d", "rs"]


def test_test_paths_differ(spark):
    assert one(spark, tx.is_test_like_path(F.lit("benches/x.rs"))) and not one(spark, tx.path_indicates_test(F.lit("benches/x.rs")))
    assert not one(spark, tx.path_indicates_test(F.lit("src/latest.rs")))


def test_docstrings_and_quotes(spark):
    assert one(spark, tx.clean_docstring(F.lit("/// One\n/// two"))) == "One\ntwo"
    assert one(spark, tx.clean_docstring(F.lit("/**\n * Says it.\n * @x\n */"))) == "Says it.\n@x"
    assert one(spark, tx.clean_docstring(F.lit("// plain"))) is None and one(spark, tx.clean_docstring(F.lit(None).cast("string"))) is None
    for raw, want in [('"a"', "a"), ("'b'", "b"), ('"""c"""', "c"), ('r#"d"e"#', 'd"e'), ('f"x"', "x"), ("bare", "bare"), ('"', '"')]:
        assert one(spark, tx.strip_quotes(F.lit(raw))) == want


def test_caps(spark):
    assert one(spark, tx.cap_bytes(F.lit("aé한b"), 4)) == "aé" and one(spark, tx.cap_bytes(F.lit("abc"), 9)) == "abc"
    assert one(spark, tx.cap_chars(F.lit("abcdef"), 3)) == "abc…"
    assert one(spark, tx.lines_of(F.lit("a\r\nb\n"))) == ["a", "b"] and one(spark, tx.lines_of(F.lit(""))) == []


def test_languages(spark):
    p = lambda x: one(spark, lang.language_of_path(F.lit(x)))
    assert p("a/CMakeLists.txt") == "cmake" and p("x.MTS") == "typescript" and p("README") is None
    e = lambda x: one(spark, lang.is_excluded_file(F.lit(x)))
    assert e("a/b.min.js") and e("yarn.lock") and e("x.md") and not e("CMakeLists.txt") and not e("a/main.js")
    assert lang.normalize_language_hint(".TS") == "typescript" and lang.normalize_language_hint("klingon") is None


def test_globs(spark):
    m = lambda g, p: one(spark, F.lit(p).rlike(glob_regex(g)))
    assert m("*.ts", "a/b/c.ts") and not m("a/*.ts", "a/b/c.ts") and m("a/**/*.ts", "a/c.ts") and m("{x,y}/?.go", "y/a.go") and m("a[0-9].c", "q/a7.c")
    assert one(spark, matches_globs(F.lit("a/b.py"), ["!*.ts"])) and not one(spark, matches_globs(F.lit("a/b.ts"), ["!*.ts"]))
    assert static_prefix("a/b/*.c") == ("a/b", "*.c")
    with pytest.raises(ValueError):
        static_prefix("a/../b")


def test_query_compiler():
    q = compile_query("Store::get_item fooBar")
    assert q.raw_words == ["store::get_item", "foobar"] and q.qualified and q.supplement
    assert q.tokens[:4] == ["store", "get_item", "get", "item"] and compile_query("  ").terms == []
    with pytest.raises(ValueError):
        compile_query("x" * 10_001)


def test_structured():
    assert st.first_json_object('text {"a": {"b": "}"}} more') == '{"a": {"b": "}"}}' and st.first_json_object("{no") is None and st.first_json_object(None) is None
    assert st.first_json_object('```json\n{"x": 1}\n```') == '{"x": 1}'
    assert st.parsed_opinion('{"stance": "agree", "summary": "s", "recommendation": "r"}')["stance"] == "agree" and st.parsed_opinion("none")["parse_status"] == "fallback" and st.parsed_opinion(None)["raw_answer"] == ""
    for line, want in [("git 'a b' \"c \\\" d\" e\\ f", ["git", "a b", 'c " d', "e f"]), ("a''b \"\" c", ["ab", "", "c"]), ("x | y > z", ["x", "|", "y", ">", "z"]), ("'open end", ["open end"]), ("\"a\\nb", ["a\\nb"]), ("a\\", ["a\\"]), ("", []), (None, []), ("  ", [])]:
        assert st.shell_words(line) == want, line
    assert st.command_words("/bin/bash -c 'git push -f'") == ["git", "push", "-f"] and st.command_words("bash x.sh") == ["bash", "x.sh"] and st.command_words("bash -c ''") == ["bash", "-c", ""] and st.command_words("sudo bash -c 'x'") == ["sudo", "bash", "-c", "x"] and st.shell_words(None) == []
    assert st.owner_type("Option<Vec<T>>") == "Option" and st.owner_type("&mut a::B") == "a::B" and st.owner_type("A | B") is None and st.owner_type("Foo<Bar") is None
    assert st.folded_words("Ｆｏｏ STRASSE ß") == ["foo", "strasse", "ss"]
    s = {"type": "object", "required": ["a"], "properties": {"a": {"$ref": "#/d/n"}}, "additionalProperties": False, "d": {"n": {"type": ["integer", "null"]}}}
    assert st.schema_errors({"a": None}, s) == [] and len(st.schema_errors({"a": "x", "b": 1}, s)) == 2 and st.schema_errors({}, s) == ["$.a: missing"]
