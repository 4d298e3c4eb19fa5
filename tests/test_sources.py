import os
import time

import pytest
from pyspark.sql import functions as F

from quarrylens.sources import workspace as ws
from quarrylens.sources.config import ClaimBoard, Throttle, TtlStore, allowed_path, coerced, merged_config, with_retries
from quarrylens.sources.extract import extract, extract_file


@pytest.fixture
def tree(tmp_path):
    files = {
        ".gitignore": "*.log\n/out/\n!keep.log\n# note\n", "a.py": "x = 1\n", "b.log": "no", "keep.log": "yes", "out/x.py": "no", "sub/.ignore": "secret.txt\n", "sub/secret.txt": "no", "sub/ok.txt": "yes",
        "sub/deep/out/y.py": "yes", ".hidden/h.py": "yes", "node_modules/m.js": "no", ".git/HEAD": "no",
    }
    for p, t in files.items():
        f = tmp_path / p
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(t)
    (tmp_path / "bad.bin").write_bytes(b"\xff\xfe\x00")
    return tmp_path


def test_workspace_source(spark, tree):
    ws.register(spark)
    got = {r.path: r.content for r in spark.read.format("workspace").load(str(tree)).collect()}
    assert set(got) == {".gitignore", "a.py", "keep.log", "sub/.ignore", "sub/ok.txt", "sub/deep/out/y.py", ".hidden/h.py", "bad.bin"}
    assert got["a.py"] == "x = 1\n" and got["bad.bin"] is None
    every = {r.path for r in spark.read.format("workspace").option("includeIgnored", "true").load(str(tree)).select("path").collect()}
    assert "node_modules/m.js" in every and "b.log" in every and ".git/HEAD" not in every


def test_ignored_names(spark):
    d = spark.createDataFrame([("node_modules/",), ("*.log",), ("!x",), ("# c",), ("/dist",), ("a/b",), ("",), (None,)], "text string")
    assert sorted(r.name for r in ws.ignored_directory_names(d).collect()) == ["dist", "node_modules"]


@pytest.mark.parametrize("parts", [1, 2, 5, 64])
def test_a_tree_in_any_number_of_parts(spark, tree, parts):
    ws.register(spark)
    reader = ws.WorkspaceReader({"path": str(tree), "parts": str(parts)})
    got = [row[0] for p in reader.partitions() for row in reader.read(p)]
    assert len(got) == len(set(got)) == 8 and len(reader.partitions()) >= min(parts, 4)


def test_lines_are_numbered_across_partitions(spark):
    d = spark.range(0, 1000, 1, 7).select("id")
    assert all(r.line_no == r.id + 1 for r in ws.numbered_lines(d).collect())


def test_a_deleted_directory_takes_its_paths(spark, tmp_path):
    from quarrylens.streaming import refresh as rf

    schema = "r string, p string, change_kind string, at long"
    t = ws.VersionedTable(spark, str(tmp_path / "s"))
    go = lambda rows: rf.reconcile(t, spark.createDataFrame(rows, schema), ["r", "p"], ["at"], "p")
    live = lambda: {(x.r, x.p) for x in t.read().filter("change_kind <> 'delete'").collect()}
    go([("a", "d/x/1", "upsert", 1), ("a", "d/2", "upsert", 1), ("a", "dd/3", "upsert", 1), ("b", "d/2", "upsert", 1), (None, "d/2", "upsert", 1)])
    go([("a", "d", "delete", 2), ("a", "d/new", "upsert", 3), (None, "d/2", "upsert", 4)])
    assert live() == {("a", "d/new"), ("a", "dd/3"), ("b", "d/2"), (None, "d/2")}
    go([("a", "d/2", "upsert", 1)])  # late and old
    assert ("a", "d/2") not in live()


def test_query_list(spark, tmp_path):
    p = tmp_path / "q.json"
    p.write_text('[{"query": "a", "expected": ["x"]}, {"expected": []}, {"query": "b"}]')
    assert [(r.query, r.expected) for r in ws.query_list(spark, str(p)).collect()] == [("a", ["x"]), ("b", [])]
    p.write_text('[{"query": "a", "expected": "x"}]')
    with pytest.raises(ValueError):
        ws.query_list(spark, str(p))


def test_event_and_tag_lines(spark, tmp_path):
    p = tmp_path / "e.jsonl"
    p.write_text('{"label": "step", "id": "1"}\nnot json\n{"label": "tool", "id": "2"}\n')
    got = {r.line_no: (r.label, r.malformed, r.tail) for r in ws.event_lines(spark, str(p), 2).collect()}
    assert got == {1: ("step", False, False), 2: (None, True, False), 3: ("tool", False, True)}
    t = spark.createDataFrame([('{"_type": "tag", "name": "f", "path": "a.py", "line": 3}',), ('{"_type": "ptag"}',), ("bad",)], "value string")
    assert [(r.symbol, r.line) for r in ws.tag_lines(t).collect()] == [("f", 3)]


def test_versioned_table(spark, tmp_path):
    t = ws.VersionedTable(spark, str(tmp_path / "t"))
    assert t.read() is None
    t.write(spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int"))
    t.apply("k", spark.createDataFrame([("b", 3), ("c", 4)], "k string, v int"), spark.createDataFrame([("a",)], "k string"))
    assert sorted((r.k, r.v) for r in t.read().collect()) == [("b", 3), ("c", 4)]
    with pytest.raises(Exception):
        t.write(spark.range(1).select(F.raise_error(F.lit("x")).alias("k")))
    assert t.current() == 2
    with pytest.raises(RuntimeError, match="another writer"):
        t.folder.claim("commit/00000003", "x 1") and t.__class__._last.__get__(t)
        real = t._last
        t._last = lambda: (2, *real()[1:])
        t.write(spark.range(1))
    del t._last
    t.folder.delete("commit/00000003")
    assert ws.VersionedTable(spark, str(tmp_path / "t"), "2").read() is None


def test_config_and_guards(tmp_path):
    c = merged_config({"detail_files": 9, "max_file_size": "big"}, {"max_file_size": 5, "tail_files": -1})
    assert (c["detail_files"], c["max_file_size"], c["tail_files"]) == (9, 5, 12)
    assert allowed_path("x.py", str(tmp_path)).endswith("x.py")
    for bad in ("../x", "/dev/null", "\\\\host\\share"):
        with pytest.raises(PermissionError):
            allowed_path(bad, str(tmp_path))
    assert coerced({"filePath": "a", "headLimit": "5", "multiline": "true"}, {"path": str, "head_limit": int, "multiline": bool}) == {"path": "a", "head_limit": 5, "multiline": True}
    with pytest.raises(ValueError):
        coerced({"head_limit": "x"}, {"head_limit": int})


def test_retries_throttle_store_and_claims():
    calls, slept = [], []

    def work():
        calls.append(1)
        if len(calls) < 3:
            raise OSError
        return 7

    assert with_retries(work, sleep=slept.append) == 7 and slept == [5.0, 15.0]
    t = [0.0]
    th = Throttle(1000, lambda: t[0])
    assert th.due() and not th.due()
    t[0] = 1.0
    assert th.due()
    s = TtlStore(10, 2, lambda: t[0])
    s.put("a", 1), s.put("b", 2), s.get("a"), s.put("c", 3)
    assert s.get("b") is None and s.get("a") == 1
    t[0] = 99.0
    assert s.get("a") is None
    b = ClaimBoard(active=2)
    assert b.claim("s1", "p") and not b.claim("s2", "p") and not b.claim("s3", "q", predecessor="s1")
    b.finish("s1", True)
    assert b.claim("s3", "q", predecessor="s1") and not b.claim("s1", "z")


SAMPLES = {
    "m.py": ('class Store:\n    """Keeps items."""\n    def get(self, k):\n        """Find one."""\n        return self.items.get(k)\n\n\ndef _private():\n    return len("x")\n', {("Store", "class"), ("get", "fn"), ("_private", "fn")}),
    "m.ts": ('/** Adds. */\nexport function add(a: number): number {\n  return helper(a, "}");\n}\nexport class Box {\n  put(x: string): void {\n    this.items.push(x);\n  }\n}\n', {("add", "fn"), ("Box", "class"), ("put", "method")}),
    "m.go": ('package m\n\n// Run starts.\nfunc Run(a int) error {\n\treturn nil\n}\n\nfunc (s *Srv) stop() {\n}\n\ntype Srv struct {\n}\n', {("Run", "fn"), ("stop", "fn"), ("Srv", "struct")}),
    "m.rs": ('pub struct P;\nimpl P {\n    /// Makes.\n    pub fn make() -> P {\n        P\n    }\n}\n', {("P", "struct"), ("make", "fn")}),
    "m.java": ('public class A {\n    public int f(String s) {\n        return g(s);\n    }\n}\n', {("A", "class"), ("f", "method")}),
    "m.c": ('static int f(int x) {\n    return x;\n}\nstruct s {\n    int a;\n};\n', {("f", "fn"), ("s", "struct")}),
    "m.toml": ("[a]\nb = 1\n", {("a", "type"), ("b", "property")}),
    "m.sql": ("CREATE TABLE t (a int);\n", {("t", "struct")}),
}


@pytest.mark.parametrize("path", sorted(SAMPLES))
def test_extraction(path):
    text, want = SAMPLES[path]
    language = {"py": "python", "ts": "typescript", "go": "go", "rs": "rust", "java": "java", "c": "c", "toml": "toml", "sql": "sql"}[path.split(".")[1]]
    got = extract_file(path, text, language)
    assert got["error"] is None and want <= {(s["name"], s["kind"]) for s in got["symbols"]}


def test_extraction_details():
    e = extract_file("m.py", SAMPLES["m.py"][0], "python")
    by = {s["name"]: s for s in e["symbols"]}
    assert by["get"]["owner"] == "Store" and by["get"]["docstring"] == "Find one." and not by["_private"]["is_exported"]
    assert e["edges"] == []  # Python has no words for reads
    t = extract_file("m.ts", SAMPLES["m.ts"][0], "typescript")
    by = {s["name"]: s for s in t["symbols"]}
    assert by["add"]["docstring"] == "Adds." and by["add"]["end_line"] == 4 and by["put"]["owner"] == "Box" and by["add"]["is_exported"]
    assert {"text": "}", "line": 3} in t["literals"]
    v = extract_file("m.vue", "<template/>\n<script>\nfunction go() {\n}\n</script>\n", "vue")
    assert [(s["name"], s["start_line"]) for s in v["symbols"]] == [("go", 3)]


def test_extraction_of_bad_input(spark):
    d = spark.createDataFrame([(1, "a.py", "def f(:\n", "x"), (2, "b.py", None, "x"), (3, "c.unknown", "text", "x"), (4, "d.js", "", "x"), (5, None, "x", "x")], "file_id long, file_path string, content string, symbols string")
    got = {r.file_id: (r.error is not None, len(r.symbols)) for r in extract(d).collect()}
    assert got == {1: (True, 0), 2: (False, 0), 3: (False, 0), 4: (False, 0), 5: (False, 0)}


def test_stream_refresh_and_debounce(spark, tmp_path):
    from quarrylens.streaming import refresh as rf

    src = tmp_path / "in"
    t = ws.VersionedTable(spark, str(tmp_path / "state"))
    schema = "p string, at long, v string"
    spark.createDataFrame([("a", 1, "x"), ("b", 1, "y")], schema).write.mode("append").parquet(str(src))
    go = lambda: rf.refresh_from(rf.change_stream(spark, str(src), schema), t, str(tmp_path / "ck"), ["p"], ["at"])
    go()
    spark.createDataFrame([("a", 3, "new"), ("b", 0, "late and old")], schema).write.mode("append").parquet(str(src))
    go()
    go()
    assert sorted((r.p, r.v) for r in t.read().collect()) == [("a", "new"), ("b", "y")]
    assert rf.needs_full_refresh(spark.createDataFrame([(".git/HEAD",)], "p string"), "p") and not rf.needs_full_refresh(spark.createDataFrame([("x",)], "p string"), "p")


def test_event_reducer_stream(spark, tmp_path):
    from quarrylens.streaming import refresh as rf

    src = tmp_path / "ev"
    schema = "session string, id string, status string, body string"
    rows = [("s", "1", "start", "a"), ("s", "1", "start", "a"), ("s", "1", "start", "b"), ("s", "1", "finish", "a"), ("s", "2", "finish", "a"), ("s", "3", "start", "a"), ("s", "x", "stop", ""), ("s", "4", "start", "")]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(src))
    q = rf.reduced_events(rf.change_stream(spark, str(src), schema), "session", "id", "status", "body").writeStream.format("memory").queryName("reduced").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination()
    got = sorted((r.identity, r.problem) for r in spark.table("reduced").collect())
    assert got == [("1", "conflict"), ("1", "ok"), ("2", "finish without start"), ("3", "start without finish"), ("4", "after stop")]


def test_debounce_emits_each_window_once(spark, tmp_path):
    from quarrylens.streaming import refresh as rf

    src = tmp_path / "w"
    spark.createDataFrame([("r", "b"), ("r", "a"), ("r", "b")], "root string, p string").coalesce(1).write.parquet(str(src))
    q = rf.debounced(rf.change_stream(spark, str(src), "root string, p string"), "root", "p", 200).writeStream.format("memory").queryName("windows").outputMode("append").option("checkpointLocation", str(tmp_path / "c2")).trigger(processingTime="300 milliseconds").start()
    try:
        end = time.time() + 60
        while time.time() < end and spark.table("windows").count() == 0:
            time.sleep(0.3)
        assert [tuple(r.paths) for r in spark.table("windows").collect()] == [("a", "b")]
    finally:
        q.stop()


def test_reloading_config_and_queue(tmp_path):
    from quarrylens.sources.config import LatestOnly, ReloadingConfig

    t = [0.0]
    a = tmp_path / "a.json"
    c = ReloadingConfig(str(a), str(tmp_path / "none.json"), 500, lambda: t[0])
    assert c.get()["find_limit"] == 100
    a.write_text('{"find_limit": 7}')
    assert c.get()["find_limit"] == 100
    t[0] = 1.0
    assert c.get()["find_limit"] == 7
    a.write_text("broken")
    t[0] = 2.0
    assert c.get()["find_limit"] == 100
    q = LatestOnly()
    assert q.trigger(1) and not q.trigger(2) and q.take() == 1
