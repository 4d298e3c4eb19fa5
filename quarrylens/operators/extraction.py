"""Queries over extraction from source text, held against the tables that an extractor left behind."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrylens.functions import structured as st
from quarrylens.sources.extract import extract
from quarrylens.session import table


def k3_extraction_recall(spark, d):
    """Per kind how many stored symbols of files that still stand the extractor finds at the same name and line."""
    src = table(spark, d, "source_files")
    got = extract(src).select("file_id", F.explode("symbols").alias("s")).select("file_id", F.col("s.name").alias("name"), F.col("s.start_line").alias("start_line")).distinct().withColumn("hit", F.lit(1))
    want = table(spark, d, "symbols").distinct().join(src.select("file_id"), "file_id", "left_semi").select("file_id", "name", "kind", "start_line")
    return want.join(got, ["file_id", "name", "start_line"], "left").groupBy("kind").agg(F.count("*").alias("n_stored"), F.count("hit").alias("n_found"))


def k3_extracted_symbols(spark, d):
    e = extract(table(spark, d, "source_files")).select("file_id", F.explode("symbols").alias("s"))
    return e.select("file_id", "s.name", "s.kind", "s.start_line", "s.end_line", "s.owner", "s.is_exported")


#: Files of several languages with writes to and reads from collections in fields, and the edges that each must give: kind, owner, field, line.
EDGE_FILES = [
    ("a.rs", "struct Queue { items: Vec<u8> }\nimpl Queue {\n    fn add(&mut self, x: u8) {\n        self.items.push(x);\n    }\n    fn each(&self) -> u8 {\n        self.items.iter().count();\n        self.items.len()\n    }\n}\nfn drain(q: &mut Queue, other: Vec<u8>) {\n    q.items.extend(other);\n    z.items.push(1);\n}\n", "producer Queue items 4;consumer Queue items 7;producer Queue items 12"),
    ("B.java", "class Store {\n    void put(String k) {\n        this.rows.add(k);\n        // this.rows.add(k);\n    }\n    void show(final Store s, int n) {\n        s.rows.forEach(x -> print(x));\n        s.rows.size();\n    }\n}\n", "producer Store rows 3;consumer Store rows 7"),
    ("c.py", "class Log:\n    def add(self, x):\n        self.lines.append(x)\n        self.lines.pop()\n\n\ndef fill(log: Log, n=1):\n    log.lines.extend([n])\n    text = 'log.lines.append(1)'\n", "producer Log lines 3;producer Log lines 8"),
    ("d.go", "package d\n\nfunc (s *Set) Add(x int) {\n\ts.all = append(s.all, x)\n}\n\nfunc Fill(t *Set, x int) {\n\tt.all = append(t.all, x)\n\tu.all = append(u.all, x)\n}\n", "producer Set all 4;producer Set all 8"),
    ("e.cpp", "class Ring {\n  void add(int x) {\n    this->slots.push_back(x);\n  }\n};\nint first(const Ring& r) {\n  return r.slots.front();\n}\n", "producer Ring slots 3;consumer Ring slots 7"),
    ("f.kt", "class Bag {\n    fun add(x: Int) {\n        this.held.add(x)\n    }\n}\nfun all(b: Bag?): Int {\n    return b.held.first()\n}\n", "producer Bag held 3;consumer Bag held 7"),
    ("g.txt", "self.a.push(1)\n", ""), ("h.js", "class A {\n  f() {\n    this.a.push(1);\n  }\n}\n", ""), ("i.rs", "", ""),
]


def _edges(files):
    e = extract(files).select("file_id", F.explode("edges").alias("e"))
    return e.select("file_id", "e.kind", "e.owner", "e.field", "e.line")


def _edge_files(spark):
    return spark.createDataFrame([(i, p, t) for i, (p, t, _) in enumerate(EDGE_FILES)], "file_id long, file_path string, content string")


def h15_collection_edges(spark, d):
    """Edges of a small set of files in six languages."""
    return _edges(_edge_files(spark))


def h15_source_edges(spark, d):
    """Edges of all source files."""
    return _edges(table(spark, d, "source_files"))


def producers_and_consumers(edges):
    """(owner, field, n_producers, n_consumers, n_pairs) of collections that are both written and read: pairs are counted, not made. Equal
    edges count once."""
    e = edges.select("file_id", "kind", "owner", "field", "line").distinct()
    n = lambda k: F.count(F.when(F.col("kind") == k, 1))
    g = e.groupBy("owner", "field").agg(n("producer").alias("n_producers"), n("consumer").alias("n_consumers"))
    return g.filter("n_producers > 0 and n_consumers > 0").withColumn("n_pairs", F.col("n_producers") * F.col("n_consumers"))


def c11_producers_consumers(spark, d):
    return producers_and_consumers(_edges(_edge_files(spark)))


# types as written and the owner that each must give; texts and the JSON that each must give; lines and their imports, by hand
TYPES = [
    ("Queue", "Queue"), ("&Queue", "Queue"), ("&'a mut a::Queue<T>", "a::Queue"), ("const Ring&", "Ring"), ("struct ring *", "ring"), (": Map<K, Vec<V>>", "Map"), ("Bag?", "Bag"), ("new Store", "Store"), ("a.b.Store", "a.b.Store"), ("A | B", None), ("Fn(A) -> B", None),
    ("Foo<Bar", None), ("Foo>", None), ("Foo<A>[]", None), ("[]int", None), ("", None), ("  ", None), ("Map<A, B> extra", None), ("dyn Read", None),
]
JSON_TEXTS = [
    ('say {"a": 1} twice {"b": 2}', '{"a": 1}'), ('```json\n{"x": {"y": "}"}}\n```', '{"x": {"y": "}"}}'), ('{bad} then {"k": [1, {"z": 2}]} end', '{"k": [1, {"z": 2}]}'), ("{no", None), ("", None), ("[1, 2]", None), ('[{"in": 1}]', '{"in": 1}'), ("```\n[1]\n```", None),
]
IMPORT_LINES = [
    ("a.ts", "import a from './x';", "a ./x import"), ("a.ts", "import { b, c as d } from 'y';", "b y import;d y import"), ("a.ts", "import * as n from 'z';", "n z import"), ("a.js", "const q = require('fs');", "q fs require"), ("a.py", "import os\n", "os os namespace"), ("a.py", "from ..x import y as z, w\n", "z ..x named;w ..x named"),
    ("a.py", "from m import *\n", "* m glob"), ("a.js", "let a = 1;", ""),
]


def i5_owner_cases(spark, d):
    t = spark.createDataFrame([(t,) for t, _ in TYPES], "raw string")
    return t.select("raw", st.owner_type_udf("raw").alias("owner_type"))


def i6_import_cases(spark, d):
    """Imports of single lines, one row a name."""
    f = spark.createDataFrame([(i, p, t) for i, (p, t, _) in enumerate(IMPORT_LINES)], "file_id long, file_path string, content string")
    return extract(f).select("file_id", F.explode("imports").alias("i")).select("file_id", "i.name", "i.source", "i.kind")


def i17_json_cases(spark, d):
    t = spark.createDataFrame([(t,) for t, _ in JSON_TEXTS], "raw string")
    return t.select("raw", st.first_json_object_udf("raw").alias("json"))


OPINIONS = [
    ('Sure. {"stance": "agree", "summary": "fine", "recommendation": "ship", "agreements": ["a", " ", 3, "b"], "concerns": "none"}', "agree", "fine", "ship", "a|b", "parsed"),
    ('```json\n{"stance": "maybe", "summary": "s", "recommendation": "r", "agreements": null}\n```', "insufficient_info", "s", "r", "", "parsed"),
    ('{"stance": "agree", "summary": " ", "recommendation": "r"}', "insufficient_info", st.NO_STRUCTURE, "", "", "fallback"), ('{"stance": "disagree", "summary": "s"}', "insufficient_info", st.NO_STRUCTURE, "", "", "fallback"), ("plain words", "insufficient_info", st.NO_STRUCTURE, "", "", "fallback"), ("", "insufficient_info", st.NO_STRUCTURE, "", "", "fallback"),
    ('{"stance": "partial", "summary": "s", "recommendation": 4}', "insufficient_info", st.NO_STRUCTURE, "", "", "fallback"),
]


def opinions(answers, col: str = "raw"):
    """Answers with their opinion: stance, summary, recommendation, agreements joined by a bar, and how they were read."""

    def run(frames):
        for f in frames:
            o = [st.parsed_opinion(t) for t in f[col]]
            yield f.assign(**{k: [x[k] for x in o] for k in ("stance", "summary", "recommendation", "parse_status")}, agreements=["|".join(x["agreements"]) for x in o])[[col, "stance", "summary", "recommendation", "agreements", "parse_status"]]

    return answers.select(col).mapInPandas(run, f"{col} string, stance string, summary string, recommendation string, agreements string, parse_status string")


def i18_opinions(spark, d):
    return opinions(spark.createDataFrame([(x[0],) for x in OPINIONS], "raw string"))


def _cases(rows) -> str:
    cell = lambda v: "cast(null as varchar)" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return "(values " + ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows) + ")"


_EDGE_ROWS = [(i, *e.split(" ")) for i, (_, _, edges) in enumerate(EDGE_FILES) for e in edges.split(";") if e]
_EDGE_VALUES = "(values " + ", ".join(f"({i}, '{k}', '{o}', '{f}', {n})" for i, k, o, f, n in _EDGE_ROWS) + ") e(file_id, kind, owner, field, line)"


def i6_import_entries(spark, d):
    e = extract(table(spark, d, "source_files")).select("file_id", F.explode("imports").alias("i"))
    return e.select("file_id", "i.name", "i.source", "i.kind", "i.line")


def i4_base_names(spark, d):
    """Signatures and scopes that tags keep: as one line, as type text and by their last name."""
    t = table(spark, d, "tags").select("tag_id", F.explode(F.array_compact(F.array("signature", "scope_name"))).alias("raw")).distinct()
    return t.select("tag_id", "raw", st.navigation_text(F.col("raw")).alias("one_line"), st.type_text(F.col("raw")).alias("type_text"), st.base_name(F.col("raw")).alias("base"))


def i5_owner_types(spark, d):
    s = table(spark, d, "tags").select("scope_name").filter("scope_name is not null").distinct()
    return s.select("scope_name", st.owner_type_udf("scope_name").alias("owner_type"))


def i13_folded_words(spark, d):
    r = table(spark, d, "search_results").select("search_text").distinct()
    return r.select("search_text", F.array_join(st.folded_words_udf("search_text"), " ").alias("words"))


def i17_json_in_text(spark, d):
    x = table(spark, d, "documents").filter(F.col("text").contains("{")).select("doc_id", st.first_json_object_udf("text").alias("j"))
    return x.filter("j is not null").select("doc_id", F.length("j").alias("n_chars"))


def i19_main_commands(spark, d):
    """The program of every literal read as a command line, shells taken off."""
    l = table(spark, d, "literals").filter(F.length("text") > 0).select("literal_id", "text").distinct()
    return l.select("literal_id", st.main_command_udf("text").alias("command")).filter("command is not null")


QUERIES = {
    "k3_extraction_recall": (k3_extraction_recall, None),
    "k3_extracted_symbols": (k3_extracted_symbols, None),
    "c11_producers_consumers": (c11_producers_consumers, f"select p.owner, p.field, count(distinct (p.file_id, p.line)) as n_producers, count(distinct (c.file_id, c.line)) as n_consumers, count(*) as n_pairs from {_EDGE_VALUES.replace(' e(', ' p(')}, {_EDGE_VALUES.replace(' e(', ' c(')} where p.kind = 'producer' and c.kind = 'consumer' and p.owner = c.owner and p.field = c.field group by 1, 2"),
    "h15_collection_edges": (h15_collection_edges, f"select * from {_EDGE_VALUES}"),
    "h15_source_edges": (h15_source_edges, None),
    "i4_base_names": (i4_base_names, r"""with t as (select distinct tag_id, unnest([signature, scope_name]) as raw from tags), o as (select tag_id, raw, array_to_string(list_filter(string_split_regex(raw, '\\s+'), lambda w: w <> ''), ' ') as w, string_split_regex(trim(raw), '[<(\\[]')[1] as head from t where raw is not null)
        select tag_id, raw, replace(replace(replace(replace(replace(replace(replace(w, ' .', '.'), '. ', '.'), ' ::', '::'), ':: ', '::'), ' (', '('), '( ', '('), ' )', ')') as one_line,
        nullif(trim(regexp_replace(trim(regexp_replace(ltrim(trim(raw), ':'), '^(?:new )+', '')), ';+$', '')), '') as type_text, nullif(trim(list_filter(string_split_regex(trim(head), '[.:/\\\\ ]'), lambda x: x <> '')[-1], '*&'), '') as base from o"""),
    "i5_owner_types": (i5_owner_types, None),
    "i5_owner_cases": (i5_owner_cases, f"select * from {_cases(TYPES)} t(raw, owner_type)"),
    "i6_import_cases": (i6_import_cases, f"select * from {_cases([(i, *e.split(' ')) for i, (_, _, es) in enumerate(IMPORT_LINES) for e in es.split(';') if e])} t(file_id, name, source, kind)"),
    "i18_opinions": (i18_opinions, f"select * from {_cases(OPINIONS)} t(raw, stance, summary, recommendation, agreements, parse_status)"),
    "i17_json_cases": (i17_json_cases, f"select * from {_cases(JSON_TEXTS)} t(raw, json)"),
    "i6_import_entries": (i6_import_entries, None),
    "i13_folded_words": (i13_folded_words, "select distinct search_text, array_to_string(regexp_extract_all(lower(search_text), '\\w+'), ' ') as words from search_results"),
    "i17_json_in_text": (i17_json_in_text, None),
    "i19_main_commands": (i19_main_commands, None),
}
