"""Round trips and renderings: stored JSON, tag lines, query lists, ignore lists, overviews, consistency of copies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrylens.functions import languages as lang
from quarrylens.functions import text as tx
from quarrylens.operators import rollup
from quarrylens.operators.files import line_table
from quarrylens.operators.search import _ALL_SQL, _WORDS_SQL, _all_scored
from quarrylens.sources.extract import extract
from quarrylens.sources.workspace import ignored_directory_names, register, tag_lines
from quarrylens.session import checkpoint_dir, table

STORED = "filePath string, totalLines int, symbols array<struct<name:string,kind:string,startLine:int,endLine:int,owner:string,docstring:string>>"


def stored_json(symbols: DataFrame, extracted: DataFrame) -> DataFrame:
    """(file_id, extracted_json): one nested document a file, with camel-case keys."""
    s = F.struct("name", "kind", F.col("start_line").alias("startLine"), F.col("end_line").alias("endLine"), "owner", "docstring")
    # a file's symbols are bounded by the file itself
    g = symbols.groupBy("file_id").agg(F.array_sort(F.collect_list(s), lambda a, b: a["startLine"] - b["startLine"]).alias("symbols"))
    j = extracted.select("file_id", "file_path", "total_lines").join(g, "file_id", "left")
    return j.select("file_id", F.to_json(F.struct(F.col("file_path").alias("filePath"), F.col("total_lines").alias("totalLines"), "symbols")).alias("extracted_json"))


def snapshot_scan(stored: DataFrame) -> DataFrame:
    """Files decoded from their stored JSON; a document that doesn't parse counts as empty."""
    return stored.select("file_id", F.from_json("extracted_json", STORED).alias("f")).select("file_id", "f.filePath", "f.totalLines", "f.symbols")


def query_tokens(c):
    """Column form of the query compiler's tokens: words and their parts, lower case, each once in order."""
    words = F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}_-]+"), lambda w: F.length(w) > 0)
    return F.array_distinct(F.flatten(F.transform(words, lambda w: F.concat(F.array(w), tx.split_identifier(w)))))


#: A small tree with rules at every level, and whether its walk must give each file.
TREE = [
    (".gitignore", "*.log\n/out/\n!keep.log\nbuild-*/\n**/gen/*.ts\n", True), (".ignore", "secret.txt\n", True), ("a.py", "x = 1\n", True), ("b.log", "no\n", False), ("keep.log", "yes\n", True), ("out/x.py", "no\n", False), ("sub/out/y.py", "z = 2\n", True), ("sub/.gitignore", "!b.log\nlocal\n", True),
    ("sub/b.log", "again\n", True), ("sub/local", "no\n", False), ("sub/deep/local/z.py", "no\n", False), ("sub/secret.txt", "no\n", False), (".hidden/h.py", "h = 1\n", True), ("node_modules/m.js", "no\n", False), ("sub/.git/HEAD", "ref\n", False), ("build-1/a.c", "no\n", False), ("build.c", "int a;\n", True),
    ("p/q/gen/a.ts", "no\n", False), ("p/q/gen/a.js", "let a\n", True), ("p/q/r/s/t.go", "package t\n", True), ("up.tmp", "no\n", False), ("big.txt", "x" * 200 + "\n", True), ("empty.txt", "", True),
]


def a1_workspace_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, size, content) of a tree that is written to the shared folder first: a repository with ignore rules in it, in the directory
    above it and in a global file. Contents of more than 100 bytes stay null."""
    import os
    import uuid
    from urllib.parse import urlparse

    register(spark)
    base = os.path.join(urlparse(checkpoint_dir(spark)).path, f"tree-{uuid.uuid4().hex}")
    for path, text, _ in [*((f"work/{p}", t, k) for p, t, k in TREE), (".git/HEAD", "ref\n", False), (".gitignore", "/work/up.tmp\n", False), ("global", "*.orig\n", False), ("work/a.py.orig", "no\n", False)]:
        os.makedirs(os.path.dirname(os.path.join(base, path)), exist_ok=True)
        with open(os.path.join(base, path), "w") as f:
            f.write(text)
    tree = spark.read.format("workspace").option("maxBytes", "100").option("parts", "5").option("globalIgnore", f"{base}/global").load(f"{base}/work")
    return tree.select("path", "size", "content")


_TREE_SQL = "select path, cast(strlen(t) as bigint) as size, case when strlen(t) <= 100 then t end as content from (values " + ", ".join("('{}', '{}', {})".format(p, t.replace("'", "''"), k) for p, t, k in TREE) + ") v(path, t, k) where k"


def a10_snapshot_scan(spark, d):
    s = snapshot_scan(stored_json(table(spark, d, "symbols").distinct(), table(spark, d, "extracted_files")))
    return s.select("file_id", "totalLines", F.coalesce(F.size("symbols"), F.lit(0)).alias("n_symbols"), F.coalesce(F.size(F.filter("symbols", lambda x: x["docstring"].isNotNull())), F.lit(0)).alias("n_documented"))


def a11_query_list(spark, d):
    """Test queries as JSON and back: each with how many paths it expects."""
    r = table(spark, d, "search_results").groupBy("search_text").agg(F.to_json(F.struct(F.max("search_text").alias("query"), F.collect_set("file_path").alias("expected"))).alias("j"))
    q = r.select(F.from_json("j", "query string, expected array<string>").alias("q")).filter("q.query is not null")
    return q.select("q.query", F.size("q.expected").alias("n_expected"))


def a13_tag_lines(spark, d):
    t = table(spark, d, "tags").distinct()
    line = F.to_json(F.struct(F.lit("tag").alias("_type"), F.col("symbol").alias("name"), F.col("file").alias("path"), "language", "line", "kind", F.col("scope_name").alias("scope"), "signature"))
    return tag_lines(t.select(line.alias("value"))).groupBy("language", "kind").agg(F.count("*").alias("n"))


def a16_ignored_names(spark, d):
    lines = table(spark, d, "resolved_configs").select(F.explode("excluded_directories").alias("n")).select(F.explode(F.array(F.concat(F.lit("/"), "n", F.lit("/")), F.concat(F.lit("# "), "n"), F.concat(F.lit("!"), "n"), F.lit("*.log"))).alias("text"))
    return ignored_directory_names(lines)


def a21_overviews(spark, d):
    """A listing per repository: its twelve largest directories."""
    w = Window.partitionBy("repo").orderBy(F.desc("n_files"), "dir")
    r = rollup.directory_rollup(rollup.file_summaries(table(spark, d, "source_files"), table(spark, d, "symbols").distinct())).withColumn("rank", F.row_number().over(w)).filter("rank <= 12")
    line = F.format_string("- `%s/`: %d files, %d symbols", "dir", "n_files", "n_symbols")
    g = r.groupBy("repo").agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("l"))
    return g.select("repo", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("overview"))


def b16_scope_names(spark, d):
    """What the last part of a scope's path stands for: the scope, or nothing where several share it."""
    s = rollup.d26_monorepo_scopes(spark, d).select("repo", "scope", F.element_at(F.split("scope", "/"), -1).alias("last"))
    return s.groupBy("repo", "last").agg(F.count("*").alias("n"), F.when(F.count("*") == 1, F.min("scope")).alias("scope"))


def g3_merged_docstrings(spark, d):
    """Docstrings of a file from either extraction, each once."""
    a = table(spark, d, "extracted_files").select("file_id", F.explode("docstrings").alias("doc"))
    b = table(spark, d, "symbols").filter("docstring is not null").select("file_id", F.col("docstring").alias("doc"))
    return a.union(b).distinct().groupBy("file_id").agg(F.count("*").alias("n"))


def h4_query_tokens(spark, d):
    return table(spark, d, "search_results").select("search_text").distinct().select("search_text", F.array_join(query_tokens(F.col("search_text")), " ").alias("tokens"))


def h6_signals(spark, d):
    return _all_scored(spark, d).filter("n_owner > 0").select("symbol_id", F.round("signal", 6).alias("signal"))


def i18_parsed_events(spark, d):
    """Event properties with defaults where a field is missing or of another type."""
    p = F.from_json("props", "k bigint, stance string")
    return table(spark, d, "events").select("event_id", p.alias("p")).select("event_id", F.coalesce("p.k", F.lit(-1)).alias("k"), F.coalesce("p.stance", F.lit("unsure")).alias("stance"))


def k1_language_registry(spark, d):
    return spark.createDataFrame(sorted(lang.EXTENSIONS.items()), "extension string, language string")


def l16_owner_recall(spark, d):
    """Owners that the extractor gives callables against the stored ones."""
    src = table(spark, d, "source_files")
    got = extract(src).select("file_id", F.explode("symbols").alias("s")).select("file_id", F.col("s.name").alias("name"), F.col("s.start_line").alias("start_line"), F.col("s.owner").alias("own"))
    s = table(spark, d, "symbols").distinct().filter("owner is not null").select("file_id", "name", "start_line", "owner")
    j = s.join(got, ["file_id", "name", "start_line"])
    return j.agg(F.count("*").alias("n"), F.count(F.when(F.col("own") == F.col("owner"), 1)).alias("n_same"))


_L = "case when length({0}) = 0 then [] when right({0}, 1) in (chr(10), chr(13)) then string_split_regex({0}, '\\r\\n|\\r|\\n')[:len(string_split_regex({0}, '\\r\\n|\\r|\\n')) - 1] else string_split_regex({0}, '\\r\\n|\\r|\\n') end"
_LOW_WORDS = "list_filter(string_split_regex(lower(search_text), '[^\\p{L}\\p{N}_-]+'), lambda w: length(w) > 0)"

QUERIES = {
    "a1_workspace_walk": (a1_workspace_walk, _TREE_SQL),
    "a10_snapshot_scan": (a10_snapshot_scan, "with s as (select distinct * from symbols) select e.file_id, e.total_lines as totalLines, cast(coalesce(n, 0) as int) as n_symbols, cast(coalesce(m, 0) as int) as n_documented from extracted_files e left join (select file_id, count(*) as n, count(docstring) as m from s group by 1) using (file_id)"),
    "a11_query_list": (a11_query_list, "select search_text as query, cast(count(distinct file_path) as int) as n_expected from search_results group by 1"),
    "a13_tag_lines": (a13_tag_lines, "select language, kind, count(*) as n from (select distinct * from tags) where symbol is not null group by 1, 2"),
    "a16_ignored_names": (a16_ignored_names, "select distinct unnest(excluded_directories) as name from resolved_configs"),
    "a21_overviews": (a21_overviews, f"with {rollup._ROLL_SQL} select repo, string_agg('- `' || dir || '/`: ' || n_files || ' files, ' || n_symbols || ' symbols', chr(10) order by rank) as overview from (select *, row_number() over (partition by repo order by n_files desc, dir) as rank from roll) where rank <= 12 group by 1"),
    "b16_scope_names": (b16_scope_names, f"with {rollup._ROLL_SQL}, {rollup._SCOPE_SQL} select repo, string_split(scope, '/')[-1] as last, count(*) as n, case when count(*) = 1 then min(scope) end as scope from sc group by 1, 2"),
    "g3_merged_docstrings": (g3_merged_docstrings, "select file_id, count(*) as n from (select file_id, unnest(docstrings) as doc from extracted_files union select file_id, docstring from symbols where docstring is not null) group by 1"),
    "h4_query_tokens": (h4_query_tokens, "select search_text, (select string_agg(t, ' ' order by i) from (select t, min(i) as i from (select unnest(l) as t, generate_subscripts(l, 1) as i) group by t)) as tokens from (select search_text, flatten(list_transform(" + _LOW_WORDS + ", lambda w: list_concat([w], " + _WORDS_SQL.format(c="w") + "))) as l from (select distinct search_text from search_results))"),
    "h6_signals": (h6_signals, f"{_ALL_SQL} select symbol_id, round(signal, 6) as signal from sc where n_owner > 0"),
    "i18_parsed_events": (i18_parsed_events, "select event_id, coalesce(try_cast(json_extract_string(props, '$.k') as bigint), -1) as k, coalesce(json_extract_string(props, '$.stance'), 'unsure') as stance from events"),
    "k1_language_registry": (k1_language_registry, "select * from (values " + ", ".join(f"('{k}', '{v}')" for k, v in sorted(lang.EXTENSIONS.items())) + ") t(extension, language)"),
    "l16_owner_recall": (l16_owner_recall, None),
}
