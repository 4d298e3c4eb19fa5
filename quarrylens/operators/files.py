"""Walking, filtering, reading and searching files: the live, index-free operators over (path, content) tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrylens.functions import languages as lang
from quarrylens.functions import text as tx
from quarrylens.plans.globs import glob_regex, matches_globs
from quarrylens.plans.query import read_atoms, write_atoms
from quarrylens.session import table

# ---------------------------------------------------------------- walking and pruning


def index_entries(files: DataFrame, max_bytes: int = lang.MAX_INDEXED_BYTES, include_ignored: bool = False) -> DataFrame:
    """Files that an index takes: in no junk directory, of a supported language, of no excluded class, not too large."""
    p = F.col("file_path")
    return files.filter(
        (F.col("size_bytes") <= max_bytes) & ~lang.in_junk_dir(p, include_ignored) & ~lang.is_excluded_file(p) & lang.language_of_path(p).isNotNull()
    )


def tree_fingerprint(files: DataFrame) -> DataFrame:
    """(repo, fingerprint): count and newest modification in whole milliseconds, joined by a colon."""
    return files.groupBy("repo").agg(F.concat_ws(":", F.count("*"), F.expr("max(mtime_ns) div 1000000")).alias("fingerprint"))


def tree_manifest(files: DataFrame) -> DataFrame:
    return files.select("file_id", "file_path", F.octet_length("content").cast("long").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def newest_first(files: DataFrame, keep: int = 100) -> DataFrame:
    """find: the newest ``keep`` files, path as tie-break, and whether more exist."""
    top = files.select("repo", "file_path", "mtime_ns").orderBy(F.desc("mtime_ns"), "file_path", "repo").limit(keep + 1)
    w = Window.orderBy(F.desc("mtime_ns"), "file_path", "repo")  # at most keep + 1 rows
    return top.withColumn("rank", F.row_number().over(w)).withColumn("truncated", F.count("*").over(Window.partitionBy()) > keep).filter(F.col("rank") <= keep)


def oldest_first(files: DataFrame, keep: int = 100) -> DataFrame:
    return files.select("repo", "file_path", "mtime_ns").orderBy("mtime_ns", "file_path", "repo").limit(keep)


# ---------------------------------------------------------------- lines


def line_table(files: DataFrame) -> DataFrame:
    """(file_id, line_no, text): lines of every file, 1-based, without the empty one after a trailing line end."""
    return files.filter(F.length("content") > 0).select("file_id", F.posexplode(tx.lines_of(F.col("content"))).alias("p", "text")).select("file_id", (F.col("p") + 1).alias("line_no"), "text")


def read_window(files: DataFrame, offset: int, limit: int) -> DataFrame:
    """Numbered lines from ``offset`` on, at most ``limit``, of every file; a byte-order mark is dropped."""
    d = files.withColumn("content", F.regexp_replace("content", "^\ufeff", ""))
    hit = line_table(d).filter(F.col("line_no").between(offset, offset + limit - 1))
    return hit.select("file_id", "line_no", tx.numbered_line(F.col("line_no"), F.col("text")).alias("rendered"))


def unchanged_reads(reads: DataFrame, state: DataFrame) -> DataFrame:
    """Reads not answered before: (path, offset, limit, floor of mtime) absent from the state table."""
    return reads.join(state, ["file_path", "offset", "limit", "mtime_ms"], "left_anti")


# ---------------------------------------------------------------- grep


def grep_lines(files: DataFrame, pattern: str, ignore_case: bool = False, globs: list[str] | None = None) -> DataFrame:
    """(file_id, line_no, text) of matching lines; files that hold a NUL are left out. The pattern is of the subset
    common to Java and RE2."""
    d = files.filter(~F.col("content").contains("\x00"))
    if globs:
        d = d.filter(matches_globs(F.col("file_path"), globs))
    p = f"(?i){pattern}" if ignore_case else pattern
    # whole files without any match are dropped before lines are made
    return line_table(d.filter(F.col("content").rlike(p.replace("^", "(?m)^", 1) if p.startswith("^") else p))).filter(F.col("text").rlike(p))


def grep_context(files: DataFrame, pattern: str, before: int, after: int) -> DataFrame:
    """Matching lines with context, overlaps merged: (file_id, line_no, text, is_match)."""
    lines = line_table(files.filter(F.col("content").rlike(pattern))).withColumn("is_match", F.col("text").rlike(pattern))
    w = Window.partitionBy("file_id").orderBy("line_no").rowsBetween(-after, before)
    return lines.withColumn("near", F.max("is_match").over(w)).filter("near").drop("near")


def grep_counts(files: DataFrame, pattern: str) -> DataFrame:
    """(file_id, n_matches): match regions per file, files without one left out."""
    n = F.regexp_count("content", F.lit(pattern))
    return files.select("file_id", n.cast("long").alias("n_matches")).filter("n_matches > 0")


def grep_multiline_counts(files: DataFrame, pattern: str) -> DataFrame:
    """Match regions per file with "." over line ends."""
    return grep_counts(files, f"(?s){pattern}")


def paginate(df: DataFrame, order: list, offset: int, head_limit: int) -> DataFrame:
    """A page of the ordered rows; a limit of 0 means all. Uses a global offset and limit, not a single-task window."""
    page = df.orderBy(*order).offset(offset)
    return page.limit(head_limit) if head_limit else page


def omit_long_lines(lines: DataFrame, max_bytes: int) -> DataFrame:
    n = F.octet_length("text")
    return lines.withColumn("text", F.when(n > max_bytes, F.format_string("[Omitted long line: %d bytes]", n)).otherwise(F.col("text")))


# ---------------------------------------------------------------- queries

_RAW_LINES = "string_split_regex(content, '\\r\\n|\\r|\\n')"
LINES_SQL = f"""lines as (select file_id, unnest(range(1, len(l) + 1)) as line_no, unnest(l) as text from
 (select file_id, case when right(content, 1) in (chr(10), chr(13)) then ({_RAW_LINES})[:len({_RAW_LINES}) - 1] else {_RAW_LINES} end as l from source_files where length(content) > 0))"""
_DIRS = "string_split(file_path, '/')[:len(string_split(file_path, '/')) - 1]"
_NAME = "string_split(file_path, '/')[-1]"
_EXT = f"lower(regexp_extract({_NAME}, '[^.]\\.([^.]+)$', 1))"

_BOM_FREE_LINES_SQL = LINES_SQL.replace("from source_files where", "from (select file_id, regexp_replace(content, '^\ufeff', '') as content from source_files) where")


def _sql_list(xs) -> str:
    return "[" + ", ".join(f"'{x}'" for x in xs) + "]"


_LANG_SQL = (
    "case " + " ".join(f"when {_NAME} = '{k}' then '{v}'" for k, v in lang.EXACT_NAMES.items()) + " " + " ".join(f"when {_EXT} = '{k}' then '{v}'" for k, v in lang.EXTENSIONS.items()) + " end"
)
_EXCLUDED_SQL = f"(regexp_matches({_NAME}, '{lang._EXCLUDED_FILE}') or (regexp_matches({_NAME}, '{lang._PROSE_FILE}') and {_NAME} <> 'CMakeLists.txt'))"
_JUNK_SQL = f"list_has_any({_DIRS}, {_sql_list([*lang.ALWAYS_EXCLUDED_DIRS, *lang.JUNK_DIRS])})"


def _src(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "source_files")


def a2_pruned_paths(spark, d):
    return _src(spark, d).filter(lang.in_junk_dir(F.col("file_path"))).select("file_id")


def a2_config_pruned_paths(spark, d):
    """Directories that a repository's own configuration excludes."""
    conf = table(spark, d, "resolved_configs").select("repo", "excluded_directories")
    dirs = F.slice(F.split("file_path", "/"), 1, F.greatest(F.size(F.split("file_path", "/")) - 1, F.lit(0)))
    return _src(spark, d).select("repo", "file_id", "file_path").join(conf, "repo").filter(F.arrays_overlap(dirs, "excluded_directories")).select("file_id")


def a3_excluded_files(spark, d):
    return _src(spark, d).filter(lang.is_excluded_file(F.col("file_path"))).select("file_id")


def a4_language_of_path(spark, d):
    return _src(spark, d).select("file_id", lang.language_of_path(F.col("file_path")).alias("language"))


def a5_index_entries(spark, d):
    return index_entries(_src(spark, d)).select("file_id", "mtime_ns", "size_bytes")


def a6_utf8_files(spark, d):
    return _src(spark, d).filter(F.is_valid_utf8("content")).select("file_id")


def a7_read_window(spark, d):
    return read_window(_src(spark, d), 3, 5)


def a8_new_reads(spark, d):
    """Reads of every search hit not answered before at the same modification: the first of each (path, mtime)."""
    s = table(spark, d, "search_results").select("result_id", "repo", "file_path", "searched_at")
    r = s.join(_src(spark, d).select("repo", "file_path", F.expr("mtime_ns div 1000000").alias("mtime_ms")), ["repo", "file_path"])
    w = Window.partitionBy("repo", "file_path", "mtime_ms").orderBy("searched_at", "result_id")
    return r.withColumn("rn", F.row_number().over(w)).filter("rn = 1").select("result_id", "mtime_ms")


def a9_full_scan(spark, d):
    return _src(spark, d).select("repo", "file_path", "mtime_ns")


def a17_tree_fingerprint(spark, d):
    return tree_fingerprint(_src(spark, d))


def a18_manifest(spark, d):
    return tree_manifest(_src(spark, d))


def b1_path_tokens(spark, d):
    t = _src(spark, d).select("file_id", F.posexplode(tx.tokenize_path(F.col("file_path"))).alias("p", "token"))
    return t.select("file_id", (F.col("p") + 1).alias("pos"), "token")


def b2_normalized_paths(spark, d):
    p = F.concat(F.lit("./x/../"), F.regexp_replace("file_path", "/", "//"))
    return _src(spark, d).select("file_id", tx.normalize_path(p).alias("path"))


_GLOBS = ["*.{ts,tsx,mts}", "apps/**/*.py", "!**/core/**"]


def b3_glob_filter(spark, d):
    return _src(spark, d).filter(matches_globs(F.col("file_path"), _GLOBS)).select("file_id")


def b5_simple_glob(spark, d):
    return _src(spark, d).filter(F.col("file_path").rlike(glob_regex("services/**/*_?*.{rs,go}", simple=True))).select("file_id")


def b6_type_filter(spark, d):
    hint = lang.normalize_language_hint("ts")
    return _src(spark, d).filter(lang.language_of_path(F.col("file_path")) == hint).select("file_id")


def b7_test_paths(spark, d):
    p = F.col("file_path")
    return _src(spark, d).select("file_id", tx.is_test_like_path(p).alias("ranked_as_test"), tx.path_indicates_test(p).alias("flagged_as_test"))


def b15_scope_filter(spark, d):
    """Files of every two-level scope that has one: (scope, n_files), by equality or prefix."""
    p = _src(spark, d).select("file_path")
    scope = F.regexp_extract("file_path", r"^([^/]+/[^/]+)/", 1)
    return p.withColumn("scope", scope).filter("scope <> ''").filter((F.col("file_path") == F.col("scope")) | F.startswith("file_path", F.concat("scope", F.lit("/")))).groupBy("scope").agg(F.count("*").alias("n_files"))


def b17_import_lines(spark, d):
    src = _src(spark, d)
    l = line_table(src).join(src.select("file_id", lang.language_of_path(F.col("file_path")).alias("language")), "file_id")
    return l.filter(lang.is_import_line(F.col("language"), F.col("text"))).groupBy("file_id", "language").agg(F.count("*").alias("n_imports"))


_B17_CASE = " or ".join("(language = '{}' and regexp_matches(text, '{}'))".format(k, v.replace("'", "''")) for k, v in lang.IMPORT_LINE.items())


def f3_newest_files(spark, d):
    return newest_first(_src(spark, d)).select("repo", "file_path", "mtime_ns", "truncated")


def f4_oldest_files(spark, d):
    return oldest_first(_src(spark, d))


def f5_files_with_matches(spark, d):
    hit = _src(spark, d).filter(F.col("content").rlike("(?i)todo")).select("file_id", "mtime_ns", "file_path")
    w = Window.orderBy(F.desc("mtime_ns"), "file_path", "file_id")
    return hit.orderBy(F.desc("mtime_ns"), "file_path", "file_id").limit(250).withColumn("rank", F.row_number().over(w)).select("file_id", "rank")


def f6_page(spark, d):
    hit = grep_lines(_src(spark, d), r"return \w+")
    return paginate(hit, ["file_id", "line_no"], 100, 250).select("file_id", "line_no")


def g2_vanished_paths(spark, d):
    """Paths that were found once but are no longer in the tree."""
    seen = table(spark, d, "search_results").select("repo", "file_path")
    return seen.subtract(_src(spark, d).select("repo", "file_path"))


def g6_excluded_names(spark, d):
    """Built-in, configured and own excluded names per repository, each once and sorted."""
    base = F.array(*[F.lit(x) for x in [*lang.ALWAYS_EXCLUDED_DIRS, *lang.JUNK_DIRS]])
    return table(spark, d, "resolved_configs").select("repo", F.explode(F.array_union(base, "excluded_directories")).alias("name"))


def h9_grep_content(spark, d):
    return grep_lines(_src(spark, d), r"(?:TODO|FIXME)")


def h9_grep_multiline(spark, d):
    return grep_multiline_counts(_src(spark, d), r"return[^;]*?\}")


def e7_grep_context(spark, d):
    return grep_context(_src(spark, d), r"SELECT ", 1, 2).select("file_id", "line_no", "is_match")


def d6_grep_counts(spark, d):
    return grep_counts(_src(spark, d), r"return ")


def d7_match_totals(spark, d):
    return grep_counts(_src(spark, d), r"return ").agg(F.sum("n_matches").alias("n_matches"), F.count("*").alias("n_files"))


def h10_long_lines(spark, d):
    return omit_long_lines(line_table(_src(spark, d)).filter(F.octet_length("text") > 500), 500)


def atoms_filter(text: str, path: Column, content: Column) -> Column:
    """All conditions of a conjunctive search over path and content; without ``case:yes`` a pattern without capitals ignores case. No
    conditions give false."""
    atoms = read_atoms(text)
    case = next((a.value for a in atoms if a.field == "case"), "auto")
    out = None
    for a in atoms:
        if a.field == "case":
            continue
        if a.field == "lang":
            hit = F.coalesce(lang.language_of_path(path) == a.value, F.lit(False))
        else:
            fold = a.field == "content" and (case == "no" or (case == "auto" and a.value == a.value.lower()))
            hit = (path if a.field == "file" else content).rlike(("(?i)" if fold else "") + a.value)
        hit = ~hit if a.negated else hit
        out = hit if out is None else out & hit
    return F.lit(False) if out is None else out


#: Search texts whose files are listed, written from options and by hand.
CONJUNCTIONS = [
    write_atoms("read snapshot|snapshot", file_type="py", prefix="lib", ignore_case=True), write_atoms("TODO", glob="*.{ts,tsx}"), write_atoms("class [A-Z]", file_type="java"), write_atoms("select", file_type="sql"), "case:yes lang:go Snapshot -file:_test", "lang:rust -content:unsafe fn\\ main", "case:no",
]


def h11_conjunctive_search(spark, d):
    """(search_text, file_id) of each conjunctive search; every file is read once for all of them."""
    hits = F.array_compact(F.array(*[F.when(atoms_filter(t, F.col("file_path"), F.col("content")), F.lit(t)) for t in CONJUNCTIONS]))
    return _src(spark, d).select("file_id", F.explode(hits).alias("search_text"))


def h12_symmetric_context(spark, d):
    """Matches with the same context on either side, the largest that was asked for, as one joined text."""
    c = grep_context(_src(spark, d), r"TODO", 2, 2)
    w = Window.partitionBy("file_id").orderBy("line_no")
    c = c.withColumn("block", F.col("line_no") - F.row_number().over(w))
    return c.groupBy("file_id", "block").agg(
        F.min("line_no").alias("first_line"), F.count("*").alias("n_lines"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), "\n").alias("shown")
    ).drop("block")


def i9_numbered_lines(spark, d):
    l = table(spark, d, "literals").filter(F.length("text") > 0).select("literal_id", "line", "text").distinct()
    return l.select("literal_id", tx.numbered_line(F.col("line"), F.col("text")).alias("shown"))


_GLOB_TEXT = "'" + glob_regex("*.{ts,tsx}", simple=True).replace("'", "''") + "'"
QUERIES = {
    "a2_pruned_paths": (a2_pruned_paths, f"select file_id from source_files where {_JUNK_SQL}"),
    "a2_config_pruned_paths": (a2_config_pruned_paths, f"select s.file_id from source_files s join resolved_configs c using (repo) where list_has_any({_DIRS}, c.excluded_directories)"),
    "a3_excluded_files": (a3_excluded_files, f"select file_id from source_files where {_EXCLUDED_SQL}"),
    "a4_language_of_path": (a4_language_of_path, f"select file_id, {_LANG_SQL} as language from source_files"),
    "a5_index_entries": (a5_index_entries, f"select file_id, mtime_ns, size_bytes from source_files where size_bytes <= {lang.MAX_INDEXED_BYTES} and not {_JUNK_SQL} and not {_EXCLUDED_SQL} and {_LANG_SQL} is not null"),
    "a6_utf8_files": (a6_utf8_files, "select file_id from source_files where content is not null"),
    "a7_read_window": (a7_read_window, f"with {_BOM_FREE_LINES_SQL} select file_id, cast(line_no as int) as line_no, lpad(cast(line_no as varchar), 6, ' ') || '→' || text as rendered from lines where line_no between 3 and 7"),
    "a8_new_reads": (a8_new_reads, "select result_id, mtime_ms from (select r.result_id, s.mtime_ns // 1000000 as mtime_ms, row_number() over (partition by r.repo, r.file_path, s.mtime_ns // 1000000 order by searched_at, result_id) as rn from search_results r join source_files s on r.repo = s.repo and r.file_path = s.file_path) where rn = 1"),
    "a9_full_scan": (a9_full_scan, "select repo, file_path, mtime_ns from source_files"),
    "a17_tree_fingerprint": (a17_tree_fingerprint, "select repo, count(*) || ':' || (max(mtime_ns) // 1000000) as fingerprint from source_files group by repo"),
    "a18_manifest": (a18_manifest, "select file_id, file_path, strlen(content) as bytes, sha256(content) as sha256 from source_files"),
    "b1_path_tokens": (b1_path_tokens, "select file_id, cast(unnest(range(1, len(t) + 1)) as int) as pos, unnest(t) as token from (select file_id, list_filter(string_split_regex(file_path, '[/\\\\.]'), lambda x: length(x) > 0) as t from source_files)"),
    "b2_normalized_paths": (b2_normalized_paths, "select file_id, file_path as path from source_files"),
    "b3_glob_filter": (b3_glob_filter, "select file_id from source_files where (regexp_matches(file_path, '(?:^|/)[^/]*\\.(?:ts|tsx|mts)$') or regexp_matches(file_path, '^apps/(?:.*/)?[^/]*\\.py$')) and not regexp_matches(file_path, '(?:^|/)core/')"),
    "b5_simple_glob": (b5_simple_glob, "select file_id from source_files where regexp_matches(file_path, '^services/.*/[^/]*_[^/][^/]*\\.(?:rs|go)$')"),
    "b6_type_filter": (b6_type_filter, f"select file_id from source_files where {_EXT} in ('ts', 'tsx', 'mts', 'cts')"),
    "b7_test_paths": (b7_test_paths, f"""select file_id, regexp_matches(p, '(?:^|/)(?:tests|test|benches|bench|__tests__)/') or starts_with(string_split(n, '.')[1], 'test_') or ends_with(string_split(n, '.')[1], '_test') or contains(n, '.test.') or contains(n, '.spec.') as ranked_as_test,
        regexp_matches(p, '(?:^|/)tests?/') or starts_with(n, 'test_') or contains(n, '_test.') or contains(n, '.test.') or contains(n, '_spec.') or contains(n, '.spec.') as flagged_as_test
        from (select file_id, lower(file_path) as p, lower({_NAME}) as n from source_files)"""),
    "b15_scope_filter": (b15_scope_filter, "select scope, count(*) as n_files from (select regexp_extract(file_path, '^([^/]+/[^/]+)/', 1) as scope from source_files) where scope <> '' group by scope"),
    "b17_import_lines": (b17_import_lines, f"with {LINES_SQL} select file_id, language, count(*) as n_imports from (select l.file_id, text, {_LANG_SQL} as language from lines l join source_files using (file_id)) where {_B17_CASE} group by all"),
    "f3_newest_files": (f3_newest_files, "select repo, file_path, mtime_ns, (select count(*) > 100 from source_files) as truncated from source_files order by mtime_ns desc, file_path, repo limit 100"),
    "f4_oldest_files": (f4_oldest_files, "select repo, file_path, mtime_ns from source_files order by mtime_ns, file_path, repo limit 100"),
    "f5_files_with_matches": (f5_files_with_matches, "select file_id, cast(row_number() over (order by mtime_ns desc, file_path, file_id) as int) as rank from source_files where regexp_matches(content, '(?i)todo') order by rank limit 250"),
    "f6_page": (f6_page, f"with {LINES_SQL} select file_id, cast(line_no as int) as line_no from lines where file_id not in (select file_id from source_files where contains(content, chr(0))) and regexp_matches(text, 'return \\w+') order by file_id, line_no limit 250 offset 100"),
    "g2_vanished_paths": (g2_vanished_paths, "select repo, file_path from search_results except select repo, file_path from source_files"),
    "g6_excluded_names": (g6_excluded_names, f"select repo, unnest(list_distinct(list_concat({_sql_list([*lang.ALWAYS_EXCLUDED_DIRS, *lang.JUNK_DIRS])}, excluded_directories))) as name from resolved_configs"),
    "h9_grep_content": (h9_grep_content, f"with {LINES_SQL} select file_id, cast(line_no as int) as line_no, text from lines where file_id not in (select file_id from source_files where contains(content, chr(0))) and regexp_matches(text, '(?:TODO|FIXME)')"),
    "h9_grep_multiline": (h9_grep_multiline, "select file_id, n_matches from (select file_id, len(regexp_extract_all(content, '(?s)return[^;]*?\\}')) as n_matches from source_files) where n_matches > 0"),
    "e7_grep_context": (e7_grep_context, f"with {LINES_SQL}, m as (select *, regexp_matches(text, 'SELECT ') as is_match from lines) select file_id, cast(line_no as int) as line_no, is_match from (select *, max(is_match) over (partition by file_id order by line_no rows between 2 preceding and 1 following) as near from m) where near"),
    "d6_grep_counts": (d6_grep_counts, "select file_id, n_matches from (select file_id, len(regexp_extract_all(content, 'return ')) as n_matches from source_files) where n_matches > 0"),
    "d7_match_totals": (d7_match_totals, "select cast(sum(n) as bigint) as n_matches, count(*) as n_files from (select len(regexp_extract_all(content, 'return ')) as n from source_files) where n > 0"),
    "h10_long_lines": (h10_long_lines, f"with {LINES_SQL} select file_id, cast(line_no as int) as line_no, '[Omitted long line: ' || strlen(text) || ' bytes]' as text from lines where strlen(text) > 500"),
    "h11_conjunctive_search": (h11_conjunctive_search, f"""with f as (select file_id, file_path as p, content as c, {_EXT} as e from source_files)
        select file_id, 'case:no lang:python file:^lib/ read\\ snapshot|snapshot' as search_text from f where e in ('py', 'pyi') and starts_with(p, 'lib/') and (contains(lower(c), 'read snapshot') or contains(lower(c), 'snapshot'))
        union all select file_id, 'file:' || {_GLOB_TEXT} || ' TODO' from f where regexp_matches(p, {_GLOB_TEXT}) and contains(c, 'TODO')
        union all select file_id, 'lang:java class\\ [A-Z]' from f where e = 'java' and regexp_matches(c, 'class [A-Z]')
        union all select file_id, 'file:\\.sql$ select' from f where e = 'sql' and contains(lower(c), 'select')
        union all select file_id, 'case:yes lang:go Snapshot -file:_test' from f where e = 'go' and contains(c, 'Snapshot') and not contains(p, '_test')
        union all select file_id, 'lang:rust -content:unsafe fn\\ main' from f where e = 'rs' and not regexp_matches(c, '(?i)unsafe') and regexp_matches(c, '(?i)fn main')"""),
    "h12_symmetric_context": (h12_symmetric_context, f"""with {LINES_SQL}, m as (select *, max(regexp_matches(text, 'TODO')) over (partition by file_id order by line_no rows between 2 preceding and 2 following) as near from lines),
        b as (select *, line_no - row_number() over (partition by file_id order by line_no) as block from m where near)
        select file_id, cast(min(line_no) as int) as first_line, count(*) as n_lines, string_agg(text, chr(10) order by line_no) as shown from b group by file_id, block"""),
    "i9_numbered_lines": (i9_numbered_lines, "select distinct literal_id, lpad(cast(line as varchar), 6, ' ') || '→' || text as shown from literals where length(text) > 0"),
}
