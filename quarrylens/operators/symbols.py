"""Symbol, caller, callee and import operators: interval joins on (file, line), semi-joins on names, uniqueness lookups.

Every interval join has file_id as an equality key, so a plan never becomes a cartesian product; names and lines are
reduced (distinct, semi-joined) before they are joined.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrylens.functions import text as tx
from quarrylens.operators.files import LINES_SQL, line_table
from quarrylens.session import table

CALLABLE = ["fn", "method", "function"]


def _sym(spark: SparkSession, d: str) -> DataFrame:
    """Symbols, exact duplicate rows once."""
    return table(spark, d, "symbols").distinct()


SYM = "s as (select distinct * from symbols)"
_FN = "kind in ('fn', 'method', 'function')"


def significant_symbols(symbols: DataFrame) -> DataFrame:
    """Symbols that are exported or don't lie strictly inside a callable of the same file."""
    fn = symbols.filter(F.col("kind").isin(CALLABLE)).select(F.col("file_id").alias("f"), F.col("start_line").alias("a"), F.col("end_line").alias("b")).distinct()
    local = symbols.filter(~F.coalesce("is_exported", F.lit(False)))
    strict = (F.col("a") <= F.col("start_line")) & (F.col("b") >= F.col("end_line")) & ((F.col("a") < F.col("start_line")) | (F.col("b") > F.col("end_line")))
    outer = local.join(fn, (F.col("file_id") == F.col("f")) & strict, "left_anti")
    return symbols.filter("is_exported").unionByName(outer)


#: Lines are met in blocks, so that a hit meets the ranges near its line and not all of its file; ranges of more than ``BLOCK`` blocks
#: go into wide ones.
BLOCK, WIDE = 64, 65_536


def ranges_by_block(ranges: DataFrame) -> DataFrame:
    """Ranges (start_line, end_line) once for each block (level, block) that they reach."""
    wide = F.col("end_line") - F.col("start_line") > BLOCK * BLOCK
    size = F.when(wide, WIDE).otherwise(BLOCK)
    d = ranges.filter("end_line >= start_line").withColumn("level", wide.cast("int"))
    return d.withColumn("block", F.explode(F.sequence(F.floor(F.col("start_line") / size), F.floor(F.col("end_line") / size))))


def hits_by_block(hits: DataFrame) -> DataFrame:
    """Hits (line) once a level, with the block of their line in it."""
    at = F.array(*[F.struct(F.lit(i).alias("level"), F.floor(F.col("line") / n).alias("block")) for i, n in enumerate((BLOCK, WIDE))])
    return hits.withColumn("__at", F.explode(at)).select("*", "__at.level", "__at.block").drop("__at")


def innermost_enclosing(hits: DataFrame, symbols: DataFrame, key: str) -> DataFrame:
    """Each hit (key, file_id, line) with the smallest callable around its line; null where there is none. Of equal spans
    the first by start and symbol_id."""
    fn = symbols.filter(F.col("kind").isin(CALLABLE)).select(F.col("file_id").alias("fn_file"), F.col("symbol_id").alias("fn_id"), F.col("name").alias("fn_name"), "start_line", "end_line")
    h, fn = hits_by_block(hits), ranges_by_block(fn).withColumnsRenamed({"level": "fn_level", "block": "fn_block"})
    near = (F.col("file_id") == F.col("fn_file")) & (F.col("level") == F.col("fn_level")) & (F.col("block") == F.col("fn_block"))
    j = h.join(fn, near & F.col("line").between(F.col("start_line"), F.col("end_line")), "left").drop("fn_file")
    best = F.when(F.col("fn_id").isNotNull(), F.struct((F.col("end_line") - F.col("start_line")).alias("span"), "start_line", "fn_id"))
    return j.groupBy(key, "file_id", "line").agg(F.min_by("fn_id", best).alias("fn_id"), F.min_by("fn_name", best).alias("fn_name"))


def calls_inside(calls: DataFrame, callables: DataFrame) -> DataFrame:
    """Calls (file_id, line, callee) with each callable (file_id, symbol_id, name, range) around them."""
    j = hits_by_block(calls).join(ranges_by_block(callables), ["file_id", "level", "block"])
    return j.filter(F.col("line").between(F.col("start_line"), F.col("end_line")))


def call_sites(files: DataFrame) -> DataFrame:
    """(file_id, line, name): identifiers followed by an opening parenthesis, each once a line."""
    l = line_table(files).filter(F.col("text").contains("("))
    return l.select("file_id", F.col("line_no").alias("line"), F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"([A-Za-z_$][A-Za-z0-9_$]*)\s*\("), F.lit(1)))).alias("name"))


CALLS_SQL = f"{LINES_SQL}, calls as (select file_id, line, name from (select file_id, cast(line_no as int) as line, unnest(list_distinct(regexp_extract_all(text, '([A-Za-z_$][A-Za-z0-9_$]*)\\s*\\(', 1))) as name from lines where contains(text, '(')))"


def outside_own_definition(hits: DataFrame, symbols: DataFrame) -> DataFrame:
    """Hits (file_id, line, name) that don't lie inside a callable of the same name: no headers, no recursion."""
    fn = symbols.filter(F.col("kind").isin(CALLABLE)).select(F.col("file_id").alias("f"), F.col("name").alias("n"), "start_line", "end_line").distinct()
    return hits.join(fn, (F.col("file_id") == F.col("f")) & (F.col("name") == F.col("n")) & F.col("line").between(F.col("start_line"), F.col("end_line")), "left_anti")


def callees(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """(symbol_id, callee, first_line): names called inside a callable's range that are callables anywhere, without itself."""
    fn = symbols.filter(F.col("kind").isin(CALLABLE))
    names = fn.select("name").distinct()
    c = call_sites(files).join(names, "name", "left_semi").withColumnRenamed("name", "callee")
    j = calls_inside(c, fn.select("file_id", "symbol_id", "name", "start_line", "end_line")).filter(F.col("callee") != F.col("name"))
    return j.groupBy("symbol_id", "callee").agg(F.min("line").alias("first_line"))


def callers(files: DataFrame, symbols: DataFrame, per_name: int = 5) -> DataFrame:
    """(name, file_id, line, caller): call sites of each callable outside its own definition with the callable around them
    ("top-level" without one), at most ``per_name`` a name by file and line, and how many there are."""
    fn = symbols.filter(F.col("kind").isin(CALLABLE))
    hits = outside_own_definition(call_sites(files).join(fn.select("name").distinct(), "name", "left_semi"), symbols)
    w = Window.partitionBy("name").orderBy("file_id", "line")
    n = hits.groupBy("name").agg(F.count("*").alias("n_sites"))
    top = hits.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= per_name).join(n, "name")
    e = innermost_enclosing(top.select("name", "file_id", "line").withColumn("k", F.concat_ws(":", "name", "file_id", "line")), symbols, "k")
    return top.withColumn("k", F.concat_ws(":", "name", "file_id", "line")).join(e.select("k", "fn_name"), "k").select("name", "file_id", "line", F.coalesce("fn_name", F.lit("top-level")).alias("caller"), "n_sites")


def callers_within(files: DataFrame, symbols: DataFrame, budget: int) -> DataFrame:
    """(name, n_sites, available, file_ids): the files that call each callable outside its own definition. A name with more sites than the
    budget gives no files at all rather than some of them."""
    fn = symbols.filter(F.col("kind").isin(CALLABLE))
    hits = outside_own_definition(call_sites(files).join(fn.select("name").distinct(), "name", "left_semi"), symbols)
    n = hits.groupBy("name").agg(F.count("*").alias("n_sites"))
    within = hits.join(n.filter(F.col("n_sites") <= budget).select("name"), "name").groupBy("name").agg(F.array_join(F.array_sort(F.collect_set("file_id")), ",").alias("file_ids"))
    return n.join(within, "name", "left").select("name", "n_sites", (F.col("n_sites") <= budget).alias("available"), "file_ids")


def precise_resolution(calls: DataFrame, symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """Calls (file_id, name) resolved to one definition: through an import, in the same file, or the only one anywhere;
    null where several compete. Adds target_id and how it was found."""
    fn = symbols.filter(F.col("kind").isin(CALLABLE))
    one = lambda g: F.when(F.count("*") == 1, F.min("symbol_id"))
    same = fn.groupBy("file_id", "name").agg(one("same").alias("same_id"), F.count("*").alias("same_n"))
    anywhere = fn.groupBy("name").agg(one("any").alias("any_id"))
    via = imports.join(fn.filter("is_exported").groupBy(F.col("file_id").alias("target_file"), F.col("name")).agg(one("via").alias("via_id")), ["target_file", "name"]).select("file_id", "name", "via_id")
    via = via.groupBy("file_id", "name").agg(F.when(F.countDistinct("via_id") == 1, F.min("via_id")).alias("via_id"))
    j = calls.join(via, ["file_id", "name"], "left").join(same, ["file_id", "name"], "left").join(anywhere, "name", "left")
    target = F.coalesce("via_id", F.when(F.col("same_n") == 1, F.col("same_id")), F.when(F.col("same_n").isNull(), F.col("any_id")))
    how = F.when(F.col("via_id").isNotNull(), "import").when(F.col("same_n") == 1, "same file").when(F.col("same_n").isNull() & F.col("any_id").isNotNull(), "global")
    return j.select("file_id", "name", target.alias("target_id"), how.alias("how"))


def relative_imports(files: DataFrame) -> DataFrame:
    """(file_id, repo, base): paths without extension that relative import lines of scripts name, folded."""
    l = line_table(files).filter(F.col("text").rlike(r"from\s+[\"']\.")).join(files.select("file_id", "repo", "file_path"), "file_id")
    spec = F.regexp_extract("text", r"from\s+[\"'](\.[^\"']+)[\"']", 1)
    path = tx.normalize_path(F.concat_ws("/", tx.parent_dir(F.col("file_path")), spec))
    return l.select("file_id", "repo", F.regexp_replace(path, r"\.(?:js|jsx|ts|tsx)$", "").alias("base")).distinct()


def resolved_imports(files: DataFrame) -> DataFrame:
    """(file_id, base, n_candidates, target_id): candidate files of each relative import; the target only if there is one."""
    ends = [".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.tsx", "/index.js", "/index.jsx"]
    want = relative_imports(files).select("*", F.explode(F.transform(F.array(*[F.lit(e) for e in ends]), lambda e: F.concat(F.col("base"), e))).alias("file_path"))
    have = files.select("repo", "file_path", F.col("file_id").alias("found"))
    j = want.join(have, ["repo", "file_path"], "left")
    return j.groupBy("file_id", "base").agg(F.count("found").alias("n_candidates"), F.when(F.count("found") == 1, F.min("found")).alias("target_id"))


def decorator_lines(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """(symbol_id, line, text): the lines above a symbol that begin with "@", blank lines skipped, up to the first other."""
    l = line_table(files).select("file_id", "line_no", F.trim("text").alias("t"))
    w = Window.partitionBy("file_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    # the last line so far that is neither blank nor a decorator stops the look back
    stop = l.withColumn("stop", F.max(F.when(~F.col("t").startswith("@") & (F.col("t") != ""), F.col("line_no"))).over(w))
    at = symbols.select("symbol_id", "file_id", "start_line").distinct()
    marks = stop.filter(F.col("t").startswith("@")).select("file_id", "line_no", "t", "stop")
    end = stop.select("file_id", (F.col("line_no") + 1).alias("start_line"), F.col("stop").alias("end_stop"))
    return (
        at.join(end, ["file_id", "start_line"])
        .join(marks, "file_id")
        .filter((F.col("line_no") < F.col("start_line")) & (F.col("line_no") > F.coalesce("end_stop", F.lit(0))))
        .select("symbol_id", F.col("line_no").alias("line"), F.col("t").alias("text"))
    )


def reference_scan(files: DataFrame, names: DataFrame) -> DataFrame:
    """(file_id, line, name, is_call): whole identifiers that are among the names, each once a line; a call where an opening
    parenthesis follows any of them."""
    l = line_table(files)
    ids = l.select("file_id", F.col("line_no").alias("line"), "text", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"[A-Za-z_$][A-Za-z0-9_$]*"), F.lit(0)))).alias("name"))
    hit = ids.join(names.select("name").distinct(), "name", "left_semi")
    called = F.array_contains(F.regexp_extract_all("text", F.lit(r"([A-Za-z_$][A-Za-z0-9_$]*)\s*\("), F.lit(1)), F.col("name"))
    return hit.select("file_id", "line", "name", called.alias("is_call"))


# ---------------------------------------------------------------- queries


def b8_significant_symbols(spark, d):
    return significant_symbols(_sym(spark, d)).select("symbol_id")


def c1_enclosing_callable(spark, d):
    hits = table(spark, d, "literals").select("literal_id", "file_id", "line").distinct()
    return innermost_enclosing(hits, _sym(spark, d), "literal_id").select("literal_id", "fn_id")


def c2_outside_definitions(spark, d):
    t = table(spark, d, "tags").distinct().join(table(spark, d, "source_files").select("repo", F.col("file_path").alias("file"), "file_id"), ["repo", "file"])
    return outside_own_definition(t.select("tag_id", "file_id", "line", F.col("symbol").alias("name")), _sym(spark, d)).select("tag_id")


def c3_callees(spark, d):
    return callees(table(spark, d, "source_files"), _sym(spark, d))


def c4_structural_calls(spark, d):
    """Per callable how many calls its range holds, and of how many names."""
    fn = _sym(spark, d).filter(F.col("kind").isin(CALLABLE)).select("file_id", "symbol_id", "start_line", "end_line")
    c = call_sites(table(spark, d, "source_files"))
    j = calls_inside(c, fn)
    return j.groupBy("symbol_id").agg(F.count("*").alias("n_calls"), F.countDistinct("name").alias("n_names"))


def c5_definition_lookups(spark, d):
    """Per name: definitions, files and owners, and the only definition where there is just one."""
    fn = _sym(spark, d).filter(F.col("kind").isin(CALLABLE))
    return fn.groupBy("name").agg(F.count("*").alias("n_defs"), F.countDistinct("file_id").alias("n_files"), F.countDistinct("owner").alias("n_owners"), F.when(F.count("*") == 1, F.min("symbol_id")).alias("only_id"))


def c6_first_binding(spark, d):
    """The first value binding of each name in each file."""
    v = _sym(spark, d).filter(F.col("kind").isin("variable", "const", "property"))
    return v.groupBy("file_id", "name").agg(F.min_by("symbol_id", F.struct("start_line", "start_col", "symbol_id")).alias("binding_id"))


def c7_relative_imports(spark, d):
    return resolved_imports(table(spark, d, "source_files"))


def c8_unshadowed_calls(spark, d):
    """Call sites whose name isn't bound to a value earlier in the same file."""
    v = _sym(spark, d).filter(F.col("kind").isin("variable", "const", "property")).select(F.col("file_id").alias("f"), F.col("name").alias("n"), "start_line").distinct()
    return call_sites(table(spark, d, "source_files")).join(v, (F.col("file_id") == F.col("f")) & (F.col("name") == F.col("n")) & (F.col("start_line") < F.col("line")), "left_anti")


def c9_precise_resolution(spark, d):
    src, s = table(spark, d, "source_files"), _sym(spark, d)
    c = call_sites(src).join(s.filter(F.col("kind").isin(CALLABLE)).select("name").distinct(), "name", "left_semi").select("file_id", "name").distinct()
    imports = resolved_imports(src).filter("target_id is not null").select("file_id", F.col("target_id").alias("target_file")).join(c, "file_id")
    return precise_resolution(c, s, imports)


def c10_callers(spark, d):
    return callers(table(spark, d, "source_files"), _sym(spark, d))


CALLER_BUDGET = 20


def c10_callers_within(spark, d):
    return callers_within(table(spark, d, "source_files"), _sym(spark, d), CALLER_BUDGET)


def c16_literals_naming_symbols(spark, d):
    """Symbol names that also stand as literals, and in how many other files."""
    lit = table(spark, d, "literals").select(F.col("file_id").alias("lf"), tx.qualified_leaf(F.col("text")).alias("name")).filter("name <> ''").distinct()
    s = _sym(spark, d).select("file_id", "name").distinct()
    return s.join(lit, "name").filter("file_id <> lf").groupBy("name").agg(F.countDistinct("lf").alias("n_literal_files"), F.countDistinct("file_id").alias("n_symbol_files"))


def c18_decorators(spark, d):
    return decorator_lines(table(spark, d, "source_files"), _sym(spark, d))


def d1_symbol_index(spark, d):
    return _sym(spark, d).groupBy("name").agg(F.count("*").alias("n_defs"), F.count(F.when(F.col("kind").isin(CALLABLE), 1)).alias("n_callables"))


def d2_name_frequency(spark, d):
    return _sym(spark, d).groupBy(F.lower("name").alias("name")).agg(F.count("*").alias("n"))


def d5_kinds_of_file(spark, d):
    """Per file and kind the distinct names, sorted, the first four shown and how many more there are."""
    names = _sym(spark, d).select("file_id", "kind", "name").distinct()
    g = names.groupBy("file_id", "kind").agg(F.array_sort(F.collect_list("name")).alias("n"))
    more = F.size("n") - 4
    return g.select("file_id", "kind", F.concat(F.array_join(F.slice("n", 1, 4), ", "), F.when(more > 0, F.concat(F.lit(" +"), more.cast("string"), F.lit(" more"))).otherwise("")).alias("shown"))


def d10_type_declarations(spark, d):
    t = _sym(spark, d).filter(F.col("kind").isin("class", "struct"))
    return t.groupBy("file_id", "name").agg(F.count("*").alias("n"), F.when(F.count("*") == 1, F.min("start_line")).alias("only_start"))


def d12_ambiguous_names(spark, d):
    return _sym(spark, d).groupBy("name").agg(F.count("*").alias("n"), F.countDistinct("file_id").alias("n_files")).filter("n > 1")


def e4_anchor_pairs(spark, d):
    """Per file the first literal and the first one more than twenty lines below it of another text."""
    l = table(spark, d, "literals").filter("text <> ''").select("file_id", "line", "text").distinct()
    first = l.groupBy("file_id").agg(F.min(F.struct("line", "text")).alias("a"))
    j = l.join(first, "file_id").filter((F.col("line") > F.col("a.line") + 20) & (F.col("text") != F.col("a.text")))
    return j.groupBy("file_id").agg(F.first("a.line").alias("first_line"), F.min("line").alias("second_line"))


def e5_scan_budget(spark, d):
    """Call sites kept per name under a shared budget, and whether any were left out."""
    s = _sym(spark, d).filter(F.col("kind").isin(CALLABLE))
    names = s.select("name").distinct()
    hits = call_sites(table(spark, d, "source_files")).join(names, "name", "left_semi")
    cap = names.agg(F.greatest(F.ceil(F.lit(2000) / F.count("*")), F.lit(25)).alias("cap"))
    w = Window.partitionBy("name").orderBy("file_id", "line")
    r = hits.withColumn("rn", F.row_number().over(w)).withColumn("cap", cap.scalar())
    return r.groupBy("name").agg(F.count(F.when(F.col("rn") <= F.col("cap"), 1)).alias("kept"), (F.count("*") > F.first("cap")).alias("truncated"))


def e6_capped_tags(spark, d):
    """At most 256 distinct (kind, scope, symbol, line) per file."""
    t = table(spark, d, "tags").select("repo", "file", "kind", "scope_name", "symbol", "line").distinct()
    w = Window.partitionBy("repo", "file").orderBy("line", "symbol", "kind", F.asc_nulls_first("scope_name"))
    return t.withColumn("rn", F.row_number().over(w)).filter("rn <= 256").drop("rn")


def e8_repeated_blocks(spark, d):
    """Docstrings already shown for the same name: every later one points back to the first."""
    s = _sym(spark, d).filter("docstring is not null").select("symbol_id", "name", F.sha2("docstring", 256).alias("block"))
    w = Window.partitionBy("name", "block").orderBy("symbol_id")
    return s.select("symbol_id", F.first("symbol_id").over(w).alias("first_id"), (F.row_number().over(w) > 1).alias("repeated"))


def g4_called_and_defined(spark, d):
    return call_sites(table(spark, d, "source_files")).select("name").intersect(_sym(spark, d).filter(F.col("kind").isin(CALLABLE)).select("name"))


def h13_lookup_symbol(spark, d):
    """Tags whose symbol begins with a prefix, of one kind and language."""
    t = table(spark, d, "tags").distinct()
    return t.filter(F.startswith(F.lower("symbol"), F.lit("fold")) & F.lower("kind").isin("function", "method") & F.col("language").isNotNull()).orderBy("repo", "file", "line", "tag_id").limit(250).select("tag_id", "symbol", "language")


def h14_reference_scan(spark, d):
    return reference_scan(table(spark, d, "source_files"), _sym(spark, d).filter(F.col("kind").isin(CALLABLE)).select("name"))


def i1_identifier_words(spark, d):
    return _sym(spark, d).select("name").distinct().select("name", F.array_join(tx.split_identifier(F.col("name")), " ").alias("words"))


def i2_clean_docstrings(spark, d):
    """Documentation comments of every form without their marks; plain comments give null."""
    s = _sym(spark, d).filter("docstring is not null")
    return s.select("symbol_id", tx.clean_docstring(F.col("docstring")).alias("doc"))


def i3_unquoted_literals(spark, d):
    """Quoting every literal and stripping the quotes gives it back."""
    l = table(spark, d, "literals").select("literal_id", "text").distinct()
    q = lambda a, b: tx.strip_quotes(F.concat(F.lit(a), F.col("text"), F.lit(b)))
    forms = [('"', '"'), ("'", "'"), ("`", "`"), ('"""', '"""'), ("'''", "'''"), ('f"', '"'), ("Rb'", "'"), ('r#"', '"#'), ('r"', '"')]
    return l.filter("text is not null").select("literal_id", "text", F.array(*[q(a, b) for a, b in forms]).alias("back")).select("literal_id", "text", F.forall("back", lambda x: x == F.col("text")).alias("all_same"))


def i7_qualified_names(spark, d):
    s = _sym(spark, d).select("symbol_id", "file_path", "owner", "name")
    return s.select("symbol_id", tx.qualified_name(F.when(tx.extension(F.col("file_path")) == "rs", "rust"), F.col("owner"), F.col("name")).alias("qualified"), tx.parent_dir(F.col("file_path")).alias("dir"))


def i8_capped_literals(spark, d):
    l = table(spark, d, "literals").select("literal_id", "text").distinct().filter(F.length("text") > 60)
    return l.select("literal_id", tx.cap_chars(F.col("text"), 60).alias("shown"), F.octet_length(tx.cap_bytes(F.col("text"), 60)).alias("bytes"))


def i10_escaped_names(spark, d):
    return table(spark, d, "literals").select("literal_id", "text").distinct().filter(F.length("text") > 0).select("literal_id", tx.escape_regex(F.col("text")).alias("escaped"))


_ENC_SQL = "select h.*, f.symbol_id as fn_id, f.name as fn_name, row_number() over (partition by {k} order by f.end_line - f.start_line, f.start_line, f.symbol_id) as rn from {h} h left join (select * from s where " + _FN + ") f on h.file_id = f.file_id and h.line between f.start_line and f.end_line"
_IMPORTS_SQL = f"""imp as (select distinct l.file_id, sf.repo, sf.file_path, regexp_extract(text, 'from\\s+["''](\\.[^"'']+)["'']', 1) as spec from lines l join source_files sf using (file_id) where regexp_matches(text, 'from\\s+["'']\\.')),
 base as (select distinct file_id, repo, regexp_replace(case when contains(file_path, '/') then regexp_replace(file_path, '/[^/]*$', '') || '/' else '' end || regexp_replace(spec, '^\\./', ''), '\\.(?:js|jsx|ts|tsx)$', '') as base from imp),
 want as (select b.*, b.base || e as file_path from base b, (select unnest(['.ts', '.tsx', '.js', '.jsx', '/index.ts', '/index.tsx', '/index.js', '/index.jsx']) as e)),
 res as (select w.file_id, w.base, count(h.file_id) as n_candidates, case when count(h.file_id) = 1 then min(h.file_id) end as target_id from want w left join source_files h on h.repo = w.repo and h.file_path = w.file_path group by w.file_id, w.base)"""
_ESC = r"([\\.+*?()\[\]{}|^$#&~/-])"

QUERIES = {
    "b8_significant_symbols": (b8_significant_symbols, f"with {SYM} select symbol_id from s where is_exported or not exists (select 1 from s f where f.{_FN} and f.file_id = s.file_id and f.start_line <= s.start_line and f.end_line >= s.end_line and (f.start_line < s.start_line or f.end_line > s.end_line))"),
    "c1_enclosing_callable": (c1_enclosing_callable, f"with {SYM}, h0 as (select distinct literal_id, file_id, line from literals), e as ({_ENC_SQL.format(k='h.literal_id, h.file_id, h.line', h='h0')}) select literal_id, fn_id from e where rn = 1"),
    "c2_outside_definitions": (c2_outside_definitions, f"with {SYM}, t as (select distinct t.tag_id, sf.file_id, t.line, t.symbol from (select distinct * from tags) t join source_files sf on sf.repo = t.repo and sf.file_path = t.file) select tag_id from t where not exists (select 1 from s where s.{_FN} and s.file_id = t.file_id and s.name = t.symbol and t.line between s.start_line and s.end_line)"),
    "c3_callees": (c3_callees, f"with {SYM}, {CALLS_SQL} select f.symbol_id, c.name as callee, min(c.line) as first_line from calls c join s f on f.file_id = c.file_id and c.line between f.start_line and f.end_line where f.{_FN} and c.name <> f.name and c.name in (select name from s where {_FN}) group by 1, 2"),
    "c4_structural_calls": (c4_structural_calls, f"with {SYM}, {CALLS_SQL} select f.symbol_id, count(*) as n_calls, count(distinct c.name) as n_names from calls c join s f on f.file_id = c.file_id and c.line between f.start_line and f.end_line where f.{_FN} group by 1"),
    "c5_definition_lookups": (c5_definition_lookups, f"with {SYM} select name, count(*) as n_defs, count(distinct file_id) as n_files, count(distinct owner) as n_owners, case when count(*) = 1 then min(symbol_id) end as only_id from s where {_FN} group by name"),
    "c6_first_binding": (c6_first_binding, f"with {SYM} select file_id, name, symbol_id as binding_id from (select *, row_number() over (partition by file_id, name order by start_line, start_col, symbol_id) as rn from s where kind in ('variable', 'const', 'property')) where rn = 1"),
    "c7_relative_imports": (c7_relative_imports, f"with {LINES_SQL}, {_IMPORTS_SQL} select * from res"),
    "c8_unshadowed_calls": (c8_unshadowed_calls, f"with {SYM}, {CALLS_SQL} select file_id, line, name from calls c where not exists (select 1 from s where s.kind in ('variable', 'const', 'property') and s.file_id = c.file_id and s.name = c.name and s.start_line < c.line)"),
    "c9_precise_resolution": (c9_precise_resolution, f"""with {SYM}, {CALLS_SQL}, {_IMPORTS_SQL}, fn as (select * from s where {_FN}), c as (select distinct file_id, name from calls where name in (select name from fn)),
        via0 as (select c.file_id, c.name, (select case when count(*) = 1 then min(symbol_id) end from fn where fn.file_id = r.target_id and fn.name = c.name and is_exported) as v from c join res r on r.file_id = c.file_id where r.target_id is not null),
        via as (select file_id, name, case when count(distinct v) = 1 then min(v) end as via_id from via0 group by 1, 2),
        same as (select file_id, name, min(symbol_id) as same_id, count(*) as same_n from fn group by 1, 2), anyw as (select name, case when count(*) = 1 then min(symbol_id) end as any_id from fn group by 1)
        select c.file_id, c.name, coalesce(via_id, case when same_n = 1 then same_id end, case when same_n is null then any_id end) as target_id,
        case when via_id is not null then 'import' when same_n = 1 then 'same file' when same_n is null and any_id is not null then 'global' end as how
        from c left join via using (file_id, name) left join same using (file_id, name) left join anyw using (name)"""),
    "c10_callers_within": (c10_callers_within, f"""with {SYM}, {CALLS_SQL}, hits as (select * from calls c where name in (select name from s where {_FN}) and not exists (select 1 from s where s.{_FN} and s.file_id = c.file_id and s.name = c.name and c.line between s.start_line and s.end_line))
        select name, count(*) as n_sites, count(*) <= {CALLER_BUDGET} as available, case when count(*) <= {CALLER_BUDGET} then array_to_string(list_sort(list_distinct(list(file_id))), ',') end as file_ids from hits group by 1"""),
    "c10_callers": (c10_callers, f"""with {SYM}, {CALLS_SQL}, hits as (select * from calls c where name in (select name from s where {_FN}) and not exists (select 1 from s where s.{_FN} and s.file_id = c.file_id and s.name = c.name and c.line between s.start_line and s.end_line)),
        top as (select * from (select *, row_number() over (partition by name order by file_id, line) as r, count(*) over (partition by name) as n_sites from hits) where r <= 5),
        e as ({_ENC_SQL.format(k='h.name, h.file_id, h.line', h='top')}) select name, file_id, line, coalesce(fn_name, 'top-level') as caller, n_sites from e where rn = 1"""),
    "c16_literals_naming_symbols": (c16_literals_naming_symbols, f"with {SYM}, l as (select distinct file_id as lf, regexp_extract(text, '([^:.]*)$', 1) as name from literals) select name, count(distinct lf) as n_literal_files, count(distinct file_id) as n_symbol_files from (select distinct file_id, name from s) x join l using (name) where name <> '' and file_id <> lf group by name"),
    "c18_decorators": (c18_decorators, f"with {SYM}, {LINES_SQL}, l as (select file_id, line_no, trim(text) as t from lines) select distinct s.symbol_id, cast(l.line_no as int) as line, l.t as text from (select distinct symbol_id, file_id, start_line from s) s join l on l.file_id = s.file_id and l.line_no < s.start_line and starts_with(l.t, '@') where s.start_line <= (select max(line_no) + 1 from l x where x.file_id = s.file_id) and not exists (select 1 from l o where o.file_id = s.file_id and o.line_no > l.line_no and o.line_no < s.start_line and o.t <> '' and not starts_with(o.t, '@'))"),
    "d1_symbol_index": (d1_symbol_index, f"with {SYM} select name, count(*) as n_defs, count(*) filter ({_FN}) as n_callables from s group by name"),
    "d2_name_frequency": (d2_name_frequency, f"with {SYM} select lower(name) as name, count(*) as n from s group by 1"),
    "d5_kinds_of_file": (d5_kinds_of_file, f"with {SYM} select file_id, kind, array_to_string(n[:4], ', ') || case when len(n) > 4 then ' +' || (len(n) - 4) || ' more' else '' end as shown from (select file_id, kind, list_sort(list(distinct name)) as n from s group by 1, 2)"),
    "d10_type_declarations": (d10_type_declarations, f"with {SYM} select file_id, name, count(*) as n, case when count(*) = 1 then min(start_line) end as only_start from s where kind in ('class', 'struct') group by 1, 2"),
    "d12_ambiguous_names": (d12_ambiguous_names, f"with {SYM} select name, count(*) as n, count(distinct file_id) as n_files from s group by 1 having count(*) > 1"),
    "e4_anchor_pairs": (e4_anchor_pairs, "with l as (select distinct file_id, line, text from literals where text <> ''), a as (select file_id, min((line, text)) as a from l group by 1) select file_id, min(struct_extract(a, 1)) as first_line, min(line) as second_line from l join a using (file_id) where line > struct_extract(a, 1) + 20 and text <> struct_extract(a, 2) group by file_id"),
    "e5_scan_budget": (e5_scan_budget, f"with {SYM}, {CALLS_SQL}, n as (select distinct name from s where {_FN}), cap as (select greatest(ceil(2000 / count(*)), 25) as cap from n) select name, least(count(*), cast(min(cap) as bigint)) as kept, count(*) > min(cap) as truncated from calls, cap where name in (select name from n) group by name"),
    "e6_capped_tags": (e6_capped_tags, "select repo, file, kind, scope_name, symbol, line from (select *, row_number() over (partition by repo, file order by line, symbol, kind, scope_name nulls first) as rn from (select distinct repo, file, kind, scope_name, symbol, line from tags)) where rn <= 256"),
    "e8_repeated_blocks": (e8_repeated_blocks, f"with {SYM} select symbol_id, min(symbol_id) over w as first_id, row_number() over (partition by name, docstring order by symbol_id) > 1 as repeated from s where docstring is not null window w as (partition by name, docstring)"),
    "g4_called_and_defined": (g4_called_and_defined, f"with {SYM}, {CALLS_SQL} select name from calls intersect select name from s where {_FN}"),
    "h13_lookup_symbol": (h13_lookup_symbol, "select tag_id, symbol, language from (select distinct * from tags) where starts_with(lower(symbol), 'fold') and lower(kind) in ('function', 'method') and language is not null order by repo, file, line, tag_id limit 250"),
    "h14_reference_scan": (h14_reference_scan, f"with {SYM}, {LINES_SQL}, ids as (select file_id, cast(line_no as int) as line, text, unnest(list_distinct(regexp_extract_all(text, '[A-Za-z_$][A-Za-z0-9_$]*'))) as name from lines) select file_id, line, name, list_contains(regexp_extract_all(text, '([A-Za-z_$][A-Za-z0-9_$]*)\\s*\\(', 1), name) as is_call from ids where name in (select name from s where {_FN})"),
    "i1_identifier_words": (i1_identifier_words, f"with {SYM} select name, array_to_string(list_filter(list_transform(string_split_regex(regexp_replace(regexp_replace(regexp_replace(name, '([a-z0-9])([A-Z])', '\\1_\\2', 'g'), '([A-Z])([A-Z][a-z])', '\\1_\\2', 'g'), '([0-9])([A-Za-z])', '\\1_\\2', 'g'), '[_-]+'), lambda x: lower(x)), lambda x: length(x) > 0), ' ') as words from (select distinct name from s)"),
    "i2_clean_docstrings": (i2_clean_docstrings, f"""with {SYM}, x as (select symbol_id, regexp_replace(docstring, '^\\s+|\\s+$', '', 'g') as t from s where docstring is not null), y as (select symbol_id, starts_with(t, '/**') as block, string_split_regex(case when starts_with(t, '/**') then regexp_replace(substr(t, 4), '\\*/$', '') else t end, '\\r?\\n') as lines from x),
        z as (select symbol_id, case when block then array_to_string(list_transform(lines, lambda l: trim(rtrim(trim(ltrim(trim(l, ' '), '*'), ' '), '*'), ' ')), chr(10)) else array_to_string(list_transform(list_filter(lines, lambda l: starts_with(trim(l, ' '), '///') or starts_with(trim(l, ' '), '//!')), lambda l: trim(case when starts_with(trim(l, ' '), '//!') then substr(trim(l, ' '), 4) else substr(trim(l, ' '), 3 + length(regexp_extract(trim(l, ' '), '^//(/+)', 1))) end, ' ')), chr(10)) end as doc from y)
        select symbol_id, nullif(regexp_replace(doc, '^\\s+|\\s+$', '', 'g'), '') as doc from z"""),
    "i3_unquoted_literals": (i3_unquoted_literals, "select distinct literal_id, text, true as all_same from literals where text is not null"),
    "i7_qualified_names": (i7_qualified_names, f"with {SYM} select symbol_id, case when length(owner) > 0 then owner || case when ends_with(lower(file_path), '.rs') then '::' else '.' end || name else name end as qualified, regexp_replace(file_path, '/?[^/]*$', '') as dir from s"),
    "i8_capped_literals": (i8_capped_literals, "select distinct literal_id, left(text, 60) || '…' as shown, cast((select max(b) from (select strlen(left(text, k)) as b from range(1, 61) t(k)) where b <= 60) as int) as bytes from literals where length(text) > 60"),
    "i10_escaped_names": (i10_escaped_names, f"select distinct literal_id, regexp_replace(text, '{_ESC}', '\\\\\\1', 'g') as escaped from literals where length(text) > 0"),
}
