"""Event logs, runs and judgments: reduction by identity, costs that stay unknown when a part is, pairing, agreement.

"Validate, never guess": a missing value makes the aggregate that needs it null, never zero. Grouped aggregates are
partial on the map side; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrylens.operators.skew import previous_row
from quarrylens.session import table

# ---------------------------------------------------------------- null-keeping aggregates


def known_sum(c: Column) -> Column:
    """The sum, null where any value is null."""
    return F.when(F.count(c) == F.count("*"), F.sum(c))


def one_value(c: Column) -> Column:
    """The only distinct value, null where there are several."""
    return F.when(F.countDistinct(c) == 1, F.min(c))


def numeric_summary(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """valid_n, missing_n, denominator_n, mean and sample deviation per group; a deviation needs two values."""
    v = F.col(value)
    return df.groupBy(*group).agg(F.count(v).alias("valid_n"), F.count(F.when(v.isNull(), 1)).alias("missing_n"), F.count("*").alias("denominator_n"), F.round(F.avg(v), 6).alias("mean"), F.round(F.stddev_samp(v), 6).alias("sd"))


def agreement(df: DataFrame, item: str, label: str) -> DataFrame:
    """Unanimous rate, pairwise rate and Fleiss' kappa over items of the same number of raters; a degenerate kappa is null.

    One pass over (item, label) counts; the labels' totals are one row a label.
    """
    n = df.groupBy(item, label).agg(F.count("*").alias("n"))
    per = n.groupBy(item).agg(F.sum("n").alias("k"), F.sum(F.col("n") * (F.col("n") - 1)).alias("same"), F.count("*").alias("labels"))
    per = per.filter("k >= 2")
    p = per.agg(F.count("*").alias("items"), F.avg(F.when(F.col("labels") == 1, 1.0).otherwise(0.0)).alias("unanimous"), F.avg(F.col("same") / (F.col("k") * (F.col("k") - 1))).alias("observed"), F.sum("same").alias("s"), F.sum(F.col("k") * (F.col("k") - 1)).alias("t"))
    share = n.join(per.select(item), item, "left_semi").groupBy(label).agg(F.sum("n").alias("n"))
    total = share.agg(F.sum("n").alias("all"), F.sum(F.col("n") * F.col("n")).alias("sq")).select((F.col("sq") / (F.col("all") * F.col("all"))).alias("chance"))
    j = p.withColumn("chance", total.scalar())
    kappa = F.when(F.col("chance") < 1, (F.col("observed") - F.col("chance")) / (1 - F.col("chance")))
    return j.select("items", F.round("unanimous", 6).alias("unanimous_rate"), F.round(F.col("s") / F.col("t"), 6).alias("pairwise_rate"), F.round(kappa, 6).alias("kappa"))


def score(core: Column, claims: Column, grounding: Column, relations: Column, prohibited: Column) -> Column:
    """A judgment's score between 0 and 100."""
    s = 40 * core + 30 * claims + 15 * grounding + 15 * relations - F.least(F.lit(40), 20 * prohibited)
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), s))


def score_label(s: Column) -> Column:
    return F.when(s >= 85, "correct").when(s >= 50, "partial").otherwise("incorrect")


# ---------------------------------------------------------------- event reduction


def merge_by_identity(events: DataFrame, identity: list[str], fields: list[str]) -> DataFrame:
    """One row an identity: each field's only value, and which fields conflict (several values, nulls ignored)."""
    aggs = [one_value(F.col(f)).alias(f) for f in fields] + [(F.countDistinct(f) > 1).alias(f"{f}_conflict") for f in fields]
    return events.groupBy(*identity).agg(F.count("*").alias("n"), *aggs)


def sessions_by_gap(events: DataFrame, key: str, ts: str, gap_s: int) -> DataFrame:
    """Batch form of an idle timeout: (key, session, begin, end, n); a gap of ``gap_s`` or more begins another session.

    ``session_window`` keeps partial state per key on the map side, so a hot key isn't one sorted task."""
    w = F.session_window(ts, f"{gap_s} seconds")
    return events.filter(F.col(ts).isNotNull()).groupBy(key, w.alias("w")).agg(F.count("*").alias("n"), F.min(ts).alias("begins"), F.max(ts).alias("ends")).drop("w")


def accepted_lines(lines: DataFrame, line_no: str, accepted: int) -> DataFrame:
    return lines.withColumn("tail", F.col(line_no) > accepted)


# ---------------------------------------------------------------- mapped inputs


def _runs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "index_runs").distinct()


def _changes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "file_changes").distinct()


def _events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events")


# ---------------------------------------------------------------- queries over changes and runs


def latest_state(changes: DataFrame) -> DataFrame:
    """The tree after all changes: the last record of each path, deleted ones gone."""
    last = F.struct("walked_at_ms", "change_id")
    g = changes.groupBy("repository_root", "file_path").agg(F.max_by("change_kind", last).alias("kind"), F.max_by("mtime_ns", last).alias("mtime_ns"), F.max_by("content_hash", last).alias("content_hash"))
    return g.filter("kind <> 'delete'").drop("kind")


def a19_current_tree(spark, d):
    return latest_state(_changes(spark, d))


def _first_ok(spark, d):
    return _runs(spark, d).filter("status = 'ok'").groupBy("repository_root").agg(F.min("started_at_ms").alias("at"))


def c13_mtime_diff(spark, d):
    """What the first good index of each root lacks or still holds against the tree now: index where missing or of any
    other modification time, delete where gone."""
    c = _changes(spark, d)
    old = latest_state(c.join(_first_ok(spark, d), "repository_root").filter("walked_at_ms <= at").drop("at")).select("repository_root", "file_path", F.col("mtime_ns").alias("old"), F.lit(1).alias("had"))
    new = latest_state(c.join(_first_ok(spark, d).select("repository_root"), "repository_root", "left_semi")).select("repository_root", "file_path", F.col("mtime_ns").alias("new"), F.lit(1).alias("has"))
    j = old.join(new, ["repository_root", "file_path"], "full")
    action = F.when(F.col("has").isNull(), "delete").when(F.col("had").isNull() | ~F.col("old").eqNullSafe(F.col("new")), "index")
    return j.select("repository_root", "file_path", action.alias("action")).filter("action is not null")


def c14_subtree_deletes(spark, d):
    """Directories that were deleted as a path, and the files below them that go with them."""
    c = _changes(spark, d)
    dirs = c.filter("change_kind = 'delete'").select("repository_root", F.col("file_path").alias("gone")).distinct()
    live = latest_state(c).select("repository_root", "file_path")
    # ancestors make the prefix an equality, so no theta join is needed
    from quarrylens.functions.text import ancestors

    below = live.select("repository_root", "file_path", F.explode(ancestors(F.col("file_path"))).alias("gone"))
    return below.join(dirs, ["repository_root", "gone"], "left_semi").select("repository_root", "file_path").distinct()


def b19_event_classes(spark, d):
    """Watch events by class: ignored, head hints, root events and candidates."""
    p = F.col("file_path")
    cls = F.when(p.rlike(r"(?:^|/)\.git/(?:HEAD|refs/.*)$"), "git hint").when(p.rlike(r"(?:^|/)(?:\.git|\.svn|\.hg|node_modules)(?:/|$)"), "ignored").when(p == "", "root").otherwise("candidate")
    return _changes(spark, d).select("change_id", cls.alias("class"))


def b20_attempt_classes(spark, d):
    """Runs by the first rule that holds."""
    c = F.when(F.col("status") == "crashed", "signal").when((F.col("status") == "failed") & F.col("built_at_ms").isNull(), "protocol").when(F.col("status") == "failed", "transient")
    c = c.when(F.col("built_at_ms") < F.col("started_at_ms"), "invariant").when(F.col("file_count") == 0, "empty").otherwise("stop")
    return _runs(spark, d).select("run_id", c.alias("category"))


def c21_superseded_runs(spark, d):
    """Every run of a root with the latest one, and whether it is superseded."""
    r = _runs(spark, d)
    last = r.groupBy("repository_root").agg(F.max_by("run_id", F.struct("started_at_ms", "run_id")).alias("latest"))
    return r.join(last, "repository_root").select("run_id", "latest", (F.col("run_id") != F.col("latest")).alias("superseded"))


def d24_attempt_accounting(spark, d):
    s = F.col("status")
    return _runs(spark, d).groupBy("repo").agg(F.count("*").alias("n"), F.count(F.when(s == "ok", 1)).alias("ok"), F.count(F.when(s == "failed", 1)).alias("failed"), F.count(F.when(s == "crashed", 1)).alias("crashed"))


def e12_latest_ok_run(spark, d):
    return _runs(spark, d).filter("status = 'ok'").groupBy("repository_root").agg(F.max_by("run_id", F.struct("started_at_ms", "run_id")).alias("run_id"))


def j6_stale_builds(spark, d):
    """Per root: is its newest build older, against its newest change, than its repository allows."""
    b = _runs(spark, d).filter("status = 'ok'").groupBy("repository_root", "repo").agg(F.max("built_at_ms").alias("built"))
    n = _changes(spark, d).groupBy("repository_root").agg(F.max("walked_at_ms").alias("now"))
    conf = table(spark, d, "resolved_configs").select("repo", "index_staleness_ms")
    return b.join(n, "repository_root").join(conf, "repo").select("repository_root", (F.col("now") - F.col("built") >= F.col("index_staleness_ms")).alias("stale"))


def l11_slot_states(spark, d):
    """Next action of each root by the ordered rules over its latest run."""
    r = _runs(spark, d)
    last = F.struct("started_at_ms", "run_id")
    g = r.groupBy("repository_root").agg(F.count("*").alias("attempts"), F.max_by("status", last).alias("status"), F.max_by("fingerprint", last).alias("fingerprint"))
    a = F.when((F.col("status") == "ok") & F.col("fingerprint").isNotNull(), "skip").when(F.col("status") == "ok", "resume").when(F.col("attempts") >= 12, "stop").otherwise("replace")
    return g.select("repository_root", "attempts", a.alias("action"))


def l13_unchanged_runs(spark, d):
    """Good runs over an unchanged tree: the fingerprint equals that of the good run before."""
    r = previous_row(_runs(spark, d).filter("status = 'ok'"), ["repository_root"], ["started_at_ms", "run_id"], ["fingerprint"], "before")
    return r.filter("before.fingerprint = fingerprint").select("run_id")


def j2_escalated_batches(spark, d):
    """Change batches (half-second windows of a root) and whether one calls for a full refresh: over 1,024 paths."""
    b = _changes(spark, d).groupBy("repository_root", F.expr("walked_at_ms div 500").alias("batch")).agg(F.countDistinct("file_path").alias("n_paths"))
    return b.withColumn("full_refresh", F.col("n_paths") > 1024)


def j9_tail_records(spark, d):
    """Changes after each root's last good run: excluded, but counted."""
    last = _runs(spark, d).filter("status = 'ok'").groupBy("repository_root").agg(F.max("started_at_ms").alias("at"))
    c = _changes(spark, d).join(last, "repository_root", "left")
    return c.groupBy("repository_root").agg(F.count(F.when(F.col("walked_at_ms") <= F.col("at"), 1)).alias("accepted"), F.count(F.when(~F.coalesce(F.col("walked_at_ms") <= F.col("at"), F.lit(False)), 1)).alias("tail"))


def l6_merged_changes(spark, d):
    """Change records merged per (root, path, time): conflicts where several kinds or hashes meet."""
    m = merge_by_identity(_changes(spark, d).select("repository_root", "file_path", "walked_at_ms", "change_kind", "content_hash"), ["repository_root", "file_path", "walked_at_ms"], ["change_kind", "content_hash"])
    return m.select("repository_root", "file_path", "walked_at_ms", "n", "change_kind", "change_kind_conflict", "content_hash_conflict")


# ---------------------------------------------------------------- queries over the event stream

def a12_event_source(spark, d):
    """Event lines with their parsed field; lines that don't parse keep null."""
    return _events(spark, d).select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


def c12_capped_records(spark, d):
    """At most 64 events per (user, type), the earliest."""
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    return _events(spark, d).withColumn("rn", F.row_number().over(w)).filter("rn <= 64").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.max("event_id").alias("last_id"))


def c20_paired_deltas(spark, d):
    """Mean value of views against purchases per user, and their difference; null where one side is missing."""
    a = lambda t: F.avg(F.when(F.col("event_type") == t, F.col("value")))
    g = _events(spark, d).groupBy("user_id").agg(a("view").alias("a"), a("purchase").alias("b"))
    return g.select("user_id", F.round("a", 6).alias("a"), F.round("b", 6).alias("b"), F.round(F.col("b") - F.col("a"), 6).alias("delta"))


def d13_tally(spark, d):
    """Events by a fixed list of types, absent ones with zero, others together."""
    types = spark.createDataFrame([("view",), ("click",), ("purchase",), ("signup",), ("refund",), ("other",)], "event_type string")
    e = _events(spark, d).select(F.when(F.col("event_type").isin("view", "click", "purchase", "signup", "refund"), F.col("event_type")).otherwise("other").alias("event_type"))
    n = e.groupBy("event_type").agg(F.count("*").alias("n"))
    return types.join(n, "event_type", "left").select("event_type", F.coalesce("n", F.lit(0)).alias("n"))


def d15_repeated_searches(spark, d):
    """Searches that repeat the same words in any order, within a repository."""
    words = F.array_join(F.array_sort(F.filter(F.split(F.lower("search_text"), r"\W+"), lambda w: F.length(w) > 0)), " ")
    g = table(spark, d, "search_results").select("repo", words.alias("words"), "result_id").groupBy("words").agg(F.count("*").alias("n"), F.countDistinct("repo").alias("n_repos"))
    return g.filter("n >= 2").select("words", "n", (F.col("n_repos") == 1).alias("same_scope"))


def d16_unbounded_reads(spark, d):
    """Search hits of files without a line count or of unknown score: how many, and their lines where all are known."""
    r = table(spark, d, "search_results").filter("score is null or symbol_fallback")
    return r.groupBy("repo").agg(F.count("*").alias("n"), known_sum(F.col("total_lines")).alias("lines"))


def d18_numeric_summary(spark, d):
    return numeric_summary(table(spark, d, "search_results"), ["repo"], "score")


def d19_macro_means(spark, d):
    """Mean of repositories' means against the mean over all rows."""
    r = table(spark, d, "search_results")
    per = r.groupBy("repo").agg(F.sum("score").alias("s"), F.count("score").alias("n"), F.avg("score").alias("m"))
    return per.agg(F.round(F.avg("m"), 6).alias("macro_mean"), F.round(F.sum("s") / F.sum("n"), 6).alias("weighted_mean"), F.count("m").alias("n_groups"))


def d22_variance_warnings(spark, d):
    """Warnings on paired deltas per event bucket: mixed signs, deviation over the mean, leave-one-out sign flips, few pairs."""
    e = c20_paired_deltas(spark, d).filter("delta is not null").withColumn("bucket", F.col("user_id") % 10)
    g = e.groupBy("bucket").agg(F.count("*").alias("n"), F.sum("delta").alias("s"), F.avg("delta").alias("m"), F.stddev_samp("delta").alias("sd"), F.min("delta").alias("lo"), F.max("delta").alias("hi"), F.median("delta").alias("med"))
    loo_lo, loo_hi = (F.col("s") - F.col("hi")) / (F.col("n") - 1), (F.col("s") - F.col("lo")) / (F.col("n") - 1)
    return g.select(
        "bucket",
        "n",
        ((F.col("lo") < 0) & (F.col("hi") > 0)).alias("mixed_sign"),
        (F.col("sd") >= F.abs("m")).alias("wide"),
        F.when(F.col("n") > 1, (F.signum(loo_lo) != F.signum("m")) | (F.signum(loo_hi) != F.signum("m"))).alias("flips"),
        (F.signum("m") != F.signum("med")).alias("skewed"),
        (F.col("n") < 3).alias("few"),
    )


def d23_scores(spark, d):
    """Scores and labels over parts as stand-ins for judgments: fractions from size and price, prohibited from the brand."""
    p = table(spark, d, "part")
    frac = lambda c, m: F.round((c % m) / (m - 1) * 2) / 2
    s = score(frac(F.col("p_size"), 3), frac(F.col("p_partkey"), 5), frac(F.col("p_partkey"), 3), frac(F.col("p_size"), 7), F.col("p_partkey") % 4)
    return p.select("p_partkey", s.alias("score"), score_label(s).alias("label"))


def e10_switches(spark, d):
    """Per user: how often the event type changes from one event to the next, and where the first purchase stands."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = _events(spark, d).select("user_id", "event_type", F.lag("event_type").over(w).alias("p"), F.row_number().over(w).alias("i"))
    return e.groupBy("user_id").agg(F.sum(F.when(F.col("p") != F.col("event_type"), 1).otherwise(0)).alias("switches"), F.min(F.when(F.col("event_type") == "purchase", F.col("i"))).alias("first_purchase"))


def e11_schedule(spark, d):
    """A balanced schedule: every task three times in both arms, the first arm alternating."""
    tasks = table(spark, d, "eval_items").select("task_id").distinct()
    n = tasks.withColumn("t", F.row_number().over(Window.orderBy("task_id")))  # one row a task: tens
    s = n.withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(2)))).withColumn("position", F.explode(F.sequence(F.lit(0), F.lit(1))))
    arm = F.when((F.col("t") + F.col("trial") + F.col("position")) % 2 == 0, "A").otherwise("B")
    return s.select("task_id", "trial", "position", arm.alias("arm"))


def e13_cost_after(spark, d):
    """Value of a user's events after the first refund-like one (a negative or lowest type), null where there is none."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = _events(spark, d).select("user_id", "event_type", "value", F.row_number().over(w).alias("i"))
    first = e.filter("event_type = 'signup'").groupBy("user_id").agg(F.min("i").alias("k"))
    return e.join(first, "user_id").filter("i > k").groupBy("user_id").agg(F.count("*").alias("n_after"), F.round(F.sum("value"), 4).alias("value_after"))


def e9_byte_budget(spark, d):
    """Literals of a file that fit a budget of 8,192 bytes in order, by the running sum."""
    l = table(spark, d, "literals").select("literal_id", "file_id", "text", "line").distinct()
    w = Window.partitionBy("file_id").orderBy("line", "literal_id").rowsBetween(Window.unboundedPreceding, 0)
    r = l.withColumn("used", F.sum(F.octet_length("text")).over(w))
    return r.groupBy("file_id").agg(F.count(F.when(F.col("used") <= 8192, 1)).alias("n_kept"), F.max(F.when(F.col("used") <= 8192, F.col("used"))).alias("bytes"), (F.max("used") > 8192).alias("cut"))


def e14_render_tiers(spark, d):
    """How much of each symbol is shown: the first three of a file whole, containers two lines, the rest one to three."""
    s = table(spark, d, "symbols").distinct()
    w = Window.partitionBy("file_id").orderBy(F.desc(F.coalesce("is_exported", F.lit(False))), "start_line", "symbol_id")
    r = s.withColumn("rn", F.row_number().over(w))
    n = F.col("end_line") - F.col("start_line") + 1
    lines = F.when(F.col("rn") <= 3, n).when(F.col("kind").isin("class", "struct"), F.least(n, F.lit(2))).when(F.col("rn") <= 10, F.least(n, F.lit(3))).otherwise(1)
    return r.select("symbol_id", lines.alias("lines_shown"))


def j8_event_reducer(spark, d):
    """Events reduced by user and type: how many, the first and last time, whether values conflict."""
    m = _events(spark, d).groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"), (F.countDistinct("value") > 1).alias("conflict"))
    return m


def j10_idle_sessions(spark, d):
    return sessions_by_gap(_events(spark, d), "user_id", "ts", 1800).select("user_id", "begins", "n")


def l1_boundary(spark, d):
    """Lines up to the accepted one and after it, unparsed ones apart; accepted is nine tenths of the lines."""
    e = a12_event_source(spark, d)
    n = e.agg(F.floor(F.max("event_id") * 0.9).alias("accepted"))
    j = e.withColumn("accepted", n.scalar())
    tail = F.col("event_id") > F.col("accepted")
    return j.agg(F.count(F.when(~tail, 1)).alias("accepted_lines"), F.count(F.when(tail, 1)).alias("tail_lines"), F.count(F.when(~tail & F.col("k").isNull(), 1)).alias("accepted_unparsed"), F.count(F.when(tail & F.col("k").isNull(), 1)).alias("tail_unparsed"))


def l3_field_equality(spark, d):
    """Fields of search hits against the files they name, null-safe: how many differ, field by field."""
    s = table(spark, d, "search_results").join(table(spark, d, "source_files").select("repo", "file_path", "file_id"), ["repo", "file_path"]).join(table(spark, d, "extracted_files").select("file_id", F.col("total_lines").alias("tl"), F.col("repo").alias("r2")), "file_id")
    pairs = F.array(F.struct(F.lit("total_lines").alias("field"), (F.col("total_lines").eqNullSafe(F.col("tl"))).alias("same")), F.struct(F.lit("repo").alias("field"), F.col("repo").eqNullSafe(F.col("r2")).alias("same")))
    return s.select(F.explode(pairs).alias("p")).groupBy("p.field").agg(F.count("*").alias("n"), F.count(F.when(~F.col("p.same"), 1)).alias("n_different"))


def sealed_files(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """(repo, state, n): the files (repo, path, content) against a manifest (repo, path, bytes, sha256): missing, not in the manifest, of
    another length, of other bytes, or sealed. Only hashes meet."""
    f = files.select("repo", "path", F.octet_length("content").alias("b"), F.sha2("content", 256).alias("h"))
    j = manifest.withColumn("listed", F.lit(1)).join(f.withColumn("there", F.lit(1)), ["repo", "path"], "full")
    state = F.when(F.col("there").isNull(), "missing").when(F.col("listed").isNull(), "not listed").when(~F.col("b").eqNullSafe(F.col("bytes")), "other length").when(~F.col("h").eqNullSafe(F.col("sha256")), "other bytes").otherwise("sealed")
    return j.groupBy("repo", state.alias("state")).agg(F.count("*").alias("n"))


def l5_sealed_files(spark, d):
    """Source files against a manifest of them with faults: each 41st file not listed, each 43rd of another length, each 47th of other bytes,
    and of each 53rd a listed copy that isn't there."""
    src = table(spark, d, "source_files").select("file_id", "repo", F.col("file_path").alias("path"), "content")
    i = F.col("file_id")
    m = src.select("file_id", "repo", "path", (F.octet_length("content") + F.when(i % 43 == 0, 1).otherwise(0)).alias("bytes"), F.sha2(F.when(i % 47 == 0, F.lower("repo")).otherwise(F.col("content")), 256).alias("sha256"))
    gone = m.filter(i % 53 == 0).withColumn("path", F.concat("path", F.lit(".old")))
    return sealed_files(m.filter(i % 41 != 0).unionByName(gone).drop("file_id"), src.drop("file_id"))


def l7_completed_calls(spark, d):
    """Runs that began and runs that built something: the symmetric difference, and an index by completion."""
    r = _runs(spark, d)
    done = r.filter("built_at_ms is not null")
    w = Window.partitionBy("repository_root").orderBy("built_at_ms", "run_id")
    i = done.withColumn("completion", F.row_number().over(w)).select("run_id", "completion")
    return r.join(i, "run_id", "left").select("run_id", "completion", F.col("completion").isNull().alias("incomplete"))


def l9_linked_results(spark, d):
    """Search hits that link to a file, its extraction and its tags, all conditions at once, by repository."""
    s = table(spark, d, "search_results").select("result_id", "repo", "file_path")
    f = table(spark, d, "source_files").select("repo", "file_path", "file_id")
    t = table(spark, d, "tags").select("repo", F.col("file").alias("file_path"), F.lit(True).alias("tagged")).distinct()
    e = table(spark, d, "extracted_files").select("file_id", (F.coalesce("symbol_count", F.lit(0)) > 0).alias("has_symbols"))
    j = s.join(f, ["repo", "file_path"], "left").join(t, ["repo", "file_path"], "left").join(e, "file_id", "left")
    ok = F.col("file_id").isNotNull() & F.coalesce("tagged", F.lit(False)) & F.coalesce("has_symbols", F.lit(False))
    return j.groupBy("repo").agg(F.count("*").alias("n"), F.count(F.when(ok, 1)).alias("n_linked"), F.every(ok).alias("all_linked"))


def l14_blinding(spark, d):
    """Documents whose text names a repository or a root path that must not show."""
    x = table(spark, d, "documents").filter("text is not null")
    hit = F.col("text").contains("/srv/mirror/") | F.col("text").rlike(r"\brun_id\b")
    return x.filter(hit).select("doc_id")


def i14_row_hashes(spark, d):
    """SHA-256 of canonical rows and their byte lengths."""
    r = table(spark, d, "search_results")
    canon = F.to_json(F.struct("file_path", "repo", "result_id", "symbol_fallback"), {"ignoreNullFields": "false"})  # keys in order
    return r.select("result_id", F.sha2(canon, 256).alias("hash"), F.octet_length(canon).alias("bytes"))


def i15_scope_signatures(spark, d):
    """The key that a search is told apart by: its repository, else the first part of the path."""
    r = table(spark, d, "search_results")
    return r.select("result_id", F.coalesce(F.nullif("repo", F.lit("")), F.split("file_path", "/")[0]).alias("scope"))


def i16_tool_families(spark, d):
    """Kinds of tags folded into families by whole name or suffix."""
    k = F.lower("kind")
    fam = F.when((k == "function") | k.endswith("_function") | (k == "method"), "callable").when(k.isin("class", "struct", "interface", "enum"), "type").when(k.rlike("^(?:const|constant|variable|property|field)"), "value").otherwise("other")
    return table(spark, d, "tags").distinct().groupBy("kind", fam.alias("family")).agg(F.count("*").alias("n"))


def i20_opaque_ids(spark, d):
    """Search hits with paths redacted to their last part and an opaque id."""
    r = table(spark, d, "search_results")
    return r.select(F.substring(F.sha2(F.concat_ws(":", F.lit("salt"), "result_id"), 256), 1, 16).alias("opaque"), F.regexp_replace("file_path", r"^.*/", "<path>/").alias("shown"))


def b21_permissions(spark, d):
    """Changes allowed by profile: (kind, profile) against a small table of rules."""
    rules = spark.createDataFrame([("upsert", "write", True), ("upsert", "read", False), ("delete", "write", False), ("delete", "read", False)], "change_kind string, profile string, allowed boolean")
    return _changes(spark, d).join(F.broadcast(rules), "change_kind").groupBy("profile", "allowed").agg(F.count("*").alias("n"))


def b23_read_bounds(spark, d):
    """Events as reads: bounded where the limit field is positive, malformed where it doesn't parse."""
    k = F.get_json_object("props", "$.k")
    n = F.expr("try_cast(get_json_object(props, '$.k') as bigint)")
    state = F.when(k.isNull(), "unbounded").when(n.isNull(), "malformed").when(n > 0, "bounded").otherwise("unbounded")
    return _events(spark, d).groupBy(state.alias("state")).agg(F.count("*").alias("n"))


_R, _C = "r as (select distinct * from index_runs)", "c as (select distinct * from file_changes)"
_LATEST = "select repository_root, file_path, mtime_ns, content_hash from (select *, row_number() over (partition by repository_root, file_path order by walked_at_ms desc, change_id desc) as rn from {0}) where rn = 1 and change_kind <> 'delete'"
_DELTA = "d as (select user_id, round(a, 6) as a, round(b, 6) as b, round(b - a, 6) as delta from (select user_id, avg(case when event_type = 'view' then value end) as a, avg(case when event_type = 'purchase' then value end) as b from events group by 1))"
_FRAC = "round(({0} % {1}) / ({1} - 1) * 2) / 2"
_SCORE = f"greatest(0.0, least(100.0, 40 * {_FRAC.format('p_size', 3)} + 30 * {_FRAC.format('p_partkey', 5)} + 15 * {_FRAC.format('p_partkey', 3)} + 15 * {_FRAC.format('p_size', 7)} - least(40, 20 * (p_partkey % 4))))"

QUERIES = {
    "a12_event_source": (a12_event_source, "select event_id, cast(json_extract_string(props, '$.k') as bigint) as k from events"),
    "a19_current_tree": (a19_current_tree, f"with {_C} {_LATEST.format('c')}"),
    "b19_event_classes": (b19_event_classes, f"with {_C} select change_id, case when regexp_matches(file_path, '(?:^|/)\\.git/(?:HEAD|refs/.*)$') then 'git hint' when regexp_matches(file_path, '(?:^|/)(?:\\.git|\\.svn|\\.hg|node_modules)(?:/|$)') then 'ignored' when file_path = '' then 'root' else 'candidate' end as class from c"),
    "b20_attempt_classes": (b20_attempt_classes, f"with {_R} select run_id, case when status = 'crashed' then 'signal' when status = 'failed' and built_at_ms is null then 'protocol' when status = 'failed' then 'transient' when built_at_ms < started_at_ms then 'invariant' when file_count = 0 then 'empty' else 'stop' end as category from r"),
    "b21_permissions": (b21_permissions, f"with {_C}, rules(change_kind, profile, allowed) as (values ('upsert', 'write', true), ('upsert', 'read', false), ('delete', 'write', false), ('delete', 'read', false)) select profile, allowed, count(*) as n from c join rules using (change_kind) group by 1, 2"),
    "b23_read_bounds": (b23_read_bounds, "select case when k is null then 'unbounded' when n is null then 'malformed' when n > 0 then 'bounded' else 'unbounded' end as state, count(*) as n from (select json_extract_string(props, '$.k') as k, try_cast(json_extract_string(props, '$.k') as bigint) as n from events) group by 1"),
    "c12_capped_records": (c12_capped_records, "select user_id, event_type, count(*) as n, max(event_id) as last_id from (select *, row_number() over (partition by user_id, event_type order by ts, event_id) as rn from events) where rn <= 64 group by 1, 2"),
    "c13_mtime_diff": (c13_mtime_diff, f"with {_R}, {_C}, ok as (select repository_root, min(started_at_ms) as at_ms from r where status = 'ok' group by 1), c1 as (select c.* from c join ok using (repository_root) where walked_at_ms <= at_ms), c2 as (select c.* from c where repository_root in (select repository_root from ok)), o as ({_LATEST.format('c1')}), n as ({_LATEST.format('c2')}) select * from (select repository_root, file_path, case when n.content_hash is null and n.file_path is null then 'delete' when o.file_path is null or o.mtime_ns is distinct from n.mtime_ns then 'index' end as action from o full join n using (repository_root, file_path)) where action is not null".replace("n.content_hash is null and n.file_path is null", "n.repository_root is null").replace("o.file_path is null or", "o.repository_root is null or")),
    "c14_subtree_deletes": (c14_subtree_deletes, f"with {_C}, l as ({_LATEST.format('c')}) select distinct l.repository_root, l.file_path from l join (select distinct repository_root, file_path as gone from c where change_kind = 'delete') g on g.repository_root = l.repository_root and starts_with(l.file_path, g.gone || '/')"),
    "c20_paired_deltas": (c20_paired_deltas, f"with {_DELTA} select * from d"),
    "c21_superseded_runs": (c21_superseded_runs, f"with {_R} select run_id, latest, run_id <> latest as superseded from (select run_id, first_value(run_id) over (partition by repository_root order by started_at_ms desc, run_id desc) as latest from r)"),
    "d13_tally": (d13_tally, "with t(event_type) as (values ('view'), ('click'), ('purchase'), ('signup'), ('refund'), ('other')) select t.event_type, count(e.event_id) as n from t left join (select event_id, case when event_type in ('view', 'click', 'purchase', 'signup', 'refund') then event_type else 'other' end as event_type from events) e using (event_type) group by 1"),
    "d15_repeated_searches": (d15_repeated_searches, "select words, n, n_repos = 1 as same_scope from (select array_to_string(list_sort(list_filter(string_split_regex(lower(search_text), '\\W+'), lambda w: length(w) > 0)), ' ') as words, count(*) as n, count(distinct repo) as n_repos from search_results group by 1) where n >= 2"),
    "d16_unbounded_reads": (d16_unbounded_reads, "select repo, count(*) as n, case when count(total_lines) = count(*) then cast(sum(total_lines) as bigint) end as lines from search_results where score is null or symbol_fallback group by 1"),
    "d18_numeric_summary": (d18_numeric_summary, "select repo, count(score) as valid_n, count(*) - count(score) as missing_n, count(*) as denominator_n, round(avg(score), 6) as mean, round(stddev_samp(score), 6) as sd from search_results group by 1"),
    "d19_macro_means": (d19_macro_means, "select round(avg(m), 6) as macro_mean, round(sum(s) / sum(n), 6) as weighted_mean, count(m) as n_groups from (select sum(score) as s, count(score) as n, avg(score) as m from search_results group by repo)"),
    "d22_variance_warnings": (d22_variance_warnings, f"with {_DELTA}, g as (select user_id % 10 as bucket, count(*) as n, sum(delta) as s, avg(delta) as m, stddev_samp(delta) as sd, min(delta) as lo, max(delta) as hi, median(delta) as med from d where delta is not null group by 1) select bucket, n, lo < 0 and hi > 0 as mixed_sign, sd >= abs(m) as wide, case when n > 1 then sign((s - hi) / (n - 1)) <> sign(m) or sign((s - lo) / (n - 1)) <> sign(m) end as flips, sign(m) <> sign(med) as skewed, n < 3 as few from g"),
    "d23_scores": (d23_scores, f"select p_partkey, {_SCORE} as score, case when {_SCORE} >= 85 then 'correct' when {_SCORE} >= 50 then 'partial' else 'incorrect' end as label from part"),
    "d24_attempt_accounting": (d24_attempt_accounting, f"with {_R} select repo, count(*) as n, count(*) filter (status = 'ok') as ok, count(*) filter (status = 'failed') as failed, count(*) filter (status = 'crashed') as crashed from r group by 1"),
    "e9_byte_budget": (e9_byte_budget, "select file_id, count(*) filter (used <= 8192) as n_kept, cast(max(case when used <= 8192 then used end) as bigint) as bytes, max(used) > 8192 as cut from (select file_id, sum(strlen(text)) over (partition by file_id order by line, literal_id rows unbounded preceding) as used from (select distinct literal_id, file_id, text, line from literals)) group by 1"),
    "e10_switches": (e10_switches, "select user_id, cast(sum(case when p <> event_type then 1 else 0 end) as bigint) as switches, cast(min(case when event_type = 'purchase' then i end) as int) as first_purchase from (select user_id, event_type, lag(event_type) over w as p, row_number() over w as i from events window w as (partition by user_id order by ts, event_id)) group by 1"),
    "e11_schedule": (e11_schedule, "with t as (select task_id, row_number() over (order by task_id) as t from (select distinct task_id from eval_items)) select task_id, trial, position, case when (t + trial + position) % 2 = 0 then 'A' else 'B' end as arm from t, range(3) a(trial), range(2) b(position)"),
    "e12_latest_ok_run": (e12_latest_ok_run, f"with {_R} select repository_root, run_id from (select *, row_number() over (partition by repository_root order by started_at_ms desc, run_id desc) as rn from r where status = 'ok') where rn = 1"),
    "e13_cost_after": (e13_cost_after, "with e as (select *, row_number() over (partition by user_id order by ts, event_id) as i from events), f as (select user_id, min(i) as k from e where event_type = 'signup' group by 1) select user_id, count(*) as n_after, round(sum(value), 4) as value_after from e join f using (user_id) where i > k group by 1"),
    "e14_render_tiers": (e14_render_tiers, "with s as (select distinct * from symbols), r as (select *, row_number() over (partition by file_id order by coalesce(is_exported, false) desc, start_line, symbol_id) as rn, end_line - start_line + 1 as n from s) select symbol_id, case when rn <= 3 then n when kind in ('class', 'struct') then least(n, 2) when rn <= 10 then least(n, 3) else 1 end as lines_shown from r"),
    "i14_row_hashes": (i14_row_hashes, "select result_id, sha256(x) as hash, strlen(x) as bytes from (select result_id, cast(json_object('file_path', file_path, 'repo', repo, 'result_id', result_id, 'symbol_fallback', symbol_fallback) as varchar) as x from search_results)"),
    "i15_scope_signatures": (i15_scope_signatures, "select result_id, coalesce(nullif(repo, ''), string_split(file_path, '/')[1]) as scope from search_results"),
    "i16_tool_families": (i16_tool_families, "select kind, case when lower(kind) = 'function' or ends_with(lower(kind), '_function') or lower(kind) = 'method' then 'callable' when lower(kind) in ('class', 'struct', 'interface', 'enum') then 'type' when regexp_matches(lower(kind), '^(?:const|constant|variable|property|field)') then 'value' else 'other' end as family, count(*) as n from (select distinct * from tags) group by 1, 2"),
    "i20_opaque_ids": (i20_opaque_ids, "select left(sha256('salt:' || result_id), 16) as opaque, regexp_replace(file_path, '^.*/', '<path>/') as shown from search_results"),
    "j2_escalated_batches": (j2_escalated_batches, f"with {_C} select repository_root, walked_at_ms // 500 as batch, count(distinct file_path) as n_paths, count(distinct file_path) > 1024 as full_refresh from c group by 1, 2"),
    "j6_stale_builds": (j6_stale_builds, f"with {_R}, {_C}, b as (select repository_root, repo, max(built_at_ms) as built from r where status = 'ok' group by 1, 2), n as (select repository_root, max(walked_at_ms) as now from c group by 1) select repository_root, now - built >= index_staleness_ms as stale from b join n using (repository_root) join resolved_configs using (repo)"),
    "j8_event_reducer": (j8_event_reducer, "select user_id, event_type, count(*) as n, min(event_id) as first_id, max(event_id) as last_id, count(distinct value) > 1 as conflict from events group by 1, 2"),
    "j9_tail_records": (j9_tail_records, f"with {_R}, {_C}, l as (select repository_root, max(started_at_ms) as at_ms from r where status = 'ok' group by 1) select repository_root, count(*) filter (walked_at_ms <= at_ms) as accepted, count(*) filter (not coalesce(walked_at_ms <= at_ms, false)) as tail from c left join l using (repository_root) group by 1"),
    "j10_idle_sessions": (j10_idle_sessions, "with e as (select *, case when lag(ts) over (partition by user_id order by ts, event_id) is null or ts - lag(ts) over (partition by user_id order by ts, event_id) >= interval 30 minute then 1 else 0 end as nw from events where ts is not null), s as (select *, sum(nw) over (partition by user_id order by ts, event_id rows unbounded preceding) as sid from e) select user_id, min(ts) as begins, count(*) as n from s group by user_id, sid"),
    "l1_boundary": (l1_boundary, "with e as (select event_id, cast(json_extract_string(props, '$.k') as bigint) as k, floor((select max(event_id) from events) * 0.9) as a from events) select count(*) filter (event_id <= a) as accepted_lines, count(*) filter (event_id > a) as tail_lines, count(*) filter (event_id <= a and k is null) as accepted_unparsed, count(*) filter (event_id > a and k is null) as tail_unparsed from e"),
    "l3_field_equality": (l3_field_equality, "with j as (select r.total_lines is not distinct from e.total_lines as a, r.repo is not distinct from e.repo as b from search_results r join source_files s on s.repo = r.repo and s.file_path = r.file_path join extracted_files e using (file_id)) select 'total_lines' as field, count(*) as n, count(*) filter (not a) as n_different from j union all select 'repo', count(*), count(*) filter (not b) from j"),
    "l5_sealed_files": (l5_sealed_files, "select repo, case when file_id % 41 = 0 then 'not listed' when file_id % 43 = 0 and content is not null then 'other length' when file_id % 47 = 0 and sha256(content) is distinct from sha256(lower(repo)) then 'other bytes' else 'sealed' end as state, count(*) as n from source_files group by 1, 2 union all select repo, 'missing', count(*) from source_files where file_id % 53 = 0 group by 1"),
    "l6_merged_changes": (l6_merged_changes, f"with {_C} select repository_root, file_path, walked_at_ms, count(*) as n, case when count(distinct change_kind) = 1 then min(change_kind) end as change_kind, count(distinct change_kind) > 1 as change_kind_conflict, count(distinct content_hash) > 1 as content_hash_conflict from c group by 1, 2, 3"),
    "l7_completed_calls": (l7_completed_calls, f"with {_R} select run_id, case when built_at_ms is not null then cast(row_number() over (partition by repository_root, built_at_ms is not null order by built_at_ms, run_id) as int) end as completion, built_at_ms is null as incomplete from r"),
    "l9_linked_results": (l9_linked_results, "with j as (select r.repo, s.file_id is not null and t.file is not null and coalesce(e.symbol_count, 0) > 0 as ok from search_results r left join source_files s on s.repo = r.repo and s.file_path = r.file_path left join (select distinct repo, file from tags) t on t.repo = r.repo and t.file = r.file_path left join extracted_files e on e.file_id = s.file_id) select repo, count(*) as n, count(*) filter (ok) as n_linked, bool_and(ok) as all_linked from j group by 1"),
    "l11_slot_states": (l11_slot_states, f"with {_R}, g as (select repository_root, count(*) over (partition by repository_root) as attempts, status, fingerprint, row_number() over (partition by repository_root order by started_at_ms desc, run_id desc) as rn from r) select repository_root, attempts, case when status = 'ok' and fingerprint is not null then 'skip' when status = 'ok' then 'resume' when attempts >= 12 then 'stop' else 'replace' end as action from g where rn = 1"),
    "l13_unchanged_runs": (l13_unchanged_runs, f"with {_R} select run_id from (select run_id, fingerprint, lag(fingerprint) over (partition by repository_root order by started_at_ms, run_id) as b from r where status = 'ok') where b = fingerprint"),
    "l14_blinding": (l14_blinding, "select doc_id from documents where contains(text, '/srv/mirror/') or regexp_matches(text, '\\brun_id\\b')"),
}
