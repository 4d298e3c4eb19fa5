"""Evidence of runs: token records against raw steps, cost of tool calls, paired sessions, judges, captured copies, final answers.

The operators take tables of lines, steps, calls and ratings; ``session_log`` and the functions beside it build such tables from the
``events`` table, one session a user, with the faults that the operators must tell (records lost, doubled, contradicting each other,
without a component, with a wrong total). Whatever a check can't prove is null, never zero. Every group is reduced by partial aggregates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylens.operators.events import agreement, known_sum
from quarrylens.session import table

COMPONENTS = ["input", "output", "reasoning", "cache_read", "cache_write"]

# ---------------------------------------------------------------- tables of a log


def session_log(spark: SparkSession, d: str) -> DataFrame:
    """(session, line, label, k, value, text): every event as a line of its session's log."""
    e = table(spark, d, "events")
    return e.select(F.col("user_id").alias("session"), F.col("event_id").alias("line"), F.col("event_type").alias("label"), F.get_json_object("props", "$.k").cast("long").alias("k"), "value", F.col("props").alias("text"))


def token_records(log: DataFrame) -> DataFrame:
    """(session, line, identity, components, total) of finished steps: purchases, two lines to a step. Each 97th line has a wrong total, each
    101st lacks a component."""
    p, line = log.filter("label = 'purchase'"), F.col("line")
    t = p.select(
        "session", "line", F.expr("line div 2").alias("identity"), F.col("k").alias("input"), (F.expr("line div 2") % 7).alias("output"), F.when(line % 101 != 0, F.expr("line div 2") % 3).alias("reasoning"),
        (F.expr("line div 2") % 5).alias("cache_read"), F.lit(0).cast("long").alias("cache_write"),
    )
    whole = F.col("k_sum") + F.expr("line div 2") % 7 + F.expr("line div 2") % 3 + F.expr("line div 2") % 5
    return t.withColumn("k_sum", F.col("input")).withColumn("total", whole + F.when(line % 97 == 0, 1).otherwise(0)).drop("k_sum")


def raw_steps(log: DataFrame) -> DataFrame:
    """(session, line, identity) of the same steps in the raw log, each 211th line lost and each 223rd under another identity."""
    line = F.col("line")
    return log.filter((F.col("label") == "purchase") & (line % 211 != 0)).select("session", "line", (F.expr("line div 2") + F.when(line % 223 == 0, 1_000_000).otherwise(0)).alias("identity"))


def tool_calls(log: DataFrame) -> DataFrame:
    """(session, identity, tool, input_bytes, output_bytes, elapsed_ms) of views, clicks and errors as completed calls; output unknown on each 89th
    line, elapsed time on each 83rd."""
    line = F.col("line")
    tool = F.concat(F.when(F.col("label") == "view", "fs_read").when(F.col("label") == "click", "index_search").otherwise("bash"), F.when(line % 2 == 0, "").otherwise("_file"))
    return log.filter("label in ('view', 'click', 'error')").select(
        "session", F.col("line").alias("identity"), tool.alias("tool"), F.octet_length("text").cast("long").alias("input_bytes"), F.when(line % 89 != 0, F.col("k")).alias("output_bytes"), F.when(line % 83 != 0, F.floor(F.col("value") * 10)).alias("elapsed_ms")
    )


# ---------------------------------------------------------------- operators


def matched_records(official: DataFrame, raw: DataFrame) -> DataFrame:
    """(session, n_matched, n_other_identity, n_only_official, n_only_raw, sets_equal): official records against raw steps by
    session and line; the sets are equal where every line is there on both sides under one identity."""
    o, r = official.select("session", "line", F.col("identity").alias("o")).distinct(), raw.select("session", "line", F.col("identity").alias("r")).distinct()
    j = o.join(r, ["session", "line"], "full")
    n = lambda c: F.count(F.when(c, 1))
    same = F.col("o").eqNullSafe(F.col("r"))
    g = j.groupBy("session").agg(
        n(same).alias("n_matched"), n(~same & F.col("o").isNotNull() & F.col("r").isNotNull()).alias("n_other_identity"), n(F.col("r").isNull()).alias("n_only_official"), n(F.col("o").isNull()).alias("n_only_raw"),
    )
    return g.withColumn("sets_equal", (F.col("n_other_identity") == 0) & (F.col("n_only_official") == 0) & (F.col("n_only_raw") == 0))


def token_steps(records: DataFrame) -> DataFrame:
    """One row a step (session, identity): its only values, whether records contradict each other, and whether the total is the sum of the
    five components (null where one is unknown)."""
    fields = [*COMPONENTS, "total"]
    g = records.groupBy("session", "identity").agg(
        F.count("*").alias("n_records"), F.count_distinct(F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in fields])).alias("n_values"), *[F.min(c).alias(c) for c in fields], *[(F.count(c) == F.count("*")).alias(f"{c}_known") for c in fields],
    )
    conflict = F.col("n_values") > 1
    kept = g.select("session", "identity", "n_records", conflict.alias("conflict"), *[F.when(~conflict & F.col(f"{c}_known"), F.col(c)).alias(c) for c in fields])
    total = sum((F.col(c) for c in COMPONENTS[1:]), F.col(COMPONENTS[0]))
    return kept.withColumn("total_matches", F.col("total") == total)


def token_totals(steps: DataFrame) -> DataFrame:
    """Per session the five components and the total, each null unless every step is whole: no contradiction, no unknown component, no
    total that differs from its components."""
    whole = F.every(~F.col("conflict") & F.coalesce("total_matches", F.lit(False)))
    return steps.groupBy("session").agg(F.count("*").alias("n_steps"), whole.alias("complete"), *[F.when(whole, F.sum(c)).alias(c) for c in [*COMPONENTS, "total"]])


# fixed values: families of tools, met by the whole name or by its end after an underscore
FAMILIES = {"read": ["read", "read_file"], "search": ["search", "search_file", "grep"], "shell": ["bash", "bash_file"]}


def family_of(tool: Column) -> Column:
    out = None
    for family, names in FAMILIES.items():
        hit = tool.isin(names)
        for n in names:
            hit = hit | tool.endswith(f"_{n}")
        out = F.when(hit, family) if out is None else out.when(hit, family)
    return out.otherwise("other")


def tool_cost(calls: DataFrame) -> DataFrame:
    """Per session and tool family: calls, bytes in and out, elapsed milliseconds; a sum is null where one of its session's values is."""
    c = calls.withColumn("family", family_of(F.col("tool")))
    sums = {"input_bytes": "input", "output_bytes": "output", "elapsed_ms": "elapsed"}
    valid = lambda x: F.when(F.col(x) >= 0, F.col(x))
    per = c.groupBy("session", "family").agg(F.count("*").alias("n_calls"), *[known_sum(valid(x)).alias(n) for x, n in sums.items()])
    known = c.groupBy("session").agg(*[(F.count(valid(x)) == F.count("*")).alias(f"{n}_known") for x, n in sums.items()])
    return per.join(known, "session").select("session", "family", "n_calls", *[F.when(F.col(f"{n}_known"), F.col(n)).alias(n) for n in sums.values()])


def paired_sessions(sessions: DataFrame, metric: str) -> DataFrame:
    """(task, trial, a, b, delta) of sessions (task, trial, arm, metric): the arms' sums side by side, delta = b - a; null where an arm is
    missing or a value unknown."""
    arm = lambda x: F.when(F.count(F.when(F.col("arm") == x, 1)) == F.count(F.when(F.col("arm") == x, F.col(metric))), F.sum(F.when(F.col("arm") == x, F.col(metric))))
    g = sessions.groupBy("task", "trial").agg(arm("A").alias("a"), arm("B").alias("b"))
    return g.withColumn("delta", F.col("b") - F.col("a"))


def majority_of_three(ratings: DataFrame, item: str, label: str, valid: list[str]) -> DataFrame:
    """(item, majority, failed): the label of two of three raters. Another number of raters or a label outside ``valid`` fails the item;
    three different labels give null."""
    counts = ratings.groupBy(item, label).agg(F.count("*").alias("n"))
    g = counts.groupBy(item).agg(F.sum("n").alias("all"), F.max_by(label, "n").alias("top"), F.max("n").alias("most"), F.every(F.coalesce(F.col(label).isin(valid), F.lit(False))).alias("ok"))
    failed = ~F.col("ok") | (F.col("all") != 3)
    return g.select(item, F.when(~failed & (F.col("most") >= 2), F.col("top")).alias("majority"), failed.alias("failed"))


def score_difference(ratings: DataFrame, item: str, value: str) -> DataFrame:
    """(n_pairs, mean_abs_difference) over all pairs of raters of an item; an item has few raters."""
    v = ratings.groupBy(item).agg(F.array_sort(F.collect_list(value)).alias("v")).filter(F.size("v") >= 2)
    # in ascending order the i-th of n values is added i times and taken off n - 1 - i times
    n = F.size("v")
    total = F.aggregate(F.transform("v", lambda x, i: x * (2 * i - (n - 1))), F.lit(0.0), lambda a, x: a + x)
    return v.select(total.alias("s"), (n * (n - 1) / 2).alias("p")).agg(F.sum("p").cast("long").alias("n_pairs"), F.round(F.sum("s") / F.sum("p"), 6).alias("mean_abs_difference"))


def copied_lines(raw: DataFrame, copy: DataFrame) -> DataFrame:
    """(session, n_raw, n_copy, n_missing, n_extra, n_changed, same_digest) of a log and its copy (session, line, text): counts, lines compared by
    their hashes, and the digest over all line hashes in order."""
    h = lambda df, n: df.select("session", "line", F.sha2("text", 256).alias(n))
    j = h(raw, "a").join(h(copy, "b"), ["session", "line"], "full")
    n = lambda c: F.count(F.when(c, 1))
    digest = lambda c: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("line", c)))), lambda x: x[c]), ""), 256)
    return j.groupBy("session").agg(
        F.count("a").alias("n_raw"), F.count("b").alias("n_copy"), n(F.col("b").isNull()).alias("n_missing"), n(F.col("a").isNull()).alias("n_extra"), n(F.col("a") != F.col("b")).alias("n_changed"), (digest("a") == digest("b")).alias("same_digest"),
    )


CAPTURE_LIMIT = 4096


def capture_accounts(captures: DataFrame, limit: int = CAPTURE_LIMIT) -> DataFrame:
    """Of streams (session, observed, kept, dropped, file_bytes): does what was seen equal what was kept and dropped, is the file as long as what
    was kept, is the sum within the limit, does the flag say that something was dropped. Null where a number is unknown."""
    c = captures
    return c.select("session", (F.col("observed") == F.col("kept") + F.col("dropped")).alias("adds_up"), (F.col("kept") == F.col("file_bytes")).alias("file_matches"), (F.col("kept") <= limit).alias("within_limit"), (F.col("dropped") > 0).alias("truncated"))


def final_answers(parts: DataFrame) -> DataFrame:
    """(session, answer) of text parts (session, line, message, status, text): the parts of the last message that stopped, in the order of
    their first lines, joined. Sessions without one have no row."""
    last = parts.filter("status = 'stop'").groupBy("session").agg(F.max_by("message", "line").alias("message"))
    own = parts.join(last, ["session", "message"]).groupBy("session", "message", "text").agg(F.min("line").alias("line"))
    return own.groupBy("session").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "").alias("answer"))


def answer_parts(log: DataFrame) -> DataFrame:
    """(session, line, message, status, text): sign-ups as text parts, a message each 500 lines, stopping where its number is even."""
    return log.filter("label = 'signup'").select("session", "line", F.expr("line div 500").alias("message"), F.when(F.expr("line div 500") % 2 == 0, "stop").otherwise("tool").alias("status"), "text")


# ---------------------------------------------------------------- queries


def c19_token_totals_match(spark: SparkSession, d: str) -> DataFrame:
    log = session_log(spark, d)
    return matched_records(token_records(log), raw_steps(log))


def d17_component_totals(spark: SparkSession, d: str) -> DataFrame:
    return token_totals(token_steps(token_records(session_log(spark, d))))


def d14_tool_cost(spark: SparkSession, d: str) -> DataFrame:
    return tool_cost(tool_calls(session_log(spark, d)))


def _arms(spark: SparkSession, d: str) -> DataFrame:
    """Sessions as 14 tasks, three trials and two arms; the metric of a session is its known elapsed time."""
    c = tool_calls(session_log(spark, d)).groupBy("session").agg(known_sum(F.col("elapsed_ms")).alias("elapsed"))
    s = F.col("session")
    return c.select((s % 14).alias("task"), (F.expr("session div 14") % 3).alias("trial"), F.when(F.expr("session div 42") % 2 == 0, "A").otherwise("B").alias("arm"), "elapsed")


def c20_paired_sessions(spark: SparkSession, d: str) -> DataFrame:
    return paired_sessions(_arms(spark, d), "elapsed")


def _ratings(spark: SparkSession, d: str) -> DataFrame:
    """(item, label, score): three lines of a log in a row are the three judges of an item."""
    return session_log(spark, d).select(F.expr("line div 3").alias("item"), "label", F.col("value").alias("score"))


def d20_majority(spark: SparkSession, d: str) -> DataFrame:
    return majority_of_three(_ratings(spark, d), "item", "label", ["view", "click", "purchase", "signup"])


def d21_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Agreement of the judges: unanimous and pairwise rate, kappa, pairs and their mean score difference."""
    r = _ratings(spark, d)
    return agreement(r, "item", "label").crossJoin(score_difference(r, "item", "score"))  # one row each


def l2_copied_lines(spark: SparkSession, d: str) -> DataFrame:
    """The log against a copy that lost each 307th line and changed each 311th."""
    log = session_log(spark, d).select("session", "line", "text")
    copy = log.filter(F.col("line") % 307 != 0).withColumn("text", F.when(F.col("line") % 311 == 0, F.concat("text", F.lit(" "))).otherwise(F.col("text")))
    return copied_lines(log, copy)


def l4_capture_accounting(spark: SparkSession, d: str) -> DataFrame:
    """Streams of a session: its lines' bytes, kept up to a limit, the number unknown where the session's is a multiple of 17."""
    b = session_log(spark, d).groupBy("session").agg(F.sum(F.octet_length("text")).alias("observed"))
    kept = F.least("observed", F.lit(1000))
    c = b.select("session", "observed", kept.alias("kept"), F.when(F.col("session") % 17 != 0, F.col("observed") - kept + F.when(F.col("session") % 19 == 0, 1).otherwise(0)).alias("dropped"), (kept - F.when(F.col("session") % 23 == 0, 1).otherwise(0)).alias("file_bytes"))
    return capture_accounts(c)


def l8_final_answers(spark: SparkSession, d: str) -> DataFrame:
    return final_answers(answer_parts(session_log(spark, d)))


_LOG = "log as (select user_id as session, event_id as line, event_type as label, cast(json_extract_string(props, '$.k') as bigint) as k, value, props as text from events)"
_TOK = "tok as (select session, line, line // 2 as identity, k as input, (line // 2) % 7 as output, case when line % 101 <> 0 then (line // 2) % 3 end as reasoning, (line // 2) % 5 as cache_read, 0 as cache_write, k + (line // 2) % 7 + (line // 2) % 3 + (line // 2) % 5 + case when line % 97 = 0 then 1 else 0 end as total from log where label = 'purchase')"
_CALLS = "calls as (select session, line as identity, case label when 'view' then 'read' when 'click' then 'search' else 'shell' end as family, strlen(text) as i, case when line % 89 <> 0 then k end as o, case when line % 83 <> 0 then floor(value * 10) end as e from log where label in ('view', 'click', 'error'))"

QUERIES = {
    "c19_token_totals_match": (c19_token_totals_match, f"""with {_LOG}, o as (select session, line, line // 2 as identity from log where label = 'purchase'), r as (select session, line, line // 2 + case when line % 223 = 0 then 1000000 else 0 end as identity from log where label = 'purchase' and line % 211 <> 0),
        lines as (select session, line from o union select session, line from r), x as (select lines.session, o.identity as a, r.identity as b from lines left join o using (session, line) left join r using (session, line))
        select session, count(*) filter (a = b) as n_matched, count(*) filter (a <> b) as n_other_identity, count(*) filter (b is null) as n_only_official, count(*) filter (a is null) as n_only_raw, count(*) filter (a = b) = count(*) as sets_equal from x group by 1"""),
    "d17_component_totals": (d17_component_totals, f"""with {_LOG}, {_TOK}, step as (select session, identity, count(distinct (coalesce(input, -1), coalesce(output, -1), coalesce(reasoning, -1), coalesce(cache_read, -1), coalesce(total, -1))) as v, count(*) as n, min(input) as input, min(output) as output, min(reasoning) as reasoning, min(cache_read) as cache_read, min(cache_write) as cache_write, min(total) as total,
        bool_and(input is not null and reasoning is not null and total is not null) as known from tok group by 1, 2), s as (select *, v = 1 and known and total = input + output + reasoning + cache_read + cache_write as whole from step)
        select session, count(*) as n_steps, bool_and(coalesce(whole, false)) as complete, {", ".join(f"cast(case when bool_and(coalesce(whole, false)) then sum({c}) end as bigint) as {c}" for c in [*COMPONENTS, "total"])} from s group by 1"""),
    "d14_tool_cost": (d14_tool_cost, f"""with {_LOG}, {_CALLS}, s as (select session, bool_and(i is not null) as ik, bool_and(o is not null) as ok, bool_and(e is not null) as ek from calls group by 1)
        select session, family, count(*) as n_calls, cast(case when any_value(ik) then sum(i) end as bigint) as input, cast(case when any_value(ok) then sum(o) end as bigint) as output, cast(case when any_value(ek) then sum(e) end as bigint) as elapsed from calls join s using (session) group by 1, 2"""),
    "c20_paired_sessions": (c20_paired_sessions, f"""with {_LOG}, {_CALLS}, s as (select session, case when count(e) = count(*) then sum(e) end as e from calls group by 1), p as (select session % 14 as task, (session // 14) % 3 as trial, (session // 42) % 2 as arm, e from s),
        g as (select task, trial, case when count(*) filter (arm = 0) = count(e) filter (arm = 0) then sum(e) filter (arm = 0) end as a, case when count(*) filter (arm = 1) = count(e) filter (arm = 1) then sum(e) filter (arm = 1) end as b from p group by 1, 2) select task, trial, cast(a as bigint) as a, cast(b as bigint) as b, cast(b - a as bigint) as delta from g"""),
    "d20_majority": (d20_majority, """with r as (select event_id // 3 as item, event_type as label from events), g as (select item, count(*) as n, mode(label) as m, count(distinct label) as labels, bool_or(label = 'error' or label is null) as bad from r group by 1) select item, case when n = 3 and not bad and labels <= 2 then m end as majority, n <> 3 or bad as failed from g"""),
    "d21_agreement": (d21_agreement, """with r as (select event_id // 3 as item, event_type as label, value as score, event_id as i from events), p as (select a.item, a.label = b.label as same, abs(a.score - b.score) as diff from r a join r b on a.item = b.item and a.i < b.i),
        it as (select item, bool_and(same) as un, avg(case when same then 1.0 else 0.0 end) as obs from p group by 1), ch as (select sum(n * n) / (sum(n) * sum(n)) as c from (select label, count(*) as n from r where item in (select item from it) group by 1))
        select count(*) as items, round(avg(case when un then 1.0 else 0.0 end), 6) as unanimous_rate, (select round(avg(case when same then 1.0 else 0.0 end), 6) from p) as pairwise_rate, (select round((avg(obs) - any_value(c)) / (1 - any_value(c)), 6) from it, ch) as kappa, (select count(*) from p) as n_pairs, (select round(avg(diff), 6) from p) as mean_abs_difference from it"""),
    "l2_copied_lines": (l2_copied_lines, f"""with {_LOG}, c as (select session, line, case when line % 311 = 0 then text || ' ' else text end as text from log where line % 307 <> 0)
        select l.session, count(*) as n_raw, count(c.line) as n_copy, count(*) - count(c.line) as n_missing, 0 as n_extra, count(*) filter (c.text <> l.text) as n_changed, count(*) filter (c.text = l.text) = count(*) as same_digest from log l left join c on c.session = l.session and c.line = l.line group by 1"""),
    "l4_capture_accounting": (l4_capture_accounting, f"""with {_LOG}, b as (select session, sum(strlen(text)) as n from log group by 1) select session, case when session % 17 <> 0 then session % 19 <> 0 end as adds_up, session % 23 <> 0 as file_matches, least(n, 1000) <= 4096 as within_limit, case when session % 17 <> 0 then n - least(n, 1000) + case when session % 19 = 0 then 1 else 0 end > 0 end as truncated from b"""),
    "l8_final_answers": (l8_final_answers, f"""with {_LOG}, p as (select session, line, line // 500 as m, text from log where label = 'signup'), f as (select session, max(m) as m from p where m % 2 = 0 group by 1), o as (select session, text, min(line) as line from p join f using (session, m) group by 1, 2) select session, string_agg(text, '' order by line) as answer from o group by 1"""),
}
