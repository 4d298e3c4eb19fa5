"""Small fixtures for operators whose queries run over whole tables elsewhere: nulls, ties, repeats, empty tables."""

from pyspark.sql import functions as F

from quarrylens.operators import events as ev
from quarrylens.operators import evidence
from quarrylens.operators import rollup as ru
from quarrylens.operators import search as se
from quarrylens.operators import symbols as sy
from quarrylens.plans.query import compile_query

SYMBOL = "symbol_id long, file_id long, file_path string, name string, kind string, owner string, docstring string, start_line int, end_line int, is_exported boolean"


def test_innermost_and_ties(spark):
    s = spark.createDataFrame([(1, 1, "a", "outer", "fn", None, None, 1, 50, True), (2, 1, "a", "inner", "fn", None, None, 10, 20, True), (3, 1, "a", "twin", "fn", None, None, 10, 20, True), (4, 1, "a", "v", "const", None, None, 15, 15, True)], SYMBOL)
    h = spark.createDataFrame([(1, 1, 15), (2, 1, 30), (3, 1, 99), (4, 2, 15), (5, 1, None)], "k long, file_id long, line int")
    got = {r.k: r.fn_id for r in sy.innermost_enclosing(h, s, "k").collect()}
    assert got == {1: 2, 2: 1, 3: None, 4: None, 5: None}


def test_significant(spark):
    s = spark.createDataFrame([(1, 1, "a", "f", "fn", None, None, 1, 9, False), (2, 1, "a", "local", "const", None, None, 3, 3, False), (3, 1, "a", "pub", "const", None, None, 4, 4, True), (4, 1, "a", "g", "fn", None, None, 20, 30, None)], SYMBOL)
    assert sorted(r.symbol_id for r in sy.significant_symbols(s).collect()) == [1, 3, 4]


def test_bm25_prefers_rare_terms_and_short_fields(spark):
    t = spark.createDataFrame([(1, "text", "alpha beta"), (2, "text", "alpha alpha alpha gamma delta epsilon"), (3, "text", "gamma"), (4, "text", None), (5, "text", "")], "file_id long, field string, text string")
    n = spark.createDataFrame([(5,)], "n long")
    r = {x.file_id: x.score for x in se.bm25(se.postings(t, ["beta", "alpha"]), se.field_lengths(t.filter("text is not null")), n, {"text": 1.0}).collect()}
    assert set(r) == {1, 2} and r[1] > r[2]


def test_ranking_order_symbol_over_docstring(spark):
    q = compile_query("renderCache")
    s = spark.createDataFrame([(1, 1, "a.ts", "renderCache", "fn", None, None, 1, 2, True), (2, 2, "b.ts", "other", "fn", None, "about renderCache", 1, 2, True)], SYMBOL).withColumn("name_frequency", F.lit(1))
    got = {r.symbol_id: (r.exact_hit, r.boost_eligible, r.admitted) for r in se.score_symbols(s, q).collect()}
    assert got[1] == (True, True, True) and got[2][1] is False


def test_diversified_order():
    rows = [("a/1", 10.0), ("a/2", 9.0), ("a/3", 8.0), ("a/4", 7.0), ("b/1", 6.5), ("c/1", 1.0)]
    assert se.diversified_order(rows, head=4, per_dir=3) == ["a/1", "a/2", "a/3", "b/1", "a/4", "c/1"]
    assert se.diversified_order([]) == [] and se.diversified_order([("a/1", 1.0)] * 0 + [("x/1", 5.0), ("y/1", 1.0)], head=2) == ["x/1", "y/1"]


def test_scopes():
    known = ["apps/web", "packages/core", "libs/core"]
    assert ru.resolve_scope("web", known) == "apps/web" and ru.resolve_scope("ALL", known) is None and ru.resolve_scope("apps/web/src", known) == "apps/web"
    for bad in ("core", "nothing"):
        try:
            ru.resolve_scope(bad, known)
            raise AssertionError
        except ValueError:
            pass
    assert ru.tree_anchors([("a", 5), ("a/b", 5), ("a/b/c", 2), ("a/b/d", 3)]) == ["a/b", "a/b/d", "a/b/c"]
    assert "1 more" in ru.render_overview([("a", 1, 1), ("b", 1, 1)], cap=1)


def test_unknown_stays_unknown(spark):
    d = spark.createDataFrame([("a", 1), ("a", None), ("b", 2)], "g string, v int")
    got = {r.g: r.s for r in d.groupBy("g").agg(ev.known_sum(F.col("v")).alias("s")).collect()}
    assert got == {"a": None, "b": 2}
    s = {r.g: (r.valid_n, r.missing_n, r.sd) for r in ev.numeric_summary(d, ["g"], "v").collect()}
    assert s == {"a": (1, 1, None), "b": (1, 0, None)}


def test_majority_and_agreement(spark):
    d = spark.createDataFrame([(1, "x"), (1, "x"), (1, "y"), (2, "x"), (2, "y"), (2, "z"), (3, None), (4, "x"), (4, "x"), (4, "y"), (4, "y"), (5, "x"), (5, "x"), (5, "?")], "i int, v string")
    got = {r.i: (r.majority, r.failed) for r in evidence.majority_of_three(d, "i", "v", ["x", "y", "z"]).collect()}
    assert got == {1: ("x", False), 2: (None, False), 3: (None, True), 4: (None, True), 5: (None, True)}
    scores = spark.createDataFrame([(1, 1.0), (1, 4.0), (1, 2.0), (2, 5.0), (3, 0.5), (3, 0.5)], "i int, v double")
    assert tuple(evidence.score_difference(scores, "i", "v").first()) == (4, 1.5)
    same = spark.createDataFrame([(i, "x") for i in (1, 1, 2, 2)], "i int, v string")
    r = ev.agreement(same, "i", "v").first()
    assert (r.unanimous_rate, r.pairwise_rate, r.kappa) == (1.0, 1.0, None)
    mixed = spark.createDataFrame([(1, "x"), (1, "x"), (1, "y"), (2, "y"), (2, "y"), (2, "y")], "i int, v string")
    m = ev.agreement(mixed, "i", "v").first()
    assert m.unanimous_rate == 0.5 and abs(m.pairwise_rate - (1 / 3 + 1) / 2) < 1e-6


def test_score_is_clamped(spark):
    s = spark.range(1).select(ev.score(F.lit(1.0), F.lit(1.0), F.lit(1.0), F.lit(1.0), F.lit(9)).alias("a"), ev.score(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(3)).alias("b")).first()
    assert (s.a, s.b) == (60.0, 0.0)


def test_conflicts_on_merge(spark):
    d = spark.createDataFrame([("a", 1, None), ("a", 1, 5), ("b", 1, 2), ("b", 3, 2)], "id string, x int, y int")
    got = {r.id: (r.x, r.x_conflict, r.y, r.y_conflict) for r in ev.merge_by_identity(d, ["id"], ["x", "y"]).collect()}
    assert got == {"a": (1, False, 5, False), "b": (None, True, 2, False)}


def test_empty_tables(spark):
    e = spark.createDataFrame([], SYMBOL)
    assert sy.significant_symbols(e).count() == 0
    files = spark.createDataFrame([], "file_id long, repo string, file_path string, content string")
    assert sy.callees(files, e).count() == 0 and sy.resolved_imports(files).count() == 0


def test_index_refresh(spark, tmp_path):
    ix = se.PostingsIndex(spark, str(tmp_path / "ix"))
    t = lambda rows: spark.createDataFrame(rows, "file_id long, field string, text string")
    ix.build(t([(1, "symbol", "alpha beta"), (2, "symbol", "alpha"), (3, "symbol", "..."), (4, "docstring", None)]))
    ids = lambda text: sorted(r.file_id for r in ix.search(compile_query(text)).collect())
    assert ids("alpha") == [1, 2] and ids("beta") == [1] and ids("") == []
    ix.refresh(t([(2, "symbol", "gamma"), (5, "symbol", "alpha")]), spark.createDataFrame([(1,)], "file_id long"))
    assert ids("alpha") == [5] and ids("gamma") == [2] and ids("beta") == []
    # totals after a refresh, of one segment after compaction and of a fresh build are the same
    scores = lambda x, text: sorted((r.file_id, round(r.score, 9)) for r in x.search(compile_query(text)).collect())
    fresh = se.PostingsIndex(spark, f"file:{tmp_path}/fresh")
    fresh.build(t([(2, "symbol", "gamma"), (5, "symbol", "alpha"), (3, "symbol", "..."), (4, "docstring", None)]))
    kept = [scores(ix, w) for w in ("alpha", "gamma", "alpha gamma")]
    assert kept == [scores(fresh, w) for w in ("alpha", "gamma", "alpha gamma")] and ix._state()[1]["fields"] == fresh._state()[1]["fields"]
    ix.refresh(t([(5, "symbol", "alpha alpha")]), spark.createDataFrame([], "file_id long"))
    twice = scores(ix, "alpha")
    ix.compact()
    assert scores(ix, "alpha") == twice and len(ix._state()[1]["segments"]) == 1
    plan = ix.search(compile_query("alpha"))._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(term), EqualTo(term,alpha)]" in plan or "In(term" in plan or "EqualTo(term,alpha)" in plan


def test_ranges_and_lines_meet_in_blocks(spark):
    """Ranges over many blocks, wide ones and their borders: the smallest callable around each line, as by hand."""
    import random

    rng = random.Random(4)
    fns = [(1, i, f"f{i}", "fn", a, a + w) for i, (a, w) in enumerate((rng.randrange(1, 9000), rng.choice([0, 3, 63, 64, 200, 4096, 4097, 9000])) for _ in range(120))]
    lines = [(k, 1, rng.randrange(1, 20_000)) for k in range(300)] + [(900 + n, 1, n) for n in (63, 64, 65, 4096, 65_536)] + [(999, 2, 5)]
    s = spark.createDataFrame(fns, "file_id long, symbol_id long, name string, kind string, start_line int, end_line int")
    got = {r.k: r.fn_id for r in sy.innermost_enclosing(spark.createDataFrame(lines, "k long, file_id long, line int"), s, "k").collect()}
    want = {k: min(((b - a, a, i) for f, i, _, _, a, b in fns if f == g and a <= n <= b), default=(0, 0, None))[2] for k, g, n in lines}
    assert got == want
