"""Ranked retrieval: postings tables, multi-field BM25, and re-ranking by symbol evidence.

Postings are (file_id, field, term, tf). A query first filters them to its terms, so what is aggregated and joined is as
large as the posting lists of those terms; corpus statistics are one row a field. Scores are doubles.
"""

from __future__ import annotations

import hashlib
import json
import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrylens.functions import languages as lang
from quarrylens.functions import text as tx
from quarrylens.operators.files import _EXT, _LANG_SQL, LINES_SQL
from quarrylens.operators.symbols import CALLS_SQL, SYM, call_sites
from quarrylens.plans.query import Query, compile_query
from quarrylens.session import table

K1, B = 1.2, 0.75
# fixed values: boosts of the fields and factors of the re-ranking
BOOSTS = {"symbol": 4.0, "docstring": 2.0, "path": 1.0, "literal": 1.0, "body": 0.75, "reference": 1.5, "format": 0.5}
EXACT_BOOST, TEST_PATH_FACTOR, SIGNAL_CAP, SUPPLEMENT_FACTOR = 3.0, 0.3, 1.6, 0.6
SAME_LANGUAGE, OTHER_LANGUAGE, SAME_EXTENSION = 2.0, -1.5, 0.75
COMMON_NAMES = ["constructor", "definition", "function", "default", "handler", "manager", "service", "context", "options", "settings"]
MAX_TERM_BYTES, LITERAL_CHARS, AUXILIARY_CHARS = 40, 256, 2048

# ---------------------------------------------------------------- postings


def terms_of(c: Column) -> Column:
    """Index terms: lower-case alphanumeric runs of at most 40 bytes."""
    return F.filter(F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), lambda t: F.octet_length(t) <= MAX_TERM_BYTES)


def field_texts(files: DataFrame, symbols: DataFrame, literals: DataFrame, extracted: DataFrame, tags: DataFrame) -> DataFrame:
    """(file_id, field, text) of everything that is indexed."""
    words = lambda c: F.array_join(tx.split_identifier(c), " ")
    sym = F.concat_ws(" ", "name", words(F.col("name")), "owner", words(F.col("owner")))
    f = lambda df, name, c: df.select("file_id", F.lit(name).alias("field"), c.alias("text"))
    tag_files = tags.join(files.select("repo", F.col("file_path").alias("file"), "file_id"), ["repo", "file"])
    parts = [
        f(symbols, "symbol", sym),
        f(symbols.filter("docstring is not null"), "docstring", F.col("docstring")),
        f(files, "path", F.array_join(tx.tokenize_path(F.col("file_path")), " ")),
        f(literals, "literal", F.left("text", F.lit(LITERAL_CHARS))),
        f(tag_files.filter("signature is not null"), "body", F.left("signature", F.lit(AUXILIARY_CHARS))),
        f(call_sites(files), "reference", F.col("name")),
        f(extracted.filter("format_text is not null"), "format", F.left("format_text", F.lit(AUXILIARY_CHARS))),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def postings(texts: DataFrame, terms: list[str] | None = None) -> DataFrame:
    """(file_id, field, term, tf); only the given terms where there are some, filtered before rows are made."""
    t = terms_of(F.col("text"))
    if terms is not None:
        t = F.filter(t, lambda x: x.isin(terms))
    return texts.select("file_id", "field", F.explode(t).alias("term")).groupBy("file_id", "field", "term").agg(F.count("*").alias("tf"))


def field_lengths(texts: DataFrame) -> DataFrame:
    """(file_id, field, dl)."""
    return texts.groupBy("file_id", "field").agg(F.sum(F.size(terms_of(F.col("text")))).cast("long").alias("dl"))


def bm25(post: DataFrame, lengths: DataFrame, n_docs: DataFrame, boosts: dict[str, float] = BOOSTS) -> DataFrame:
    """(file_id, score). ``n_docs`` is one row (n)."""
    avg = lengths.groupBy("field").agg(F.avg("dl").alias("avgdl"))
    df = post.groupBy("field", "term").agg(F.count("*").alias("df"))
    boost = F.create_map(*[F.lit(x) for kv in boosts.items() for x in kv])[F.col("field")]
    # averages are one row a field, of which there are few; the sizes of the other sides are left to the planner
    j = post.join(lengths, ["file_id", "field"]).join(F.broadcast(avg), "field").join(df, ["field", "term"]).withColumn("n", n_docs.select("n").scalar())
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    tf = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return j.groupBy("file_id").agg(F.sum(boost * idf * tf).alias("score"))


class PostingsIndex:
    """Postings kept in a shared folder as segments. A segment holds the postings of its files, range-partitioned and sorted by term,
    each with the length of its field, so that a query's terms prune nearly all of it and nothing else is read; a small table of
    lengths; and the files that it replaces or drops in the segments before it. The commit file that makes a segment count also
    holds the corpus totals, so a search reads no more than its terms' postings. A refresh writes what has changed and reads, of the
    older segments, only the lengths of the files it touches; ``compact`` makes one segment of all.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        from quarrylens.sources.storage import Folder

        self.spark, self.folder = spark, Folder(spark, path)

    def _state(self) -> tuple[int, dict]:
        done = [n for n in self.folder.names("commit") if n.isdigit()]
        return (int(done[-1]), json.loads(self.folder.read(f"commit/{done[-1]}"))) if done else (0, {"segments": [], "fields": {}, "files": 0, "with_path": 0})

    def _read(self, segment: str, part: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder.path}/{segment}/{part}")

    def _commit(self, number: int, state: dict) -> int:
        if not self.folder.claim(f"commit/{number + 1:08d}", json.dumps(state)):
            raise RuntimeError("another writer has committed since this one began")
        return number + 1

    def _segment(self, post: DataFrame, lengths: DataFrame) -> str:
        """Write (file_id, field, term, tf) and (file_id, field, dl)."""
        name = f"segment-{uuid.uuid4().hex}"
        at = f"{self.folder.path}/{name}"
        lengths.withColumn("dl", F.coalesce("dl", F.lit(0))).repartitionByRange("file_id").sortWithinPartitions("file_id").write.parquet(f"{at}/lengths")
        both = post.join(self._read(name, "lengths"), ["file_id", "field"])
        both.repartitionByRange("term").sortWithinPartitions("term", "field", "file_id").write.parquet(f"{at}/postings")
        return name

    @staticmethod
    def _totals(lengths: DataFrame) -> tuple[dict, int, int]:
        """Per field rows and their lengths; files; files with a path. One row a field reaches the driver."""
        fields = {r.field: [r.n, r.s] for r in lengths.groupBy("field").agg(F.count("*").alias("n"), F.sum("dl").alias("s")).collect()}
        n = lengths.agg(F.countDistinct("file_id").alias("a"), F.countDistinct(F.when(F.col("field") == "path", F.col("file_id"))).alias("b")).first()
        return fields, n.a, n.b

    @staticmethod
    def _moved(state: dict, totals: tuple[dict, int, int], sign: int) -> dict:
        fields = {k: list(v) for k, v in state["fields"].items()}
        for k, (n, s) in totals[0].items():
            old = fields.get(k, [0, 0])
            fields[k] = [old[0] + sign * n, old[1] + sign * s]
        return state | {"fields": fields, "files": state["files"] + sign * totals[1], "with_path": state["with_path"] + sign * totals[2]}

    def build(self, texts: DataFrame) -> int:
        """Write the whole index as one segment; returns its number."""
        number, _ = self._state()
        name = self._segment(postings(texts), field_lengths(texts))
        empty = {"segments": [{"name": name, "gone": False}], "fields": {}, "files": 0, "with_path": 0}
        return self._commit(number, self._moved(empty, self._totals(self._read(name, "lengths")), 1))

    def _live(self, state: dict, part: str, keep) -> DataFrame | None:
        """Rows of all segments that no later one replaces; ``keep`` filters each before anything is joined."""
        out = None
        for i, seg in enumerate(state["segments"]):
            rows = keep(self._read(seg["name"], part))
            for later in state["segments"][i + 1 :]:
                if later["gone"]:
                    rows = rows.join(self._read(later["name"], "gone"), "file_id", "left_anti")
            out = rows if out is None else out.unionByName(rows)
        return out

    def refresh(self, texts: DataFrame, gone: DataFrame) -> int:
        """A segment with the given files' postings, which replaces theirs and drops those of vanished files (file_id)."""
        number, state = self._state()
        name = self._segment(postings(texts), field_lengths(texts))
        new = self._read(name, "lengths")
        touched = new.select("file_id").unionByName(gone.select("file_id")).distinct()
        touched.write.parquet(f"{self.folder.path}/{name}/gone")
        touched = self._read(name, "gone")
        few = [r.file_id for r in touched.limit(FEW_FILES + 1).collect()]
        keep = (lambda d: d.filter(F.col("file_id").isin(few))) if len(few) <= FEW_FILES else (lambda d: d.join(touched, "file_id", "left_semi"))
        if state["segments"]:
            state = self._moved(state, self._totals(self._live(state, "lengths", keep)), -1)
        state = self._moved(state, self._totals(new), 1)
        return self._commit(number, state | {"segments": [*state["segments"], {"name": name, "gone": True}]})

    def compact(self) -> int:
        """One segment of all."""
        number, state = self._state()
        whole = lambda d: d
        name = self._segment(self._live(state, "postings", whole).drop("dl"), self._live(state, "lengths", whole))
        return self._commit(number, state | {"segments": [{"name": name, "gone": False}]})

    def built(self) -> bool:
        return self._state()[0] > 0

    def search(self, q: Query) -> DataFrame:
        """(file_id, score) of the files that hold any term of the query."""
        _, state = self._state()
        post = self._live(state, "postings", lambda d: d.filter(F.col("term").isin(q.terms)))
        return scored(post, {f: s / n for f, (n, s) in state["fields"].items() if n}, state["with_path"] or state["files"])


#: Files of a refresh up to which their ids go into the filter of the older lengths, so that row groups are skipped.
FEW_FILES = 1000


def scored(post: DataFrame, avgdl: dict[str, float], n: int, boosts: dict[str, float] = BOOSTS) -> DataFrame:
    """(file_id, score) of postings that carry their field's length, with known corpus totals."""
    lookup = lambda m: F.create_map(*[F.lit(x) for kv in m.items() for x in kv])[F.col("field")]
    j = post.join(post.groupBy("field", "term").agg(F.count("*").alias("df")), ["field", "term"])
    idf = F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    tf = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / lookup(avgdl or {"": 1.0})))
    return j.groupBy("file_id").agg(F.sum(lookup(boosts) * idf * tf).alias("score"))


_INDEXED = ["source_files", "symbols", "literals", "extracted_files", "tags"]
#: Part of a kept index's name: changes with what is indexed and how.
INDEX_VERSION = "segments-1"


def index_of(spark: SparkSession, d: str) -> PostingsIndex:
    """The index over a folder of tables: built once for their present files and kept in the shared checkpoint folder under a
    fingerprint of them (names, sizes, times). It stands for these tables: refreshes belong into an index of one's own."""
    from quarrylens.session import checkpoint_dir
    from quarrylens.sources.storage import Folder

    marks = [Folder(spark, f"{d}/{t}.parquet").fingerprint() for t in _INDEXED]
    ix = PostingsIndex(spark, f"{checkpoint_dir(spark).rstrip('/')}/index-{hashlib.sha256(json.dumps([INDEX_VERSION, d, marks]).encode()).hexdigest()[:24]}")
    if not ix.built():
        files, syms, lits, ext, tags = (table(spark, d, t) for t in _INDEXED)
        try:
            ix.build(field_texts(files, syms.distinct(), lits.distinct(), ext, tags.distinct()))
        except RuntimeError:
            if not ix.built():  # else another session has built it meanwhile
                raise
    return ix


def document_bm25(documents: DataFrame, terms: list[str]) -> DataFrame:
    """BM25 over one text column: (doc_id, score)."""
    t = documents.filter("text is not null").select(F.col("doc_id").alias("file_id"), F.lit("text").alias("field"), "text")
    n = t.agg(F.count("*").alias("n"))
    return bm25(postings(t, terms), field_lengths(t), n, {"text": 1.0}).withColumnRenamed("file_id", "doc_id")


# ---------------------------------------------------------------- symbol evidence


def _hits(c: Column, terms: list[str]) -> Column:
    low = F.coalesce(F.lower(c), F.lit(""))
    out = F.lit(0)
    for t in terms:
        out = out + F.when(low.contains(t), 1).otherwise(0)
    return out


def _any_hits(cols: list[Column], terms: list[str]) -> Column:
    out = F.lit(0)
    for t in terms:
        hit = F.lit(False)
        for c in cols:
            hit = hit | F.coalesce(F.lower(c), F.lit("")).contains(t)
        out = out + F.when(hit, 1).otherwise(0)
    return out


def score_symbols(symbols: DataFrame, q: Query) -> DataFrame:
    """Symbols with their counts of terms hit, exact hits, boost eligibility, admission and signal. Needs a column
    ``name_frequency`` (symbols of the same name among the candidates)."""
    name, owner = F.col("name"), F.col("owner")
    low = F.lower(name)
    n_words = F.size(tx.split_identifier(name))
    words = F.array(*[F.lit(w) for w in [*q.words, *q.raw_words]]) if q.words else F.array().cast("array<string>")
    whole = F.array_contains(words, low)
    sub = (n_words >= 2) & F.forall(tx.split_identifier(name), lambda w: w.isin(q.tokens or [""]))
    d = symbols.withColumns(
        {
            "n_terms": _any_hits([name, owner, F.col("docstring")], q.tokens),
            "n_names": _any_hits([name, owner], q.tokens),
            "n_owner": _hits(owner, q.tokens),
            "n_path": _hits(F.col("file_path"), q.tokens),
            "exact_hit": whole | sub,
        }
    )
    has_owner = F.col("n_owner") > 0
    raw = low.isin(q.raw_words or [""])
    discriminative = (F.octet_length(name) >= 8) | (n_words >= 2)
    common = low.isin(COMMON_NAMES) | ((n_words <= 1) & (F.col("name_frequency") >= 3))
    qualified = F.lit(q.qualified)
    eligible = (
        F.col("exact_hit")
        & ~(whole & qualified & ~raw & ~has_owner)
        & ~(sub & ~whole & qualified & ~has_owner)
        & ~(~discriminative & ~has_owner)
        & ~(common & (F.col("n_owner") < 2))
    )
    n = len(q.tokens)
    half = math.ceil(n / 2)
    admitted = F.col("exact_hit") | (F.col("n_terms") == n) | (F.lit(n >= 3) & (F.col("n_terms") >= half) & (F.col("n_names") > 0))
    d = d.withColumn("boost_eligible", eligible).withColumn("admitted", admitted & F.lit(n > 0))
    signal = F.when(has_owner, F.col("n_terms") / max(n, 1) * 0.2 + F.when(F.col("boost_eligible"), 0.1).otherwise(0.0) + 0.18 + F.when(F.col("n_path") > 0, 0.05).otherwise(0.0)).otherwise(0.0)
    return d.withColumn("signal", signal)


SYMBOL_ORDER = [F.desc, ["boost_eligible", "exact_hit", "n_terms", "n_owner", "n_path", "signal"]]


def symbol_window(by: str) -> Window:
    return Window.partitionBy(by).orderBy(*[F.desc(c) for c in SYMBOL_ORDER[1]], "start_line", "symbol_id")


def admitted_literals(literals: DataFrame, q: Query) -> DataFrame:
    n = len(q.tokens)
    d = literals.withColumn("n_terms", _hits(F.col("text"), q.tokens))
    return d.filter((F.col("n_terms") == n) | F.lower("text").isin(q.words or [""]) | (F.lit(n >= 3) & (F.col("n_terms") >= math.ceil(n / 2)))) if n else d.filter(F.lit(False))


def language_prior(path: Column, language: str | None, ext: str | None) -> Column:
    own = lang.language_of_path(path)
    out = F.lit(0.0)
    if language:
        out = out + F.when(own == language, SAME_LANGUAGE).when(own.isNotNull(), OTHER_LANGUAGE).otherwise(0.0)
    if ext:
        out = out + F.when(tx.extension(path) == ext, SAME_EXTENSION).otherwise(0.0)
    return out


def ranked_search(spark: SparkSession, d: str, text: str, k: int = 100, language: str | None = None, ext: str | None = None, scope: str | None = None) -> DataFrame:
    """(file_id, score, symbol_fallback, symbol_id): the k best files with the symbol that explains each best.

    BM25 over the kept index gives the candidates (five times as many in a scope), each is multiplied by the exact boost, the capped
    signal and the test factor, then the language prior is added, in this order. A blank query gives no rows.
    """
    q = compile_query(text)
    syms = table(spark, d, "symbols").distinct()
    paths = table(spark, d, "source_files").select("file_id", "file_path")
    scores = index_of(spark, d).search(q)
    j = scores.join(paths, "file_id")
    if scope:
        j = j.filter((F.col("file_path") == scope) | F.col("file_path").startswith(scope + "/"))
    top = j.orderBy(F.desc(F.round("score", 9)), "file_path", "file_id").limit(k * 5 if scope else k)
    return rerank(top, syms, q, k, language, ext)


def rerank(top: DataFrame, symbols: DataFrame, q: Query, k: int, language: str | None = None, ext: str | None = None) -> DataFrame:
    """Re-ranked candidates (file_id, file_path, score); their number is k at most, so name counts cover candidates only."""
    cand = symbols.drop("file_path", "repo").join(F.broadcast(top.select("file_id", "file_path")), "file_id")
    freq = cand.groupBy(F.lower("name").alias("ln")).agg(F.count("*").alias("name_frequency"))
    scored = score_symbols(cand.join(freq, F.lower("name") == F.col("ln")), q).filter("admitted")
    w = symbol_window("file_id")
    best = scored.withColumn("rn", F.row_number().over(w)).groupBy("file_id").agg(
        F.max(F.when(F.col("rn") == 1, F.col("symbol_id"))).alias("symbol_id"), F.max("boost_eligible").alias("boost"), F.max("signal").alias("signal")
    )
    j = top.join(best, "file_id", "left")
    s = F.col("score") * F.when(F.col("boost"), EXACT_BOOST).otherwise(1.0) * F.least(1 + F.coalesce("signal", F.lit(0.0)), F.lit(SIGNAL_CAP))
    s = s * F.when(tx.is_test_like_path(F.col("file_path")), TEST_PATH_FACTOR).otherwise(1.0) + language_prior(F.col("file_path"), language, ext)
    return j.select("file_id", "file_path", F.round(s, 6).alias("score"), F.col("symbol_id").isNull().alias("symbol_fallback"), "symbol_id").orderBy(F.desc("score"), "file_path", "file_id").limit(k)


def diversified_order(rows: list[tuple[str, float]], head: int = 5, per_dir: int = 3, close: float = 0.6) -> list[str]:
    """Paths of (path, score) rows, best first, reordered so that the head holds at most ``per_dir`` of one directory while other
    directories have results of at least ``close`` times the score passed over; the rest keeps its order."""
    rest, out, count = list(rows), [], {}
    while rest and len(out) < head:
        best = rest[0][1]
        pick = next((i for i, (p, s) in enumerate(rest) if count.get(p.rpartition("/")[0], 0) < per_dir and s >= close * best), 0)
        p, _ = rest.pop(pick)
        count[p.rpartition("/")[0]] = count.get(p.rpartition("/")[0], 0) + 1
        out.append(p)
    return out + [p for p, _ in rest]


# ---------------------------------------------------------------- queries

QUERY = "trim seal session cursor panel"
_Q = compile_query(QUERY)
_DOC_TERMS = ["watcher", "snapshot", "refresh", "retry"]


def _lst(xs) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + "]"


_WORDS_SQL = "list_filter(list_transform(string_split_regex(regexp_replace(regexp_replace(regexp_replace({c}, '([a-z0-9])([A-Z])', '\\1_\\2', 'g'), '([A-Z])([A-Z][a-z])', '\\1_\\2', 'g'), '([0-9])([A-Za-z])', '\\1_\\2', 'g'), '[_-]+'), lambda x: lower(x)), lambda x: length(x) > 0)"
_TERMS_SQL = "list_filter(regexp_extract_all(lower({c}), '[\\p{{L}}\\p{{N}}]+'), lambda t: strlen(t) <= 40)"
TEXTS_SQL = f"""{SYM}, {CALLS_SQL}, texts as (
 select file_id, 'symbol' as field, concat_ws(' ', name, array_to_string({_WORDS_SQL.format(c='name')}, ' '), owner, array_to_string({_WORDS_SQL.format(c='owner')}, ' ')) as text from s
 union all select file_id, 'docstring', docstring from s where docstring is not null
 union all select file_id, 'path', array_to_string(list_filter(string_split_regex(file_path, '[/\\\\.]'), lambda x: length(x) > 0), ' ') from source_files
 union all select file_id, 'literal', left(text, 256) from (select distinct * from literals)
 union all select f.file_id, 'body', left(signature, 2048) from (select distinct * from tags) t join source_files f on f.repo = t.repo and f.file_path = t.file where signature is not null
 union all select file_id, 'reference', name from calls
 union all select file_id, 'format', left(format_text, 2048) from extracted_files where format_text is not null),
 lens as (select file_id, field, cast(sum(len({_TERMS_SQL.format(c='text')})) as bigint) as dl from texts group by 1, 2)"""
_BOOST_SQL = "case field " + " ".join(f"when '{k}' then {v}" for k, v in BOOSTS.items()) + " end"


def _bm25_sql(terms) -> str:
    return f"""post as (select file_id, field, term, count(*) as tf from (select file_id, field, unnest({_TERMS_SQL.format(c='text')}) as term from texts) where term in {tuple(terms)} group by 1, 2, 3),
 av as (select field, avg(dl) as avgdl from lens group by 1), dfs as (select field, term, count(*) as df from post group by 1, 2),
 bm as (select file_id, sum({_BOOST_SQL} * ln(1 + ((select count(*) from source_files) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) as score
  from post join lens using (file_id, field) join av using (field) join dfs using (field, term) group by 1)"""


def _sum_hits(cols, terms) -> str:
    return "(" + " + ".join("case when " + " or ".join(f"contains(lower(coalesce({c}, '')), '{t}')" for c in cols) + " then 1 else 0 end" for t in terms) + ")"


def _scored_sql(q: Query, src: str) -> str:
    words = _WORDS_SQL.format(c="name")
    n, half = len(q.tokens), math.ceil(len(q.tokens) / 2)
    return f"""sc0 as (select *, lower(name) in {tuple([*q.words, *q.raw_words])} as whole, len({words}) as nw, len({words}) >= 2 and len(list_filter({words}, lambda w: not list_contains({_lst(q.tokens)}, w))) = 0 as sub,
  {_sum_hits(['name', 'owner', 'docstring'], q.tokens)} as n_terms, {_sum_hits(['name', 'owner'], q.tokens)} as n_names, {_sum_hits(['owner'], q.tokens)} as n_owner, {_sum_hits(['file_path'], q.tokens)} as n_path from {src}),
 sc1 as (select *, whole or sub as exact_hit, (whole or sub) and not (whole and {q.qualified} and not lower(name) in {tuple([*q.raw_words, ''])} and n_owner = 0) and not (sub and not whole and {q.qualified} and n_owner = 0)
   and not (not (strlen(name) >= 8 or nw >= 2) and n_owner = 0) and not ((lower(name) in {tuple(COMMON_NAMES)} or (nw <= 1 and name_frequency >= 3)) and n_owner < 2) as boost_eligible from sc0),
 sc as (select *, exact_hit or n_terms = {n} or ({n} >= 3 and n_terms >= {half} and n_names > 0) as admitted,
   case when n_owner > 0 then n_terms / {n}.0 * 0.2 + case when boost_eligible then 0.1 else 0 end + 0.18 + case when n_path > 0 then 0.05 else 0 end else 0.0 end as signal from sc1)"""


_ORDER_SQL = "boost_eligible desc, exact_hit desc, n_terms desc, n_owner desc, n_path desc, signal desc, start_line, symbol_id"


def _all_scored(spark, d):
    s = table(spark, d, "symbols").distinct()
    freq = s.groupBy(F.lower("name").alias("ln")).agg(F.count("*").alias("name_frequency"))
    return score_symbols(s.join(freq, F.lower("name") == F.col("ln")), _Q)


_ALL_SQL = f"with {SYM}, sf as (select s.*, count(*) over (partition by lower(name)) as name_frequency from s), {_scored_sql(_Q, 'sf')}"


def h1_bm25_top(spark, d):
    """Flagship: the twenty best documents for a few terms."""
    r = document_bm25(table(spark, d, "documents"), _DOC_TERMS).select("doc_id", F.round("score", 6).alias("score"))
    return r.orderBy(F.desc("score"), "doc_id").limit(20)


def h1_bm25_fields(spark, d):
    files = table(spark, d, "source_files")
    t = field_texts(files, table(spark, d, "symbols").distinct(), table(spark, d, "literals").distinct(), table(spark, d, "extracted_files"), table(spark, d, "tags").distinct())
    r = bm25(postings(t, _Q.terms), field_lengths(t), files.agg(F.count("*").alias("n")))
    return r.select("file_id", F.round("score", 6).alias("score"))


def h1_indexed_search(spark, d):
    """The same search over the index that is kept on disk; built first where there is none for these tables."""
    return index_of(spark, d).search(_Q).select("file_id", F.round("score", 6).alias("score"))


def h2_field_population(spark, d):
    t = field_texts(table(spark, d, "source_files"), table(spark, d, "symbols").distinct(), table(spark, d, "literals").distinct(), table(spark, d, "extracted_files"), table(spark, d, "tags").distinct())
    return field_lengths(t).groupBy("field").agg(F.count("*").alias("n_files"), F.sum("dl").alias("n_terms"))


def d25_corpus_statistics(spark, d):
    t = table(spark, d, "documents").filter("text is not null").select(F.col("doc_id").alias("file_id"), F.lit("text").alias("field"), "text")
    return postings(t).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def h5_ranked_search(spark, d):
    return ranked_search(spark, d, QUERY, language="typescript", ext="ts").select("file_id", "score", "symbol_fallback", "symbol_id")


def h5_batch_search(spark, d):
    """All distinct search texts at once against the symbol field: the ten best files of each."""
    files, s = table(spark, d, "source_files"), table(spark, d, "symbols").distinct()
    t = s.select("file_id", F.lit("symbol").alias("field"), F.concat_ws(" ", "name", F.array_join(tx.split_identifier(F.col("name")), " ")).alias("text"))
    q = table(spark, d, "search_results").select("search_text").distinct()
    qt = q.select("search_text", F.explode(F.array_distinct(terms_of(F.concat_ws(" ", "search_text", F.array_join(tx.split_identifier(F.regexp_replace("search_text", " ", "_")), " "))))).alias("term"))
    post = postings(t)
    df = post.groupBy("term").agg(F.count("*").alias("df"))
    lens = field_lengths(t).select("file_id", "dl")
    j = qt.join(post, "term").join(df, "term").join(lens, "file_id")
    j = j.withColumn("avgdl", lens.agg(F.avg("dl")).scalar()).withColumn("n", files.agg(F.count("*")).scalar())
    sc = F.sum(F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)) * F.col("tf") * 2.2 / (F.col("tf") + 1.2 * (0.25 + 0.75 * F.col("dl") / F.col("avgdl"))))
    r = j.groupBy("search_text", "file_id").agg(F.round(sc, 6).alias("score"))
    w = Window.partitionBy("search_text").orderBy(F.desc("score"), "file_id")
    return r.withColumn("rank", F.row_number().over(w)).filter("rank <= 10")


def c17_recall(spark, d):
    """Per search text: files that define the searched name, how many of them were returned, and the recall (1 for none)."""
    res = table(spark, d, "search_results").select("search_text", "repo", "file_path").distinct()
    exp = table(spark, d, "symbols").select(F.col("name").alias("search_text"), "repo", "file_path").distinct().join(res.select("search_text").distinct(), "search_text", "left_semi")
    hit = exp.join(res.withColumn("hit", F.lit(1)), ["search_text", "repo", "file_path"], "left")
    g = hit.groupBy("search_text").agg(F.count("*").alias("n_expected"), F.count("hit").alias("n_found"))
    return res.select("search_text").distinct().join(g, "search_text", "left").select("search_text", F.coalesce("n_expected", F.lit(0)).alias("n_expected"), F.coalesce("n_found", F.lit(0)).alias("n_found"), F.round(F.coalesce(F.col("n_found") / F.col("n_expected"), F.lit(1.0)), 6).alias("recall"))


def d11_benchmark_means(spark, d):
    r = c17_recall(spark, d)
    return r.agg(F.count("*").alias("n_queries"), F.round(F.avg("recall"), 6).alias("mean_recall"), F.round(100 * F.avg(F.when(F.col("n_found") != F.col("n_expected"), 1.0).otherwise(0.0)), 6).alias("percent_differing"))


def g5_same_results(spark, d):
    """Whether each search text was answered with the same files every time: files missing from any of its answers."""
    r = table(spark, d, "search_results").select("search_text", "repo", "file_path", "symbol_fallback").distinct()
    a, b = r.filter("symbol_fallback").drop("symbol_fallback"), r.filter("not symbol_fallback").drop("symbol_fallback")
    return a.exceptAll(b).withColumn("only_in", F.lit("fallback")).unionByName(b.exceptAll(a).withColumn("only_in", F.lit("matched")))


def b9_term_hits(spark, d):
    return _all_scored(spark, d).select("symbol_id", "n_terms", "n_names", "n_owner", "n_path")


def b10_exact_hits(spark, d):
    return _all_scored(spark, d).filter("exact_hit").select("symbol_id")


def b11_boost_eligible(spark, d):
    return _all_scored(spark, d).filter("boost_eligible").select("symbol_id")


def b12_admitted_symbols(spark, d):
    return _all_scored(spark, d).filter("admitted").select("symbol_id", F.round("signal", 6).alias("signal"))


def b13_admitted_literals(spark, d):
    return admitted_literals(table(spark, d, "literals").distinct(), _Q).select("literal_id", "n_terms")


def b14_qualified_literals(spark, d):
    """Literals that equal a qualified name: one of the dotted literals themselves, each counted by file."""
    l = table(spark, d, "literals").select("file_id", F.lower("text").alias("text")).distinct()
    return l.filter(F.col("text").rlike(r"^\w+(?:(?:\.|::)\w+)+$")).groupBy("text").agg(F.count("*").alias("n_files"))


def c15_supplement(spark, d):
    """Files that only a plain-token query finds, kept where an owner and an exact name match, at the lower factor."""
    q = compile_query("SnapshotCache::fold_snapshot")
    s = table(spark, d, "symbols").distinct()
    t = s.select("file_id", F.lit("symbol").alias("field"), F.concat_ws(" ", "name", F.array_join(tx.split_identifier(F.col("name")), " "), "owner", F.array_join(tx.split_identifier(F.col("owner")), " ")).alias("text"))
    n = table(spark, d, "source_files").agg(F.count("*").alias("n"))
    first = bm25(postings(t, ["snapshotcache", "fold_snapshot"]), field_lengths(t), n).select("file_id")
    more = bm25(postings(t, q.terms), field_lengths(t), n).join(first, "file_id", "left_anti")
    ok = score_symbols(s.withColumn("name_frequency", F.lit(1)), q).filter("n_owner > 0 and boost_eligible").select("file_id").distinct()
    return more.join(ok, "file_id", "left_semi").select("file_id", F.round(F.col("score") * SUPPLEMENT_FACTOR, 6).alias("score"))


_Q2 = compile_query("SnapshotCache::fold_snapshot")


def g1_union_of_candidates(spark, d):
    """Candidates of two queries, those of the first kept where both have a file."""
    docs = table(spark, d, "documents")
    a = document_bm25(docs, ["watcher", "lock"]).withColumn("score", F.round("score", 6))
    b = document_bm25(docs, ["snapshot", "panel"]).withColumn("score", F.round(F.col("score") * SUPPLEMENT_FACTOR, 6))
    return a.unionByName(b.join(a.select("doc_id"), "doc_id", "left_anti"))


def d8_term_coverage(spark, d):
    s = _all_scored(spark, d)
    return s.groupBy("file_id").agg(F.max("n_terms").alias("best"), F.sum("n_terms").alias("total"), F.count(F.when(F.col("admitted"), 1)).alias("n_admitted"))


def d9_file_signal(spark, d):
    s = _all_scored(spark, d).filter("admitted")
    return s.groupBy("file_id").agg(F.round(F.least(1 + F.max("signal"), F.lit(SIGNAL_CAP)), 6).alias("multiplier"))


def e1_symbol_order(spark, d):
    s = _all_scored(spark, d).filter("admitted")
    return s.withColumn("rank", F.row_number().over(symbol_window("file_id"))).select("file_id", "symbol_id", "rank")


def e2_explaining_symbol(spark, d):
    s = _all_scored(spark, d).filter("admitted")
    return s.withColumn("rank", F.row_number().over(symbol_window("file_id"))).filter("rank = 1").select("file_id", "symbol_id", F.col("name_frequency").alias("n_same_name"))


def e3_diversified(spark, d):
    """The head of a ranked list spread over directories; at most 500 rows are ordered on the driver."""
    top = ranked_search(spark, d, QUERY, k=100).select("file_path", "score").collect()
    order = diversified_order([(r.file_path, r.score) for r in top])
    return spark.createDataFrame([(i + 1, p) for i, p in enumerate(order)], "position int, file_path string")


def f1_top_scores(spark, d):
    s = table(spark, d, "search_results").filter("score is not null")
    return s.orderBy(F.desc("score"), "file_path", "result_id").limit(100).select("result_id", "score")


def f2_ranks_per_query(spark, d):
    """Final order of each search: score down, path up, the first twelve."""
    w = Window.partitionBy("search_text").orderBy(F.desc_nulls_last("score"), "file_path", "result_id")
    return table(spark, d, "search_results").withColumn("rank", F.row_number().over(w)).filter("rank <= 12").select("search_text", "result_id", "rank")


def f8_capped_details(spark, d):
    """At most twenty symbols and ten literals of a file are shown."""
    s = table(spark, d, "symbols").distinct()
    w = Window.partitionBy("file_id").orderBy("start_line", "symbol_id")
    a = s.withColumn("rn", F.row_number().over(w)).filter("rn <= 20").groupBy("file_id").agg(F.count("*").alias("n_symbols"), F.max("symbol_id").alias("last_symbol"))
    l = table(spark, d, "literals").distinct()
    v = Window.partitionBy("file_id").orderBy("line", "literal_id")
    b = l.withColumn("rn", F.row_number().over(v)).filter("rn <= 10").groupBy("file_id").agg(F.count("*").alias("n_literals"))
    return a.join(b, "file_id", "full")


def h7_fallback_files(spark, d):
    """Files found without any admitted symbol: all of their symbols stand in."""
    s = _all_scored(spark, d)
    return s.groupBy("file_id").agg(F.max("admitted").alias("any"), F.count("*").alias("n_symbols")).filter("not any").select("file_id", "n_symbols")


def h8_unindexed_search(spark, d):
    """Baseline without an index: all terms in one symbol's name, else in one literal of the file."""
    terms = ["fold", "snapshot"]
    s = table(spark, d, "symbols").distinct().filter(_hits(F.col("name"), terms) == len(terms)).select("file_id", F.lit("symbol").alias("by")).distinct()
    l = table(spark, d, "literals").distinct().filter(_hits(F.col("text"), terms) == len(terms)).select("file_id", F.lit("literal").alias("by")).distinct()
    return s.unionByName(l.join(s.select("file_id"), "file_id", "left_anti"))


def i11_match_reasons(spark, d):
    s = _all_scored(spark, d).filter("admitted")
    reason = F.when(F.col("boost_eligible"), "exact symbol name").when(F.col("exact_hit"), "symbol name").when(F.col("n_owner") > 0, "owner and terms").when(F.col("n_names") > 0, "name terms").otherwise("documentation terms")
    return s.select("symbol_id", F.format_string("%s (%d of %d terms)", reason, F.col("n_terms"), F.lit(len(_Q.tokens))).alias("reason"))


_DOC_SQL = """t as (select doc_id, {terms} as tt from documents where text is not null), n as (select count(*) as n, avg(len(tt)) as avgdl from t),
 p as (select doc_id, term, count(*) as tf, min(dl) as dl from (select doc_id, unnest(tt) as term, len(tt) as dl from t) where term in {q} group by 1, 2), dfs as (select term, count(*) as df from p group by 1),
 bm{x} as (select doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) as score from p join dfs using (term), n group by 1)"""
_DT = _TERMS_SQL.format(c="text")
_TEST_SQL = "(regexp_matches(lower(file_path), '(?:^|/)(?:tests|test|benches|bench|__tests__)/') or starts_with(string_split(lower(string_split(file_path, '/')[-1]), '.')[1], 'test_') or ends_with(string_split(lower(string_split(file_path, '/')[-1]), '.')[1], '_test') or contains(lower(string_split(file_path, '/')[-1]), '.test.') or contains(lower(string_split(file_path, '/')[-1]), '.spec.'))"
_RECALL_SQL = "res as (select distinct search_text, repo, file_path from search_results), ex as (select distinct name as search_text, repo, file_path from symbols where name in (select search_text from res)), g as (select e.search_text, count(*) as n_expected, count(r.search_text) as n_found from ex e left join res r using (search_text, repo, file_path) group by 1), rc as (select q.search_text, coalesce(n_expected, 0) as n_expected, coalesce(n_found, 0) as n_found, round(coalesce(n_found / n_expected, 1.0), 6) as recall from (select distinct search_text from res) q left join g using (search_text))"
_SYMT_SQL = f"{SYM}, texts as (select file_id, 'symbol' as field, concat_ws(' ', name, array_to_string({_WORDS_SQL.format(c='name')}, ' '), owner, array_to_string({_WORDS_SQL.format(c='owner')}, ' ')) as text from s), lens as (select file_id, field, cast(sum(len({_DT})) as bigint) as dl from texts group by 1, 2)"

QUERIES = {
    "h1_bm25_top": (h1_bm25_top, f"with {_DOC_SQL.format(terms=_DT, q=tuple(_DOC_TERMS), x='')} select doc_id, round(score, 6) as score from bm order by round(score, 6) desc, doc_id limit 20"),
    "h1_bm25_fields": (h1_bm25_fields, f"with {TEXTS_SQL}, {_bm25_sql(_Q.terms)} select file_id, round(score, 6) as score from bm"),
    "h1_indexed_search": (h1_indexed_search, f"with {TEXTS_SQL}, {_bm25_sql(_Q.terms)} select file_id, round(score, 6) as score from bm"),
    "h2_field_population": (h2_field_population, f"with {TEXTS_SQL} select field, count(*) as n_files, cast(sum(dl) as bigint) as n_terms from lens group by 1"),
    "d25_corpus_statistics": (d25_corpus_statistics, f"select term, count(distinct doc_id) as df, count(*) as cf from (select doc_id, unnest({_DT}) as term from documents where text is not null) group by 1"),
    "h5_ranked_search": (h5_ranked_search, f"""with {TEXTS_SQL}, {_bm25_sql(_Q.terms)}, top as (select file_id, file_path, score from bm join source_files using (file_id) order by round(score, 9) desc, file_path, file_id limit 100),
        cand as (select s.* exclude (file_path, repo), top.file_path from s join top using (file_id)), cf as (select *, count(*) over (partition by lower(name)) as name_frequency from cand), {_scored_sql(_Q, 'cf')},
        best as (select file_id, max(case when rn = 1 then symbol_id end) as symbol_id, bool_or(boost_eligible) as boost, max(signal) as signal from (select *, row_number() over (partition by file_id order by {_ORDER_SQL}) as rn from sc where admitted) group by 1)
        select file_id, round(score * case when boost then 3.0 else 1.0 end * least(1 + coalesce(signal, 0.0), 1.6) * case when {_TEST_SQL} then 0.3 else 1.0 end + case when {_LANG_SQL} = 'typescript' then 2.0 when {_LANG_SQL} is not null then -1.5 else 0.0 end + case when {_EXT} = 'ts' then 0.75 else 0.0 end, 6) as score,
        symbol_id is null as symbol_fallback, symbol_id from top left join best using (file_id)"""),
    "h5_batch_search": (h5_batch_search, f"""with {SYM}, t as (select file_id, concat_ws(' ', name, array_to_string({_WORDS_SQL.format(c='name')}, ' ')) as text from s), post as (select file_id, term, count(*) as tf from (select file_id, unnest({_DT}) as term from t) group by 1, 2),
        lens as (select file_id, cast(sum(len({_DT})) as bigint) as dl from t group by 1), dfs as (select term, count(*) as df from post group by 1), one as (select (select avg(dl) from lens) as avgdl, (select count(*) from source_files) as n),
        q as (select search_text, unnest(list_distinct({_TERMS_SQL.format(c="concat_ws(' ', search_text, array_to_string(" + _WORDS_SQL.format(c="regexp_replace(search_text, ' ', '_', 'g')") + ", ' '))")})) as term from (select distinct search_text from search_results)),
        r as (select search_text, file_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) as score from q join post using (term) join dfs using (term) join lens using (file_id), one group by 1, 2)
        select search_text, file_id, score, rank from (select *, cast(row_number() over (partition by search_text order by score desc, file_id) as int) as rank from r) where rank <= 10"""),
    "c17_recall": (c17_recall, f"with {_RECALL_SQL} select * from rc"),
    "d11_benchmark_means": (d11_benchmark_means, f"with {_RECALL_SQL} select count(*) as n_queries, round(avg(recall), 6) as mean_recall, round(100 * avg(case when n_found <> n_expected then 1.0 else 0.0 end), 6) as percent_differing from rc"),
    "g5_same_results": (g5_same_results, "with a as (select distinct search_text, repo, file_path from search_results where symbol_fallback), b as (select distinct search_text, repo, file_path from search_results where not symbol_fallback) select *, 'fallback' as only_in from (select * from a except select * from b) union all select *, 'matched' from (select * from b except select * from a)"),
    "b9_term_hits": (b9_term_hits, f"{_ALL_SQL} select symbol_id, n_terms, n_names, n_owner, n_path from sc"),
    "b10_exact_hits": (b10_exact_hits, f"{_ALL_SQL} select symbol_id from sc where exact_hit"),
    "b11_boost_eligible": (b11_boost_eligible, f"{_ALL_SQL} select symbol_id from sc where boost_eligible"),
    "b12_admitted_symbols": (b12_admitted_symbols, f"{_ALL_SQL} select symbol_id, round(signal, 6) as signal from sc where admitted"),
    "b13_admitted_literals": (b13_admitted_literals, f"select * from (select literal_id, {_sum_hits(['text'], _Q.tokens)} as n_terms, text from (select distinct * from literals)) where n_terms = {len(_Q.tokens)} or lower(text) in {tuple(_Q.words)} or n_terms >= {math.ceil(len(_Q.tokens) / 2)}".replace("select * from", "select literal_id, n_terms from", 1)),
    "b14_qualified_literals": (b14_qualified_literals, "select text, count(*) as n_files from (select distinct file_id, lower(text) as text from literals) where regexp_matches(text, '^\\w+(?:(?:\\.|::)\\w+)+$') group by 1"),
    "c15_supplement": (c15_supplement, f"with {_SYMT_SQL}, {_bm25_sql(_Q2.terms)}, sf as (select s.*, 1 as name_frequency from s), {_scored_sql(_Q2, 'sf')}, p1 as (select distinct file_id from (select file_id, unnest({_DT}) as term from texts) where term in ('snapshotcache', 'fold_snapshot')) select file_id, round(score * 0.6, 6) as score from bm where file_id not in (select file_id from p1) and file_id in (select file_id from sc where n_owner > 0 and boost_eligible)"),
    "g1_union_of_candidates": (g1_union_of_candidates, f"with a as (with {_DOC_SQL.format(terms=_DT, q=('watcher', 'lock'), x='')} select doc_id, round(score, 6) as score from bm), b as (with {_DOC_SQL.format(terms=_DT, q=('snapshot', 'panel'), x='')} select doc_id, round(score * 0.6, 6) as score from bm) select * from a union all select * from b where doc_id not in (select doc_id from a)"),
    "d8_term_coverage": (d8_term_coverage, f"{_ALL_SQL} select file_id, max(n_terms) as best, cast(sum(n_terms) as bigint) as total, count(*) filter (admitted) as n_admitted from sc group by 1"),
    "d9_file_signal": (d9_file_signal, f"{_ALL_SQL} select file_id, round(least(1 + max(signal), 1.6), 6) as multiplier from sc where admitted group by 1"),
    "e1_symbol_order": (e1_symbol_order, f"{_ALL_SQL} select file_id, symbol_id, cast(row_number() over (partition by file_id order by {_ORDER_SQL}) as int) as rank from sc where admitted"),
    "e2_explaining_symbol": (e2_explaining_symbol, f"{_ALL_SQL} select file_id, symbol_id, name_frequency as n_same_name from (select *, row_number() over (partition by file_id order by {_ORDER_SQL}) as rn from sc where admitted) where rn = 1"),
    "e3_diversified": (e3_diversified, None),
    "f1_top_scores": (f1_top_scores, "select result_id, score from search_results where score is not null order by score desc, file_path, result_id limit 100"),
    "f2_ranks_per_query": (f2_ranks_per_query, "select search_text, result_id, rank from (select *, cast(row_number() over (partition by search_text order by score desc nulls last, file_path, result_id) as int) as rank from search_results) where rank <= 12"),
    "f8_capped_details": (f8_capped_details, f"with {SYM}, a as (select file_id, count(*) as n_symbols, max(symbol_id) as last_symbol from (select *, row_number() over (partition by file_id order by start_line, symbol_id) as rn from s) where rn <= 20 group by 1), b as (select file_id, count(*) as n_literals from (select *, row_number() over (partition by file_id order by line, literal_id) as rn from (select distinct * from literals)) where rn <= 10 group by 1) select * from a full join b using (file_id)"),
    "h7_fallback_files": (h7_fallback_files, f"{_ALL_SQL} select file_id, count(*) as n_symbols from sc group by 1 having not bool_or(admitted)"),
    "h8_unindexed_search": (h8_unindexed_search, f"with {SYM}, a as (select distinct file_id from s where contains(lower(name), 'fold') and contains(lower(name), 'snapshot')), b as (select distinct file_id from literals where contains(lower(text), 'fold') and contains(lower(text), 'snapshot')) select file_id, 'symbol' as by from a union all select file_id, 'literal' from b where file_id not in (select file_id from a)"),
    "i11_match_reasons": (i11_match_reasons, f"{_ALL_SQL} select symbol_id, case when boost_eligible then 'exact symbol name' when exact_hit then 'symbol name' when n_owner > 0 then 'owner and terms' when n_names > 0 then 'name terms' else 'documentation terms' end || ' (' || n_terms || ' of {len(_Q.tokens)} terms)' as reason from sc where admitted"),
}
