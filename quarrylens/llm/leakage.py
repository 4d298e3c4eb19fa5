"""Evaluation texts leaking into a corpus, by the q-gram lemma over overlapping diagonal bands.

Both sides are normalised to lower-case words (maximal runs of letters or digits) joined by one blank. A passage of L
characters shared within k edits leaves at least L + 1 - q(k + 1) common q-grams on diagonals at most k apart, so:

1. the q-grams of the items are indexed by hash (the items are a stated query set, taken in blocks of at most ``BLOCK_CHARS``
   characters, each block broadcast in its turn). q-grams that lie inside a standing instruction stay out of the index, so a document
   that holds nothing else meets no item, however many items begin with it; each passage's least count is lowered by those left out;
2. a corpus batch's q-grams are hashed with numpy and looked up; hits are counted per document, item and diagonal band,
   where bands overlap by half so that no pair of diagonals within k is split;
3. bands with enough hits become regions; in each the item's passages are aligned with the text by a banded edit
   distance, and a passage within the budget of k edits is a match;
4. with ``exact`` (``p8_found``) an exact check follows: twelve consecutive words that occur in at most two items.

The corpus is scanned once per block without any shuffle; only the found pairs leave the tasks. Defined cases: null
and empty texts never match; repeated documents each report their own matches; items without twelve words never match;
exact duplicate rows count once. Where ``q`` isn't given it is the largest of 16, 8 and 4 for which the lemma bounds the shortest passage
of the block; for passages shorter than 4(k + 1) characters it bounds nothing and one common q-gram is asked for.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylens.session import table

BLOCK_CHARS = 8_000_000
WORD = re.compile(r"[^\W_]+")
_MUL = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def qgram_hashes(codes: np.ndarray, q: int) -> np.ndarray:
    """Polynomial hashes (mod 2^64) of all q-grams of a code-point array; q is a power of two."""
    h, m, size = codes.astype(np.uint64) + np.uint64(1), _MUL, 1
    with np.errstate(over="ignore"):
        while size < q:
            if len(h) <= size:
                return np.zeros(0, np.uint64)
            h = h[:-size] * m + h[size:]
            m, size = m * m, size * 2
        return (h ^ (h >> np.uint64(29))) * _MUL


def _codes(s: str) -> np.ndarray:
    return np.frombuffer(s.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


class ItemIndex:
    """Sorted q-gram index of a block of items (id, text, starts of the standing passages among its words), with each
    item's least hit count for a region."""

    def __init__(self, items: list[tuple[int, str, list[int]]], q: int | None, min_words: int, max_edits: int, exact: bool) -> None:
        self.min_words, self.max_edits, self.exact = min_words, max_edits, exact
        self.ids, self.words, self.joined, self.passages = [], [], [], []
        stands: list[list[tuple[int, int]]] = []
        for item_id, text, standing in items:
            w = words_of(text)
            starts = sorted(set(range(len(w) - min_words + 1)) - set(standing))
            if not starts:
                continue
            at = np.concatenate([[0], np.cumsum([len(x) + 1 for x in w])])
            span = lambda j: (int(at[j]), int(at[j + min_words]) - 1)  # noqa: B023, E731
            self.ids.append(item_id)
            self.words.append(w)
            self.joined.append(" ".join(w))
            self.passages.append([(j, *span(j)) for j in starts])
            stands.append([span(j) for j in standing])
        shortest = min((e - s for p in self.passages for _, s, e in p), default=0)
        self.q = q or next((x for x in (16, 8, 4) if exact or shortest + 1 - x * (max_edits + 1) >= 1), 4)
        self.grams = [{tuple(w[j : j + min_words]) for j, _, _ in p} for w, p in zip(self.words, self.passages)]
        self.codes = [_codes(t) for t in self.joined]
        self.shortest = [min(e - s for _, s, e in p) for p in self.passages]
        self.longest = [max(e - s for _, s, e in p) for p in self.passages]
        need, h_all, i_all, p_all = [], [], [], []
        for i, (text, passages, stand) in enumerate(zip(self.joined, self.passages, stands)):
            h = qgram_hashes(_codes(text), self.q)
            kept = np.ones(len(h), bool)
            for s, e in stand:  # with the blanks around, which say nothing of what follows
                kept[max(0, s - 1) : max(s, e - self.q + 2)] = False
            for _, s, e in passages:  # a passage all of whose q-grams lie in standing ones keeps them
                if not kept[s : e - self.q + 1].any():
                    kept[s : e - self.q + 1] = True
            before = np.concatenate([[0], np.cumsum(kept)])
            least = min(int(before[min(len(h), max(s, e - self.q + 1))] - before[min(len(h), s)]) for _, s, e in passages)
            need.append(max(1, least - self.q * max_edits))
            pos = np.flatnonzero(kept)
            h_all.append(h[pos])
            i_all.append(np.full(len(pos), i, np.int64))
            p_all.append(pos.astype(np.int64))
        cat = lambda xs, t: np.concatenate(xs) if xs else np.zeros(0, t)
        h = cat(h_all, np.uint64)
        order = np.argsort(h, kind="stable")
        self.h, self.item, self.pos = h[order], cat(i_all, np.int64)[order], cat(p_all, np.int64)[order]
        self.need = np.array(need, np.int64)
        self.bits = np.zeros(1 << 22, bool)
        self.bits[(self.h >> np.uint64(42)).astype(np.int64)] = True

    def regions(self, texts: list[str]) -> list[tuple[int, int, int, int, int, int]]:
        """(text number, item number, first and last character position in the text, least and largest diagonal) of
        each band with enough common q-grams. ``texts`` are normalised."""
        joined = "\n".join(texts)
        lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        start = np.concatenate([[0], np.cumsum(lengths)])[:-1]
        h = qgram_hashes(_codes(joined), self.q)
        if not len(h) or not len(self.h):
            return []
        at = np.flatnonzero(self.bits[(h >> np.uint64(42)).astype(np.int64)])
        a, b = np.searchsorted(self.h, h[at], "left"), np.searchsorted(self.h, h[at], "right")
        n = b - a
        at, a, n = at[n > 0], a[n > 0], n[n > 0]
        if not len(at):
            return []
        entry = np.repeat(a - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        at = np.repeat(at, n)
        doc = np.searchsorted(start, at, "right") - 1
        dpos = at - start[doc]
        item, diag = self.item[entry], dpos - self.pos[entry]
        half = max(4, self.max_edits + 1)  # bands of 2 * half diagonals, each overlapping the next by half
        out = set()
        for shift in (0, half):
            band = (diag + shift) // (2 * half)
            order = np.lexsort((dpos, band, item, doc))
            d, i, g, p, dg = doc[order], item[order], band[order], dpos[order], diag[order]
            first = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (i[1:] != i[:-1]) | (g[1:] != g[:-1])]))
            count = np.diff(np.concatenate([first, [len(d)]]))
            ok = count >= self.need[i[first]]
            for f, c in zip(first[ok], count[ok]):
                x = dg[f : f + c]
                out.add((int(d[f]), int(i[f]), int(p[f]), int(p[f + c - 1]) + self.q, int(x.min()), int(x.max())))
        return sorted(out)

    def matches(self, text: str, item: int, lo: int, hi: int, d0: int, d1: int) -> bool:
        """Whether the region holds a passage of the item: word for word, or within ``max_edits`` edits."""
        x, t = self.codes[item], _codes(text)
        if self.exact:
            return self.verbatim(text, item, t, x, lo, hi, d0, d1)
        return self.aligned(item, t, x, lo, hi, d0, d1)

    def verbatim(self, text: str, item: int, t: np.ndarray, x: np.ndarray, lo: int, hi: int, d0: int, d1: int) -> bool:
        """The exact check: a passage that stands word for word is a run of equal characters on one diagonal."""
        least, more, grams = self.shortest[item], self.longest[item], self.grams[item]
        for d in range(d0, d1 + 1):
            # a passage may begin or end in a standing one, outside the region's hits
            for s, e in equal_runs(t, x, d, lo - more, hi + more, least):
                # words cut at the run's ends don't count
                s = s if s == 0 or text[s - 1] == " " else text.find(" ", s, e) + 1
                e = e if e == len(text) or text[e] == " " else text.rfind(" ", s, e)
                w = text[s:e].split() if 0 <= s < e else []
                if any(tuple(w[j : j + self.min_words]) in grams for j in range(len(w) - self.min_words + 1)):
                    return True
        return False

    def aligned(self, item: int, t: np.ndarray, x: np.ndarray, lo: int, hi: int, d0: int, d1: int) -> bool:
        """Passages with as many common q-grams in the band as the lemma asks for, standing ones with them, meet the text in a
        banded alignment."""
        k, q = self.max_edits, self.q
        common = np.zeros(len(x) + 1, np.int64)
        more = self.longest[item] + k
        for d in range(d0 - k, d1 + k + 1):
            for s, e in equal_runs(t, x, d, lo - more, hi + more, q):
                common[s - d + 1 : e - d - q + 2] = 1
        total = np.cumsum(common)
        for _, s, e in self.passages[item]:
            if e - q + 1 > s and total[e - q + 1] - total[s] >= max(1, e - s + 1 - q * (k + 1)) and banded_edits(x[s:e], t, s + d0 - k, s + d1 + k) <= k:
                return True
        return False


def equal_runs(t: np.ndarray, x: np.ndarray, d: int, lo: int, hi: int, least: int) -> list[tuple[int, int]]:
    """Runs [s, e) of ``least`` or more positions of ``t`` from ``lo`` to ``hi`` with ``t[p] == x[p - d]``."""
    lo, hi = max(lo, d, 0), min(hi, len(t), len(x) + d)
    if hi - lo < least:
        return []
    edge = np.flatnonzero(np.diff(np.concatenate([[False], t[lo:hi] == x[lo - d : hi - d], [False]])))
    s, e = edge[::2], edge[1::2]
    long = e - s >= least
    return [(lo + int(a), lo + int(b)) for a, b in zip(s[long], e[long])]


def banded_edits(x: np.ndarray, text: np.ndarray, first: int, last: int) -> int:
    """Least edit distance of ``x`` to a part of ``text`` that begins at ``first`` to ``last``, on the diagonals of these
    starts only. Cell d of a row holds the distance where ``d + first + row`` characters of the text lie before it."""
    width = last - first + 1
    n, big = len(text), 1 << 20
    step = np.arange(width)
    at = first + step
    row = np.where((at >= 0) & (at <= n), 0, big)
    for i, c in enumerate(x):
        pos = at + i  # the character of the text that x[i] meets on each diagonal
        inside = (pos >= 0) & (pos < n)
        same = np.zeros(width, bool)
        same[inside] = text[pos[inside]] == c
        kept = np.where(inside, row + ~same, big)
        lost = np.append(row[1:], big) + 1  # x[i] left out
        best = np.minimum(kept, lost)
        row = np.minimum.accumulate(best - step) + step  # characters of the text put in
        row = np.where(pos + 1 <= n, row, np.minimum(best, big))
    return int(row.min())


def with_standing(items: DataFrame, min_words: int, least_items: int) -> DataFrame:
    """Items (i, t) with ``standing``: where among its words passages of ``min_words`` begin that occur in ``least_items``
    items or more."""
    words = F.regexp_extract_all(F.lower("t"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    w = items.select("i", words.alias("w")).filter(F.size("w") >= min_words)
    each = w.select("i", "w", F.explode(F.sequence(F.lit(0), F.size("w") - min_words)).alias("p")).select("i", "p", F.array_join(F.slice("w", F.col("p") + 1, min_words), " ").alias("gram"))
    often = each.groupBy("gram").agg(F.countDistinct("i").alias("n")).filter(F.col("n") >= least_items).select("gram")
    starts = each.join(often, "gram").groupBy("i").agg(F.collect_set("p").alias("standing"))
    return items.join(starts, "i", "left")


def item_blocks(items: DataFrame) -> Iterator[list[tuple[int, str, list[int]]]]:
    """The items in blocks of bounded size, fetched one at a time."""
    size = items.agg(F.sum(F.length("t")).alias("c")).first()
    blocks = max(1, -(-int(size.c or 0) // BLOCK_CHARS))
    part = F.pmod(F.xxhash64("i"), F.lit(blocks))
    for k in range(blocks):
        yield [(r.i, r.t, r.standing or []) for r in items.filter(part == k).select("i", "t", "standing").collect()]


def leaked_items(
    docs: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    doc_text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    min_words: int = 12,
    least_standing: int = 3,
    q: int | None = None,
    max_edits: int = 1,
    exact: bool = True,
) -> DataFrame:
    """(doc_id, item_id) of documents and items that share a passage of ``min_words`` words that isn't a standing
    instruction (a run that occurs in ``least_standing`` items or more).

    Regions are those within ``max_edits`` edits of characters; with ``exact`` a shared passage must then stand there word for
    word, without it the edited passage itself counts. See the module's text.
    """
    spark = docs.sparkSession
    named = items.select(F.col(item_id).alias("i"), F.col(item_text).alias("t")).filter(F.col("t").isNotNull()).distinct()
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(doc_text).alias("text")).filter(F.length("text") > 0)
    schema = f"doc_id long, item_id {dict(named.dtypes)['i']}"
    found = None
    for block in item_blocks(with_standing(named, min_words, least_standing)):
        index = spark.sparkContext.broadcast(ItemIndex(block, q, min_words, max_edits, exact))
        part = d.mapInPandas(_searcher(index), schema)
        found = part if found is None else found.unionByName(part)
    return found.distinct()


def _searcher(index):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ix: ItemIndex = index.value
        for f in frames:
            texts, ids = [" ".join(words_of(t)) for t in f["text"]], f["doc_id"].tolist()
            hit: set[tuple[int, object]] = set()
            for at in _slices(texts):
                for doc, item, lo, hi, d0, d1 in ix.regions(texts[at]):
                    t = texts[at][doc]
                    key = (ids[at.start + doc], ix.ids[item])
                    if key not in hit and ix.matches(t, item, lo, hi, d0, d1):
                        hit.add(key)
            yield pd.DataFrame(sorted(hit), columns=["doc_id", "item_id"])

    return run


def _slices(texts: list[str], chars: int = 2_000_000) -> Iterator[slice]:
    """Slices of about ``chars`` characters; a longer text is a slice of its own."""
    start = total = 0
    for i, t in enumerate(texts):
        if total and total + len(t) > chars:
            yield slice(start, i)
            start, total = i, 0
        total += len(t) + 1
    if start < len(texts):
        yield slice(start, len(texts))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p8_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, item_id) of documents that hold a passage of twelve words of an item within two edits of characters."""
    return leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"), max_edits=2, exact=False)


def p8_leaks_per_item(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents per leaked item."""
    return p8_found(spark, sf_dir).groupBy("item_id").agg(F.count("*").alias("n_docs"))


P8_FOUND_SQL = r"""
with iw as (select distinct item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as w from eval_items where text is not null),
ig as (select item_id, unnest(list_transform(range(1, len(w) - 10), lambda p: array_to_string(w[p:p+11], ' '))) as gram from iw where len(w) >= 12),
st as (select gram from ig group by gram having count(distinct item_id) < 3),
ok as (select distinct item_id, gram from ig semi join st using (gram)),
dw as (select doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as w from documents where text is not null),
dg as (select doc_id, unnest(list_transform(range(1, len(w) - 10), lambda p: array_to_string(w[p:p+11], ' '))) as gram from dw where len(w) >= 12)
select distinct doc_id, item_id from dg join ok using (gram)
"""
P8_LEAKS_SQL = f"select item_id, count(*) as n_docs from ({P8_FOUND_SQL}) group by item_id"
