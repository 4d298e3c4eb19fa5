"""Encoding of a corpus with a public byte-level BPE tokenizer.

Short texts are encoded whole, in Arrow batches. A text over ``chunk_chars`` is cut into overlapping chunks that are
pre-tokenised in parallel; neighbouring chunks are stitched at the first pre-token boundary that both found inside
their overlap, and the pieces between stitches are encoded in parallel and concatenated in order.

Why the stitch is exact: the pre-token pattern scans left to right, looks behind nothing and ahead one character.
A chunk's boundaries from a true boundary on are true ones, save the last token that touches the chunk's end. So if
the left chunk, true from its own stitch on, and the right chunk share a boundary in the overlap, all boundaries of the
right chunk from there on are true. Where no shared boundary exists (a pre-token longer than the overlap) the whole
text is encoded in one piece, so the result is always that of encoding the text whole.

Defined cases: null and empty texts give an empty list; other columns of the input are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrylens.session import table

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# fixed value: the published pre-token pattern of this vocabulary
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
MAX_VOCABULARY_BYTES = 64 << 20

_encoders: dict[int, object] = {}


def _encoder(raw: bytes):
    key = hash(raw)
    if key not in _encoders:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line.strip())}
        _encoders[key] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[key]


def _encode_udf(vocabulary):
    """A mapInArrow function over (id, text) giving (id, ids array<int>)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(vocabulary.value)
        for b in batches:
            lists = [enc.encode_ordinary(t) if t else [] for t in b.column(1).to_pylist()]
            ids = pa.array(lists, type=pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), ids], names=[b.schema.names[0], "ids"])

    return run


def encode_corpus(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary_path: str = DEFAULT_VOCABULARY, chunk_chars: int = 16384, overlap: int = 256) -> DataFrame:
    """(id, ids array<int>) for each row of ``df``; see the module's text.

    The vocabulary is read on the driver and broadcast: a fixed file whose size is checked against
    ``MAX_VOCABULARY_BYTES``. Only texts over ``chunk_chars`` are shuffled.
    """
    spark = df.sparkSession
    with open(vocabulary_path, "rb") as f:
        raw = f.read(MAX_VOCABULARY_BYTES + 1)
    if len(raw) > MAX_VOCABULARY_BYTES:
        raise ValueError("vocabulary file is over the size bound for broadcasting")
    vocabulary = spark.sparkContext.broadcast(raw)
    d = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = "id long, ids array<int>"
    is_long = F.length("text") > chunk_chars
    short = d.filter(F.coalesce(~is_long, F.lit(True))).mapInArrow(_encode_udf(vocabulary), out)
    long = d.filter(is_long)
    return short.unionByName(_encode_long(long, vocabulary, chunk_chars, overlap)).withColumnRenamed("id", id_col)


def chunk_windows(n: int, chunk_chars: int, overlap: int) -> list[tuple[int, int, int]]:
    """(k, from, to) of each chunk's window: its core and ``overlap`` characters on either side."""
    return [(k, max(0, lo - overlap), min(n, lo + chunk_chars + overlap)) for k, lo in enumerate(range(0, n, chunk_chars))]


def pretoken_boundaries(text: str, whole_end: bool) -> list[int]:
    """Starts of pre-tokens; without the last one's end where more text follows the window."""
    import regex

    starts = [m.start() for m in regex.compile(PATTERN).finditer(text)]
    # the token that touches the window's end may go on in the text, so boundaries after its start aren't known
    return starts if not whole_end else [*starts, len(text)]


def _chunks(chunk_chars: int, overlap: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for i, t in zip(f["id"], f["text"]):
                rows = [(i, k, lo, len(t), t[lo:hi]) for k, lo, hi in chunk_windows(len(t), chunk_chars, overlap)]
                for at in range(0, len(rows), 256):
                    yield pd.DataFrame(rows[at : at + 256], columns=["id", "k", "lo", "n", "window"])

    return run


def _boundaries(chunk_chars: int, overlap: int):
    """Per chunk the boundaries, as positions in the whole text, in its left and right overlap."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            left, right = [], []
            for k, lo, n, w in zip(f["k"], f["lo"], f["n"], f["window"]):
                at = [lo + s for s in pretoken_boundaries(w, lo + len(w) == n)]
                core = k * chunk_chars
                # a window's first boundary is its own arbitrary start, unless the text starts there
                left.append([p for p in at if core - overlap < p <= core + overlap] if k else [])
                right.append([p for p in at if core + chunk_chars - overlap < p <= core + chunk_chars + overlap])
            yield f[["id", "k", "lo", "n", "window"]].assign(left=left, right=right)

    return run


def _encode_long(long: DataFrame, vocabulary, chunk_chars: int, overlap: int) -> DataFrame:
    chunk = long.mapInPandas(_chunks(chunk_chars, overlap), "id long, k int, lo long, n long, window string").repartition("id", "k")
    found = chunk.mapInPandas(_boundaries(chunk_chars, overlap), "id long, k int, lo long, n long, window string, left array<long>, right array<long>")
    w = Window.partitionBy("id").orderBy("k")
    stitched = found.withColumn("cut", F.when(F.col("k") == 0, F.lit(0).cast("long")).otherwise(F.array_min(F.array_intersect(F.lag("right").over(w), F.col("left")))))
    stitched = stitched.withColumn("next_cut", F.coalesce(F.lead("cut").over(w), F.when(F.lead("k").over(w).isNull(), F.col("n"))))
    whole = Window.partitionBy("id")
    stitched = stitched.withColumn("broken", F.max(F.when(F.col("cut").isNull(), 1).otherwise(0)).over(whole) == 1)
    pieces = stitched.filter(~F.col("broken")).select(
        F.struct("id", "k").alias("key"), F.expr("substring(window, cast(cut - lo as int) + 1, cast(next_cut - cut as int))").alias("piece")
    )

    def encode_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(vocabulary.value)
        for b in batches:
            lists = [enc.encode_ordinary(t) if t else [] for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(lists, type=pa.list_(pa.int32()))], names=["id", "k", "ids"])

    coded = pieces.select("key.id", "key.k", "piece").mapInArrow(encode_pieces, "id long, k int, ids array<int>")
    joined = coded.groupBy("id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("k", "ids"))), lambda x: x["ids"])).alias("ids"))
    unsplit = long.join(stitched.filter("broken").select("id").distinct(), "id", "left_semi").select("id", "text")
    return joined.unionByName(unsplit.mapInArrow(_encode_udf(vocabulary), "id long, ids array<int>"))


def decode(ids: list[int], vocabulary_path: str = DEFAULT_VOCABULARY) -> str:
    """Text of ids: the raw bytes of each, concatenated before decoding."""
    with open(vocabulary_path, "rb") as f:
        enc = _encoder(f.read())
    return b"".join(enc.decode_single_token_bytes(i) for i in ids).decode("utf-8", "replace")


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_corpus(table(spark, sf_dir, "documents"))


def p7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and tokens per language, over the whole corpus."""
    d = table(spark, sf_dir, "documents")
    ids = encode_corpus(d).select("doc_id", F.size("ids").cast("long").alias("n"))
    return d.select("doc_id", "lang").join(ids, "doc_id").groupBy("lang").agg(F.count("*").alias("n_docs"), F.sum("n").alias("n_tokens"))
