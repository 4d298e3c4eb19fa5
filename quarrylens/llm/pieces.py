"""Files cut into pieces with the lexer state that each piece begins in, found by a parallel prefix over state maps."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylens.llm import lexer as L

#: Files up to this length stay in one piece.
PIECE_CHARS = 1 << 18
#: Pieces whose maps are folded together before the prefix over blocks.
BLOCK = 256


def _cut(piece_chars: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for i, p, t in zip(f["file_id"], f["file_path"], f["content"]):
                family = L.FAMILY[L.extension(p)]
                for k, piece in enumerate(L.pieces(t[1:] if t[:1] == "\ufeff" else t, piece_chars)):
                    yield pd.DataFrame([(i, k, family, piece)], columns=["file_id", "k", "family", "piece"])

    return run


def _maps(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        yield pd.DataFrame({"file_id": f["file_id"], "k": f["k"], "map": [list(L.state_map(p, m)) for m, p in zip(f["family"], f["piece"])]})


def pieces_with_start(files: DataFrame, piece_chars: int = PIECE_CHARS) -> DataFrame:
    """(file_id, k, family, piece, start) of files (file_id, file_path, content) whose extension has a lexer.

    The prefix runs over a few small integers a piece, in two levels, so that no step sees more than ``BLOCK`` maps or one map a
    block: the maps of a block are folded, the prefix runs over the blocks' maps, then inside each block from its start state.
    No piece of text meets another one.
    """
    cut = files.mapInPandas(_cut(piece_chars), "file_id long, k int, family string, piece string").repartition("file_id", "k")
    maps = cut.mapInPandas(_maps, "file_id long, k int, map array<int>").withColumn("block", F.expr(f"k div {BLOCK}"))
    blocks = maps.groupBy("file_id", "block").agg(F.array_sort(F.collect_list(F.struct("k", "map"))).alias("maps"))
    identity = F.array(*[F.lit(s) for s in L.STATES])
    compose = lambda first, m: F.transform(first, lambda s: F.element_at(m["map"], s + 1))
    folded = blocks.select("file_id", "block", F.aggregate("maps", identity, compose).alias("map"))
    first = folded.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("block", "map"))).alias("maps"))
    begins = first.select("file_id", F.posexplode(_starts(F.col("maps"), F.lit(L.CODE))).alias("i", "begin"), "maps").select("file_id", F.col("maps")[F.col("i")]["block"].alias("block"), "begin")
    inside = blocks.join(begins, ["file_id", "block"]).select("file_id", "maps", F.posexplode(_starts(F.col("maps"), F.col("begin"))).alias("i", "start"))
    return cut.join(inside.select("file_id", F.col("maps")[F.col("i")]["k"].alias("k"), "start"), ["file_id", "k"])


def _starts(maps, begin):
    """Column: the start state of each map in order, the first being ``begin``; one pass."""
    return F.aggregate(
        maps,
        F.struct(F.array().cast("array<int>").alias("out"), begin.cast("int").alias("at")),
        lambda acc, m: F.struct(F.array_append(acc["out"], acc["at"]).alias("out"), F.element_at(m["map"], acc["at"] + 1).alias("at")),
        lambda acc: acc["out"],
    )
