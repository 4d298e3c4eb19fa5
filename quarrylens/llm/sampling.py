"""A bounded, repeatable sample of texts for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_RANGE = 1 << 30


def sampled_texts(texts: DataFrame, rows: int, least_chars: int, most_chars: int | None = None) -> list[str]:
    """At most ``rows`` distinct texts (column ``text``) of ``least_chars`` characters or more, those of least hash.

    A hash threshold from the row count leaves about twice as many before anything is shuffled or sent, so what reaches the
    driver is bounded by ``rows``, however many partitions there are. Small tables are taken whole.
    """
    share = min(1.0, 2.0 * rows / max(1, texts.count()))
    length = F.length("text")
    d = texts.filter((length >= least_chars) & ((length <= most_chars) if most_chars else F.lit(True))).select("text", F.xxhash64("text").alias("h"))
    if share < 1:
        d = d.filter(F.pmod("h", F.lit(_RANGE)) < int(share * _RANGE))
    return [r.text for r in d.distinct().orderBy(F.pmod("h", F.lit(_RANGE)), "text").limit(rows).collect()]
