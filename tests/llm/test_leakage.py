import random

import numpy as np
import pytest
from compare import connect, rows

from quarrylens.llm import leakage as lk

DOC, ITEM = "doc_id long, text string, item_id long, lang string", "item_id long, task_id string, text string"


def brute(docs, items):
    grams = {}
    for i, _, t in items:
        w = lk.words_of(t)
        for j in range(len(w) - 11):
            grams.setdefault(tuple(w[j : j + 12]), set()).add(i)
    out = set()
    for d, t, *_ in docs:
        w = lk.words_of(t)
        for j in range(len(w) - 11):
            g = grams.get(tuple(w[j : j + 12]), set())
            if len(g) < 3:
                out |= {(d, i) for i in g}
    return sorted(out)


def run(spark, docs, items):
    return sorted((r.doc_id, r.item_id) for r in lk.leaked_items(spark.createDataFrame(docs, DOC), spark.createDataFrame(items, ITEM)).collect())


def test_cases(spark):
    p = "one two three four five six seven eight nine ten eleven twelve"
    standing = "always begin with this same long standing instruction that every single item has"
    items = [(1, "t", f"{p} and more"), (2, "t", f"{standing} alpha"), (3, "t", f"{standing} beta"), (4, "t", f"{standing} gamma"), (5, "t", None), (6, "t", "too short"), (7, "t", f"x {p}"), (7, "t", f"x {p}")]
    docs = [
        (1, f"intro {p.upper()} outro", 0, ""), (2, p.replace(" ", ",\n * "), 0, ""), (3, p.replace("six", "SIXTY"), 0, ""), (4, standing, 0, ""), (5, None, 0, ""), (6, "", 0, ""), (7, p[:-7], 0, ""), (8, f"intro {p.upper()} outro", 0, ""),
        (9, f"{p.replace('twelve', '')} twelve {standing} beta and so on with words", 0, ""), (10, "a b c d e f g h i j k l", 0, ""),
    ]
    items.append((8, "t", "a b c d e f g h i j k l m"))
    assert run(spark, docs, items) == brute(docs, items) == [(1, 1), (1, 7), (2, 1), (2, 7), (8, 1), (8, 7), (9, 1), (9, 3), (9, 7), (10, 8)]


def test_random(spark):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(40)] + ["ä", "漢"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, "t", text(rng.randrange(5, 60))) for i in range(20)]
    docs = []
    for i in range(40):
        src = lk.words_of(rng.choice(items)[2])
        k = rng.randrange(max(1, len(src) - 5))
        docs.append((i, f"{text(20)} {' '.join(src[k : k + rng.randrange(8, 20)])} {text(9)}", 0, ""))
    assert run(spark, docs, items) == brute(docs, items)


def test_blocks_give_the_same(spark, monkeypatch):
    items = [(i, "t", " ".join(f"q{i}x{j}" for j in range(20))) for i in range(9)]
    docs = [(i, items[i][2], 0, "") for i in range(9)]
    whole = run(spark, docs, items)
    monkeypatch.setattr(lk, "BLOCK_CHARS", 200)
    assert run(spark, docs, items) == whole == [(i, i) for i in range(9)]


def test_against_sql(spark, data_dir):
    con = connect(data_dir)
    assert rows(lk.p8_found(spark, data_dir).toPandas()) == rows(con.execute(lk.P8_FOUND_SQL).df())


def test_empty(spark):
    assert lk.leaked_items(spark.createDataFrame([], DOC), spark.createDataFrame([], ITEM)).count() == 0


def test_passage_off_the_word_diagonals(spark):
    """Edits of equal length with other word counts before and after the passage: it lies three word diagonals off."""
    p = "one two three four five six seven eight nine ten eleven twelve"
    head, tail = "the quick brown foxes jumped over", "all lazy dogs that slept under trees"
    items = [(1, "t", f"{head} in a few days {p} international {tail}")]
    docs = [(1, f"{head} international {p} in a few days {tail}", 0, "")]
    assert run(spark, docs, items) == brute(docs, items) == [(1, 1)]


def edits(a, b):
    """Least edit distance of ``a`` to any part of ``b``, by the whole table."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def test_banded_edits():
    rng = random.Random(5)
    code = lambda s: np.frombuffer(s.encode("utf-32-le"), np.uint32)
    for _ in range(200):
        a = "".join(rng.choice("abcd") for _ in range(rng.randrange(1, 25)))
        b = list(a)
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.randrange(2)] = rng.choice(["", "x", "a"])
        text = "zz" + "".join(b) + "zzz"
        assert lk.banded_edits(code(a), code(text), -len(a), len(text)) == edits(a, text)


@pytest.mark.parametrize("change,least", [
    (("seventh", "sevemth"), 1), (("seventh", "seven"), 2), (("seventh ", ""), 8), (("fifth sixth", "fifthsixth"), 1), (("fifth", "fiffth"), 1), (("eighth", "eihgth"), 2), (("tenth", "tnth"), 1), (("sixth seventh eighth", "sxth seventh eigth"), 2), (("third fourth fifth", "thrd foorth fiftth"), 3),
])
def test_passages_with_edits(spark, change, least):
    """One to three edits in the middle, insertions and deletions: found from a budget of so many on, and never word for word."""
    p = "first second third fourth fifth sixth seventh eighth ninth tenth eleventh twelfth"
    docs = spark.createDataFrame([(1, f"some words before {p.replace(*change)} and some after", 0, "")], DOC)
    items = spark.createDataFrame([(1, "t", p)], ITEM)
    for k in (1, 2, 3):
        assert lk.leaked_items(docs, items, max_edits=k, exact=False).count() == (least <= k)
    assert lk.leaked_items(docs, items, max_edits=3).count() == 0


def test_standing_texts_give_no_regions():
    standing = "always begin with this same long standing instruction that every single item of them has"
    n = len(standing.split()) - 11
    index = lk.ItemIndex([(i, f"{standing} own words number {i} about {i * 7} things", list(range(n))) for i in range(300)], None, 12, 1, True)
    assert index.regions([standing, f"before {standing} after"]) == []
    assert {r[1] for r in index.regions([f"{standing} own words number 5 about 35 things"])} >= {5}
