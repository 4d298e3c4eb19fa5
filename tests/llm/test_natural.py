import pytest

from quarrylens.llm import natural as nl

NATURAL = ["Waiting for the caller to become narrow again", "[glob] no stale entries were found in this folder", "<b>Are you sure you want to go on?</b>", "在不持有锁的情况下把过期的索引重新读取", "Returns the edge that belongs to it.\n\n@param a {string}\n@returns", "Copyright 2030 The X Authors. All rights reserved. See the LICENSE file for terms."]
NOT = [None, "", "  ", "Ordered caller", "SELECT a, count(*) FROM t WHERE x = ? GROUP BY y", "for item in reports: print(item)", ".query-list > li.pinned:hover", "^[a-z]+(segment|scope)$", "nev-tul-mor-osk", "text/plain; charset=utf-8", "@param a\n@param b\n@return", "if (a == null) return;\nfoo(a);", "curl -s -H 'X: y' https://h.example/v1", "TODO: document this.", "src/a/b/c.json", "一二三"]


@pytest.mark.parametrize("text", NATURAL)
def test_natural(text):
    assert nl.natural_part(text)


@pytest.mark.parametrize("text", NOT)
def test_not_natural(text):
    assert nl.natural_part(text) == ""


def test_own_name_does_not_count():
    assert nl.natural_part("load the big query", "loadTheBigQuery") == ""


def test_classifier_from_seeds():
    x, y = zip(*[(s, nl.CLASSES.index(k)) for k, v in nl.SEEDS.items() for s in v])
    w = nl.train(list(x), list(y))
    held = {"de": "Sortiert die offenen Sitzungen nach jeder Änderung", "fr": "Trie la liste des symboles avant la prochaine exécution", "es": "Ordena la lista de los símbolos después de cada cambio", "pt": "Ordena a lista dos símbolos depois de cada alteração", "en": "Sorts the list of symbols after each change", "ru": "Сортирует список символов после каждого изменения", "ko": "변경이 있을 때마다 심볼 목록을 정렬한다", "ja": "変更のたびにシンボルの一覧を並べ替えます", "zh": "每次修改之后对符号列表进行排序"}
    got = [nl.CLASSES[b] for b in nl.classify(w, list(held.values()))]
    assert got == list(held)


def test_operator_and_shares(spark):
    syms = spark.createDataFrame([(1, 1, "f", "Returns the edge that belongs to it.", "x"), (1, 1, "f", "Returns the edge that belongs to it.", "x"), (2, 1, "g", None, "x"), (3, 1, None, "Löscht alle Einträge aus der Liste.", "x"), (4, 1, "h", "", "x")], "symbol_id long, file_id long, name string, docstring string, text string")
    lits = spark.createDataFrame([(1, "Please wait until all of it is saved"), (2, None), (3, "utf-8"), (4, "ロックを保持せずに古い索引を読み直します")], "literal_id long, text string")
    got = sorted(tuple(r) for r in nl.natural_rows(syms, lits).collect())
    assert got == [("docstring", 1, "en"), ("docstring", 3, "de"), ("literal", 1, "en"), ("literal", 4, "ja")]
    code = "// Löscht alle Einträge aus der Liste.\nconst a = 'Please wait until all of it is saved';\n"
    files = spark.createDataFrame([(1, "a.js", code), (2, "b.js", None), (3, "c.unknown", code), (4, "d.js", code * 40)], "file_id long, file_path string, content string")
    whole = sorted((r.file_id, r.nl_lang, r.chars) for r in nl.language_shares(files, syms, lits).collect())
    pieces = sorted((r.file_id, r.nl_lang, r.chars) for r in nl.language_shares(files, syms, lits, piece_chars=300).collect())
    assert whole == pieces and [x[:2] for x in whole] == [(1, "de"), (1, "en"), (4, "de"), (4, "en")]
    assert nl.natural_rows(syms.limit(0), lits.limit(0)).count() == 0


def test_rows_come_from_the_classifier(monkeypatch):
    x, y = zip(*[(s, nl.CLASSES.index(k)) for k, v in nl.SEEDS.items() for s in v])
    w = nl.train(list(x), list(y))
    texts = ["Sortiert die offenen Sitzungen nach jeder Änderung", "Please wait until all of it is saved", "/** Sorts the list of symbols after each change */", None, "", "utf-8"]
    assert nl.label_spans(w, texts, [None] * 6) == ["de", "en", "en", None, None, None]
    monkeypatch.setattr(nl, "classify", lambda w, t: nl.np.full(len(t), nl.CLASSES.index("code")))
    assert nl.label_spans(w, texts, [None] * 6) == [None] * 6


def test_raw_comments_are_lexed():
    assert nl.span_text("/**\n * Reads it all.\n * @see x\n */") == "Reads it all. @see x" and nl.span_text("// a\n// b") == "a b" and nl.span_text("# one two") == "one two" and nl.span_text("plain  text") == "plain text"


@pytest.mark.parametrize("block", [1, 3, 256])
def test_start_states_by_two_levels(spark, monkeypatch, block):
    """The start state of each piece as a single run over the whole file gives it, however many blocks the prefix has."""
    from quarrylens.llm import lexer as L
    from quarrylens.llm import pieces as pc

    text = "".join(f"const a{i} = `x\n y{i}`; /* more\n of {i} */ // end\n" for i in range(60)) + "/* open\n" + "word word\n" * 60
    monkeypatch.setattr(pc, "BLOCK", block)
    files = spark.createDataFrame([(1, "a.js", text), (2, "b.js", "x\n" * 300)], "file_id long, file_path string, content string")
    got = {(r.file_id, r.k): (r.piece, r.start) for r in pc.pieces_with_start(files, 100).collect()}
    for i, t in ((1, text), (2, "x\n" * 300)):
        state, parts = L.CODE, L.pieces(t, 100)
        for k, piece in enumerate(parts):
            assert got[i, k] == (piece, state)
            state = L.spans(piece, "js", state)[1]
        assert sum(1 for j, _ in got if j == i) == len(parts) > 5


def test_held_out_repositories(data_dir):
    """Fitted on texts of some repositories, the classifier agrees on those of others with what scripts and function words tell."""
    import duckdb

    rows = duckdb.sql(f"select distinct repo, docstring from '{data_dir}/symbols.parquet' where length(docstring) > 20").fetchall() + duckdb.sql(f"select distinct repo, text from '{data_dir}/literals.parquet' where length(text) > 20").fetchall()
    repos = sorted({r for r, _ in rows})
    fit, held = [t for r, t in rows if repos.index(r) % 2], [t for r, t in rows if not repos.index(r) % 2]
    x, y = map(list, zip(*[(s, nl.CLASSES.index(k)) for k, v in nl.SEEDS.items() for s in v]))
    for t in fit:
        part = nl.natural_part(t)
        label = nl.weak_label(part) if part else nl.CLASSES.index("code") if " " in t.strip() else None
        if label is not None:
            x.append(nl.span_text(t) or t)
            y.append(label)
    w = nl.train(x, y)
    want = [nl.weak_label(nl.natural_part(t)) if nl.natural_part(t) else None for t in held]
    got = nl.label_spans(w, held, [None] * len(held))
    told = [(g, nl.LANGUAGES[v]) for g, v in zip(got, want) if v is not None]
    assert len(told) > 50 and sum(g == v for g, v in told) / len(told) > 0.97
