import random

import pytest

from quarrylens.llm import personal as pe

GIVEN, FAMILY = ["Anouk", "Emil", "Freya", "Jonas", "Noor", "Pavel", "Vera", "Yusuf"], ["Havquist", "Bramdorff", "Solxen", "Kelovar", "Tirnokov", "Mibsberg"]
NOISE = ["Build 352-89-7010 was dirty, the fingerprint read 4626:161.", "47 Merge Lane workers and 27 Nimsev Way stations share the lease.", "Ticket 230-551-6932 covers ports 4149-6979.", "loxtan@8.3.4 pins loxtan@next, so it stays.", "Clone it with git@forge.x.example:a/b.git now.", "The Bribra Kamlor release of x ships readers.", "root@tirmib:~# app fold"]


def sample(rng):
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    g, f = rng.choice(GIVEN), rng.choice(FAMILY)
    lines = [f"Reported by {g} {f} on Monday.", f"Signed-off-by: {g} {f} <{g.lower()}.{f.lower()}@mib.example>", f"You can reach me at {d(3)} 555 {d(4)} after lunch.", f"tel: +44 7700 90{d(4)}", f"SSN: 9{d(2)} {d(2)} {d(4)}", f"passport no.: X{d(8)}", f"I moved to {d(2)} Kelyel Avenue last month.", f"Write to {g.lower()} (at) mib (dot) example if it happens."]
    return "\n".join(rng.sample(lines, 3) + rng.sample(NOISE, 3))


@pytest.fixture(scope="module")
def fitted():
    rng = random.Random(1)
    texts = [sample(rng) for _ in range(500)]
    given = pe.given_names(texts)
    common = pe.common_words(texts)
    return pe.train(texts, [pe.weak_spans(t, given, common) for t in texts], common, epochs=7, windows=1500), given, common


def test_given_names_from_phrases(fitted):
    assert fitted[1] == set(GIVEN)


def test_held_out_accuracy(fitted):
    model, given, common = fitted
    rng = random.Random(99)
    texts = [sample(rng) for _ in range(80)]
    want = [{(t[s:e], k) for s, e, k in pe.weak_spans(t, given, common)} for t in texts]
    got = [{(t[s:e], k) for s, e, k in found} for t, found in zip(texts, pe.find(model, texts))]
    hit = sum(len(a & b) for a, b in zip(want, got))
    assert hit / sum(map(len, want)) > 0.93 and hit / sum(map(len, got)) > 0.93


def test_windows_are_reconciled(fitted):
    """A long stretch cut into overlapping windows is decided as one."""
    model, _, _ = fitted
    rng = random.Random(5)
    t = " ".join(sample(rng).replace("\n", " ") for _ in range(20))
    tags, _ = pe.tag_stretches(model, [t])[0]
    assert len(tags) == len(t) > 4 * pe.WINDOW and len({int(x) for x in tags}) > 4


def test_sequences_cover_the_text():
    rng = random.Random(6)
    for _ in range(100):
        t = "".join(rng.choice(["word ", "x. ", "\n", "longwordwithoutend"]) for _ in range(rng.randrange(400)))
        parts = pe.sequences(t)
        assert "".join(t[a:b] for a, b in parts) == t and all(b - a < 2000 for a, b in parts)


def test_candidate_extents():
    c = lambda t: {(t[s:e], k) for s, e, k in pe.candidates(t)}
    assert ("a.b+c@x-y.mail.example", "email") in c("<a.b+c@x-y.mail.example>.") and ("jo AT x DOT example", "email") in c("is jo AT x DOT example for")
    assert not any(k == "email" for _, k in c("git@forge.x.example:a/b.git pkg@8.3.4 root@host:~#"))
    assert ("+49 (0)30 23125-166", "phone") in c("unter +49 (0)30 23125-166 zu") and ("020 7946 0558", "phone") in c("is 020 7946 0558 24 workers")
    assert ("954 Roslor Street, Flat 8B", "address") in c("at 954 Roslor Street, Flat 8B on") and ("Calle Zorlor 68, 5.º C", "address") in c("a Calle Zorlor 68, 5.º C, 67478 Prayor") and ("미르로 12번길 34", "address") in c("보드는 미르로 12번길 34, 12345 로")
    assert ("독고찬솔", "person_name") in c("담당자는 독고찬솔 입니다")


def test_replace_keeps_the_rest():
    t = "a x@y.zz b"
    assert pe.replace(t, [(2, 8, "email")]) == "a [EMAIL] b" and pe.replace(None, []) is None and pe.replace("", []) == ""


def test_gradients_by_differences():
    import numpy as np

    m = pe.Tagger(3)
    rng = np.random.default_rng(0)
    codes, mask, tags = rng.integers(0, 60, (7, 3)), np.ones((7, 3), bool), rng.integers(0, pe.TAGS, (7, 3))
    mask[5:, 1] = False
    for k in m.p:
        m.p[k] = m.p[k].astype(np.float64)
    _, g = m.loss_and_gradients(codes, mask, tags)
    for k, i in [("o", (3, 2)), ("uf", (5, 70)), ("ub", (1, 9)), ("a", (2, 4)), ("xf", (int(codes[2, 0]), 11)), ("c", (1,))]:
        old = m.p[k][i]
        m.p[k][i] = old + 1e-4
        up, _ = m.loss_and_gradients(codes, mask, tags)
        m.p[k][i] = old - 1e-4
        down, _ = m.loss_and_gradients(codes, mask, tags)
        m.p[k][i] = old
        assert abs((up - down) / 2e-4 - g[k][i]) < 2e-3, k


def test_operator(spark):
    rng = random.Random(7)
    rows = [(i, sample(rng), "x") for i in range(60)] + [(100, None, "x"), (101, "", "x"), (102, "nothing here", "x")]
    d = spark.createDataFrame(rows, "doc_id long, text string, pii_type string")
    got = pe.personal_details(d).collect()
    assert {r.doc_id for r in got} <= set(range(60)) and len({tuple(r) for r in got}) == len(got)
    assert pe.personal_details(d.limit(0)).count() == 0


@pytest.fixture(scope="module")
def from_seeds():
    """A model fitted on the sentences written by hand alone."""
    rows = pe.sentences(4000)
    return pe.train([t for t, _ in rows], [s for _, s in rows], epochs=22, batch=64, windows=4000)


HELD_OUT = [
    ("Could you ask Edward Hughes whether the parcel arrived?", {("Edward Hughes", "person_name")}), ("My name is rosa martin ruiz and I need help.", {("rosa martin ruiz", "person_name")}), ("Call me on +44 20 7946 1234 tonight.", {("+44 20 7946 1234", "phone")}), ("write to lena.fox@post.example for details", {("lena.fox@post.example", "email")}),
    ("Her SSN: 372-91-8842 was on the form.", {("372-91-8842", "id_number")}), ("They live at 48 Cherry Lane now.", {("48 Cherry Lane", "address")}), ("제 이름은 김하준입니다.", {("김하준", "person_name")}), ("住所は東京都千代田区霞が関3-2です。", {("東京都千代田区霞が関3-2", "address")}), ("Меня зовут Анна Соколов, здравствуйте", {("Анна Соколов", "person_name")}), ("我叫王小芳,很高兴。", {("王小芳", "person_name")}),
]


def test_held_out_sentences(from_seeds):
    """Sentences, names and numbers that aren't among those written for training."""
    found = pe.find(from_seeds, [t for t, _ in HELD_OUT])
    got = [{(t[s:e], k) for s, e, k in f} for (t, _), f in zip(HELD_OUT, found)]
    assert sum(w <= g for (_, w), g in zip(HELD_OUT, got)) >= 7, got


def test_runs_without_a_pattern_come_from_the_network(from_seeds):
    """No pattern meets a Japanese or Russian address: the network alone finds it."""
    text = "Меня зовут Анна Попова, я живу по адресу ул. Ленина, д. 12."
    for t, want in ((text, "ул. Ленина, д. 12"), ("住所は大阪市北区梅田3-2-1です。", "大阪市北区梅田3-2-1")):
        assert not any(k == "address" for _, _, k in pe.candidates(t))
        assert (want, "address") in {(t[s:e], k) for s, e, k in pe.find(from_seeds, [t])[0]}
    blank = pe.Tagger()
    blank.p = {k: v * 0 for k, v in blank.p.items()}
    assert pe.find(blank, [text, *(t for t, _ in HELD_OUT)]) == [[]] * 11


def test_model_is_stored_once(spark, monkeypatch):
    d = spark.createDataFrame([(i, f"Reported by Emil Solxen on day {i} of the long week of work") for i in range(30)], "doc_id long, text string")
    calls = []
    small = pe.train
    monkeypatch.setattr(pe, "SEED_ROWS", 200)
    monkeypatch.setattr(pe, "_VERSION", f"test {random.random()}")
    monkeypatch.setattr(pe, "train", lambda *a: calls.append(1) or small(*a, epochs=1, windows=200))
    a, b = pe.fitted(d, "text"), pe.fitted(d, "text")
    assert len(calls) == 1 and all((a.p[k] == b.p[k]).all() for k in a.p) and a.common == b.common


def all_names(monkeypatch):
    """Lets the tagger confirm every candidate for a name, so that what is offered to it shows."""
    k = pe.TYPES.index("person_name")
    monkeypatch.setattr(pe, "tag_stretches", lambda model, texts: [(pe.np.array([2 * k + 1] + [2 * k + 2] * (len(t) - 1)), pe.np.zeros(len(t))) for t in texts])


def test_common_words_may_be_names(monkeypatch):
    all_names(monkeypatch)
    model = pe.Tagger()
    model.common = frozenset({"mark", "will", "may", "case"})
    texts = ["see Mark Olsen now", "see Will Turner now", "see May Case now"]
    assert [{t[s:e] for s, e, k in f} for t, f in zip(texts, pe.find(model, texts))] == [{"Mark Olsen"}, {"Will Turner"}, {"May Case"}]


def test_commonness_is_a_feature():
    t = "by Mark Olsen"
    assert [int(x) for x in pe.np.flatnonzero(pe.char_codes(t) != pe.char_codes(t, frozenset({"mark"})))] == [3]
    tags = pe.np.array([0, 0, 0] + [2 * pe.TYPES.index("person_name") + 1] + [2 * pe.TYPES.index("person_name") + 2] * 9 + [0])
    seen = {pe._varied(t + ".", tags, [("Emil", "Solxen")], pe.np.random.default_rng(i), ["will"])[0] for i in range(60)}
    assert "by Will Solxen." in seen and "by Emil Solxen." in seen


def test_candidates_of_all_forms(monkeypatch):
    c = lambda t: {(t[s:e], k) for s, e, k in pe.candidates(t)}
    for name in ("김민수", "이영희", "王小明", "山田太郎"):
        assert (name, "person_name") in c(f"by {name} now")
    for name in ("Ludwig van Beethoven", "Maria de la Cruz", "Иван Петров"):
        assert (name, "person_name") in c(f"by {name} now")
    for number in ("01012345678", "5551234567", "555 0199", "5550199"):
        assert (number, "phone") in c(f"call {number} now")
    all_names(monkeypatch)
    assert {t for t in pe.find(pe.Tagger(), ["by 김민수 now"])[0]} == {(3, 6, "person_name")}


def test_extent_inside_a_run():
    """A name and what is attached to it are one run of a script; the tags tell the name's end."""
    t = "담당자는 김민수입니다"
    k = 2 * pe.TYPES.index("person_name")
    tags = pe.np.array([0] * 5 + [k + 1, k + 2, k + 2] + [0] * 3)
    assert pe.decide(t, pe.candidates(t), tags) == [(5, 8, "person_name")]


def test_bare_numbers_need_a_word_to_be_labels():
    spans = lambda t: {(t[s:e], k) for s, e, k in pe.weak_spans(t, set())}
    assert ("5551234567", "phone") in spans("phone 5551234567, thanks") and not spans("check out 176087715 now")
