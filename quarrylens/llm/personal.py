"""Personal information in free text, found and replaced by typed placeholders.

1. Every text goes whole through a character-level bidirectional LSTM with CRF transitions, trained in numpy: it is cut into
   overlapping windows, each character keeps the scores of the window that sees most around it, and one Viterbi pass over each
   line (no detail crosses a line's end; very long ones in sentences) decides the tags.
2. Runs of tags become details. Broad patterns for addresses of mail, numbers, streets and capitalised words tell the exact extent
   of a run: a pattern's span is found where three in ten of its characters or more carry its type's tags, for names the run of words
   so tagged. A run that no pattern meets stands by itself, out to its words' ends, where it has the characters of its type.

The model is fitted on sentences written by hand (``personal_seeds``) and on a bounded sample of the corpus (``SAMPLE_ROWS`` documents
of at most ``SAMPLE_LONGEST`` characters, by hash order), labelled by strict forms and the words around them. It is fitted once on the driver and kept
in the shared checkpoint folder under the hash of its sample; its weights (some hundred KB) are broadcast.

Defined cases: null and empty texts hold nothing; a detail repeated in a document is one row; documents are read whole.
"""

from __future__ import annotations

import io
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylens.llm.personal_seeds import sentences
from quarrylens.llm.sampling import sampled_texts
from quarrylens.session import checkpoint_dir, table

TYPES = ["email", "phone", "id_number", "address", "person_name"]
#: Documents that the model may be fitted on, and the longest of them; sentences written by hand beside them.
SAMPLE_ROWS, SAMPLE_LONGEST, SEED_ROWS = 8000, 4000, 1500

# ---------------------------------------------------------------- candidates

_UP = r"A-ZÀ-ÖØ-ÞŁŚŻČŠŽŐŰ"
_LO = r"a-zß-öø-ÿłśżčšžőűąęćńźďěňřťůğışță"
_AT = re.compile(r"@| ?[(\[{]at[)\]}] ?| AT ")
_LOCAL = re.compile(r"(?:^|(?<=[^\w.+-]))[A-Za-z0-9][\w.+-]*$")
_DOMAIN = re.compile(r"[A-Za-z0-9][\w-]*(?:(?:\.| ?[(\[{]dot[)\]}] ?| DOT )[A-Za-z0-9][\w-]*)*(?:\.| ?[(\[{]dot[)\]}] ?| DOT )[A-Za-z]{2,}(?![\w-]|\.\w|:[\w/])")
_PHONE = re.compile(
    r"(?<![\w.@/:+#-])(?:\(\+\d{1,3}\)|\+\d{1,3}|00\d{2}|\(0?\d{2,4}\)|0\d{1,4}|\d{3}(?=[ .]))(?:[ ./-]?\(0\))?(?:[ ./-]?\d{1,12})(?:[ ./-]\d{2,6}){0,5}(?![\w@-]|[.:]\d)"
)
_ID = re.compile(
    r"""(?x)(?<![\w.@/:-])(?=[A-Z]{0,2}[ -]?\d)(?:
      [A-Z]{2}[ ]?\d{2}[ ]?\d{2}[ ]?\d{2}[ ]?[A-Z] | \d{3}[- ]\d{2}[- ]\d{4} | \d{8}-?[A-Z] | [A-Z]-?\d{7}-?[A-Z] | [A-Z]\d{4}-\d{5}-\d{4} | [A-Z]\d{8} | \d{2}[A-Z]{2}\d{5} | [A-Z]{2}\d{6,7}
    | [A-Z]\d{3}[A-Z]\d{4} | [A-Z][0-9A-Z]{8}\d? | [12][ ]?\d{2}[ ]?\d{2}[ ]?\d{2}[ ]?\d{3}[ ]?\d{3}(?:[ ]?\d{2})? | \d{2}[ ]\d{3}[ ]\d{3}[ ]\d{3} | \d{6}-\d{7} | \d{3}\.\d{3}\.\d{3}-\d{2} | \d{11}
    )(?![\w@-]|\.\d)"""
)
# fixed values: words for streets and for parts of a house
_STREET = r"Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Way|Court|Ct|Crescent|Cres|Close|Drive|Dr|Place|Pl|Square|Sq|Terrace|Boulevard|Blvd|Row|Hill|Gardens|Grove|Mews|Park|Walk|Parade"
_UNIT = r"(?:,? (?:Flat|Apt|Apartment|Unit|Suite|Ste|Room|Floor)\.? ?\w{1,5}| ?#\w{1,5})"
_EN_ADDRESS = re.compile(rf"(?<![\w.@/:-])\d{{1,5}}[A-Za-z]? (?:[{_UP}][\w'’-]+ ){{1,3}}(?:{_STREET})\b{_UNIT}?")
# forms of other languages, each tried where one of its words stands in the text
_ADDRESSES = [
    (
        ("rue ", "avenue ", "boulevard ", "place ", "chemin ", "allée ", "impasse ", "quai ", "cours ", "square ", "route "),
        re.compile(
            rf"(?<![\w.@/:-])\d{{1,4}}(?: bis| ter| quater)?,? (?:rue|avenue|boulevard|place|chemin|allée|impasse|quai|cours|square|route)(?: (?:des|de la|de l['’]|du|de|d['’]|la|le|les))? ?[{_UP}][\w'’-]+(?: [{_UP}][\w'’-]+)*"
        ),
    ),
    (
        ("straße ", "strasse ", "str. ", "weg ", "gasse ", "platz ", "allee ", "ring ", "damm ", "ufer ", "steig "),
        re.compile(rf"(?<![\w-])[{_UP}][{_LO}]+(?:straße|strasse|str\.|weg|gasse|platz|allee|ring|damm|ufer|steig) \d{{1,4}} ?[a-z]?\b"),
    ),
    (
        ("Am ", "An der ", "Im ", "Zum ", "Zur ", "Auf de", "In der ", "Unter den ", "Alte"),
        re.compile(rf"(?<![\w-])(?:Am|An der|Im|Zum|Zur|Auf dem|Auf der|In der|Unter den|Alte[rn]?) [{_UP}][\w-]+ \d{{1,4}} ?[a-z]?\b"),
    ),
    (
        ("Calle", "C/", "Av", "Plaza", "Paseo", "Camino", "Ronda", "Rua", "Travessa", "Praça", "Via", "Piazza"),
        re.compile(
            rf"(?<![\w-])(?:Calle|C/|Avenida|Avda\.?|Av\.|Plaza|Paseo|Camino|Ronda|Rua|Travessa|Praça|Via|Piazza) ?(?:de(?: la| los| las|l)? |d[aeo]s? )?[{_UP}][\w'’-]+(?: [{_UP}][\w'’-]+)*,? (?:n\.?º ?)?\d{{1,4}}(?:, \d{{1,2}}\.?[ºª°](?: ?[A-Z]\b| (?:izq|dcha|esq)\b\.?)?)?"
        ),
    ),
    (
        ("로 ", "길 ", "로", "길"),
        re.compile(r"[가-힣]{1,6}(?:로|길|대로)(?: ?\d{1,4}번?길)? \d{1,4}(?:-\d{1,4})?(?: ?번지)?(?:,? \d{1,4}동)?(?: \d{1,4}호)?(?![\d가-힣])"),
    ),
]
_UPN, _LON = _UP + "А-ЯЁІЇЄҐΑ-ΩĞİŞ", _LO + "а-яёіїєґα-ωά-ώ"
_TOKEN = rf"(?:(?:[DdLlO]['’])?[{_UPN}][{_LON}]+(?:(?:-|['’](?!s\b))[{_UPN}{_LON}]+)*|[{_UPN}]{{3,}}(?:-[{_UPN}]{{2,}})*|[{_UPN}]{{2}}(?= [{_UPN}]))"
# fixed values: lower-case words inside names
_PARTICLE = r"(?:van|von|vom|zu|zum|zur|de|del|della|den|der|di|da|do|dos|das|du|la|las|los|le|el|al|bin|ibn|ben|ter|ten|af|av|y|e|i)"
# fixed values: words that begin sentences and are no part of a name
_NO_NAME = r"(?:The|This|That|These|In|On|At|If|It|We|You|They|He|She|Use|See|Run|When|Only|After|Must|Why|Does|Explain|Build|Ticket|Recall|Returns|Takes|Ping|Clone|Subject|Review|Nothing|Please|Viele|Hi|Hello|Dear|Ask|Cc|Yesterday|As|Hallo|Liebe|Lieber|Grüße|Thanks|Die|Der|Das|Le|La|Les|El|Los|Las)\b"
_NAMES = re.compile(rf"(?<![\w@.+/-])(?!{_NO_NAME}){_TOKEN}(?:,? (?:[{_UPN}]\. )?(?:{_PARTICLE} ){{0,3}}{_TOKEN})+(?![\w@/(]|-\w|\.\w)")
_NAME_TOKEN = re.compile(rf"{_TOKEN}|[{_UPN}]\.")
# whole runs of scripts without capitals: a name in them is what the tagger marks
_SCRIPT_RUN = re.compile(r"[가-힣]{2,}|[\u3400-\u9fff\u3041-\u30ff々・]{2,}|[\u0590-\u05ff\u0620-\u06ff\u0900-\u097f\u0e00-\u0e7f]{2,}(?: [\u0590-\u05ff\u0620-\u06ff\u0900-\u097f\u0e00-\u0e7f]{2,}){0,3}")
# fixed values: Korean family names of two syllables; with them a name shows by itself
_HANGUL_NAME = re.compile(r"(?<![가-힣])(?:남궁|황보|제갈|사공|선우|서문|독고|동방|망절|어금|소봉|장곡|강전)[가-힣]{1,2}(?![가-힣])")


_BARE_NUMBER = re.compile(r"(?<![\w.@/:+#-])\d{7,15}(?![\w@-]|[.:]\d)")
# fixed values: ways to write a number; a candidate that runs on into another number ends where one of these does
_PHONE_FORMS = re.compile(
    r"""(?x)^(?: (?:\+\d{2}|00\d{2})[ ]\d{4}[ ]\d{6} | (?:\+\d{2}|00\d{2}|\(\+\d{2}\))[ ]?\d{2}[ -]\d{4}[ -]\d{4} | \+33[ ]\d(?:[ ]\d\d){4} | 0\d(?:[ .]\d\d){4} | \+34[ ]\d{3}(?:[ ]\d\d){3} | \+34[ ]\d{3}[ ]\d{3}[ ]\d{3}
      | (?:\+1[ .-])?\(?\d{3}\)?[ .-]\d{3}[ .-]\d{4} | 0\d{2}[ ]\d{4}[ ]\d{4} | 0\d{3}[ ]\d{3}[ ]\d{3} | 01\d[- ]\d{4}[- ]\d{4} | 0\d{3}/\d{7} | \(0\d{2}\)[ ]\d{5}[ ]\d{3} | 0\d{2}[ ]\d{5}[ ]\d{3} | \+49[ ]\(0\)\d{2}[ ]\d{5}-\d{3} | \+\d{11,13} )$"""
)


def _phone_end(s: str) -> int:
    """Length of the longest beginning that is a whole number in a known form, else of all."""
    for cut in [len(s), *(m.start() for m in reversed(list(re.finditer(r"[ ./-]", s))))]:
        if _PHONE_FORMS.match(s[:cut]):
            return cut
    return len(s)


def _phone_like(s: str) -> bool:
    digits = sum(c.isdigit() for c in s)
    return 7 <= digits <= 15 and not re.fullmatch(r"\d{3}-\d{2}-\d{4}", s)


def _emails(text: str) -> list[tuple[int, int, str]]:
    out = []
    for m in _AT.finditer(text):
        lo = max(0, m.start() - 80)
        left = _LOCAL.search(text[lo : m.start()])
        right = _DOMAIN.match(text, m.end()) if left else None
        if right and not (out and lo + left.start() < out[-1][1]):
            out.append((lo + left.start(), right.end(), "email"))
    return out


def candidates(text: str) -> list[tuple[int, int, str]]:
    """Broad candidates (start, end, type); those of one type don't overlap."""
    out = _emails(text)
    out += [(m.start(), m.start() + _phone_end(m[0]), "phone") for m in _PHONE.finditer(text) if _phone_like(m[0])]
    taken = {(s, e) for s, e, _ in out}
    out += [(*m.span(), "phone") for m in _BARE_NUMBER.finditer(text) if m.span() not in taken]
    out += [(m.start(), m.end(), "id_number") for m in _ID.finditer(text) if sum(c.isdigit() for c in m[0]) >= 5]
    out += [(m.start(), m.end(), "address") for m in _EN_ADDRESS.finditer(text)]
    hangul = not text.isascii() and re.search("[가-힣]", text) is not None
    for words, p in _ADDRESSES[: None if hangul else -1]:
        if any(w in text for w in words):
            out += [(m.start(), m.end(), "address") for m in p.finditer(text)]
    out += [(m.start(), m.end(), "person_name") for m in _NAMES.finditer(text)]
    if not text.isascii():
        out += [(m.start(), m.end(), "person_name") for m in _SCRIPT_RUN.finditer(text)]
    return sorted(out)


def common_words(texts: list[str], least: int = 8) -> frozenset[str]:
    """Words that, in ``least`` of the texts or more, stand in lower case between blanks, or begin a sentence and are followed
    by a word in lower case."""
    seen: dict[str, int] = {}
    for t in texts:
        low = re.findall(rf"(?<=[\s])[{_LO}]+(?=[\s.,;:!?])", t)
        first = re.findall(rf"(?:^|[.!?:]\s|\n)([{_UP}][{_LO}]+)(?= [{_LO}@#(0-9\"'`])", t)
        for w in {*low, *(w.lower() for w in first)}:
            seen[w] = seen.get(w, 0) + 1
    return frozenset(w for w, n in seen.items() if n >= least)


# ---------------------------------------------------------------- labels for the training sample

_NOT_PHONE = re.compile(r"(?i)(?<![A-Za-z])(?:build|ticket|run id|ports|port|recall|session=\S*|step=|read|release|version|v|id|pid|line|bytes from|@@ [-+]\S*) ?\Z")
_PHONE_WORD = re.compile(r"(?i)(?:\b(?:tel|phone|call|mobile|cell|fax|whatsapp|reach me at|téléphone|telefon|telefonnummer|teléfono|móvil|handy)|전화|연락처)\W{0,6}\Z")
_ID_WORD = re.compile(r"(?i)\bSSN\b|social security|tax id|\bNINO\b|national insurance|passport|licen[cs]e|\bID card|identity card|\bDNI\b|\bNIE\b|\bNIF\b|passeport|sécurité sociale|carte d['’]identité|ausweis|steuer-?id|reisepass|personalausweis|sozialversicherung|주민등록번호|여권번호|운전면허|id number|pasaporte|seguridad social|\bCPF\b")
_NOT_ADDRESS = re.compile(r"^ [a-z]{5,}s\b")  # a count and what is counted
_INTRODUCES = re.compile(
    rf"(?:Signed-off-by: |Co-authored-by: |Reviewed-by: |(?:Reported|Reviewed|Written|Approved) by |@author |(?:Assigned|Thanks) to |(?:Dr|Mr|Mrs|Ms|Prof)\. |I am |[Mm]y name is |Dear |Herr |Frau |Merci à |Madame |Monsieur |Gracias a |Señora? )([{_UP}][{_LO}]+) (?:[{_UP}]\. )?[{_UP}][{_LO}]+"
)


def given_names(texts: list[str], least: int = 2) -> set[str]:
    """First names by the phrases that introduce people."""
    seen: dict[str, int] = {}
    for t in texts:
        for m in _INTRODUCES.finditer(t):
            seen[m[1]] = seen.get(m[1], 0) + 1
    return {n for n, c in seen.items() if c >= least}


def weak_spans(text: str, given: set[str], common: frozenset[str] = frozenset()) -> list[tuple[int, int, str]]:
    """Labelled spans of a sample text, by strict forms and the words around the candidates."""
    out = []
    for s, e, kind in candidates(text):
        before, after = text[max(0, s - 48) : s], text[e : e + 32]
        if kind == "phone" and (_NOT_PHONE.search(before) or _ID_WORD.search(before[-40:]) or _ID_WORD.match(after.lstrip(" (")) or re.fullmatch(r"\d{3} \d{2} \d{4}|\d{2} \d{3} \d{3} \d{3}", text[s:e])):
            continue
        if kind == "phone" and (text[s:e].isdigit() and not text.startswith("00", s) or sum(c.isdigit() for c in text[s:e]) < 9) and not _PHONE_WORD.search(before):
            continue  # a short or bare number needs a word that says what it is
        if kind == "id_number" and not (_ID_WORD.search(re.split(r"\n|[.!?] (?=[A-Z])", before)[-1]) or re.match(r" \(", after) and _ID_WORD.search(after)):
            continue
        if kind == "address" and _NOT_ADDRESS.match(after):
            continue
        if kind == "person_name" and _SCRIPT_RUN.match(text, s):
            if _HANGUL_NAME.fullmatch(text, s, e):
                out.append((s, e, kind))
            continue
        if kind == "person_name":
            out += [(a, b, kind) for a, b in _given_pairs(text, s, e, given, common)]
            continue
        out.append((s, e, kind))
    return _disjoint(out)


def _given_pairs(text: str, s: int, e: int, given: set[str], common: frozenset[str]) -> list[tuple[int, int]]:
    tokens = [(m.start() + s, m.end() + s, m[0]) for m in _NAME_TOKEN.finditer(text[s:e])]
    out, used = [], -1
    for i, (a, b, w) in enumerate(tokens):
        if w.title() not in given or i <= used or w.lower() in common:
            continue
        j = i + 1
        if j < len(tokens) and len(tokens[j][2]) == 2 and tokens[j][2].endswith("."):
            j += 1
        if i > 0 and i - 1 > used and text[tokens[i - 1][1] : a] == ", " and tokens[i - 1][2].lower() not in common:
            out.append((tokens[i - 1][0], b))
            used = i
        elif j < len(tokens) and "," not in text[b : tokens[j][0]] and tokens[j][2].lower() not in common:
            out.append((a, tokens[j][1]))
            used = j
    return out


def _disjoint(spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    out: list[tuple[int, int, str]] = []
    for x in sorted(spans, key=lambda x: (x[0] - x[1], x[0])):
        if all(x[1] <= a or x[0] >= b for a, b, _ in out):
            out.append(x)
    return sorted(out)


# ---------------------------------------------------------------- windows

_AROUND = {"email": (12, 6), "phone": (24, 8), "id_number": (44, 26), "address": (20, 12), "person_name": (24, 14)}
WINDOW, OVERLAP = 160, 48


def stretches(text: str, found: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """Merged surroundings of the candidates."""
    out: list[list[int]] = []
    for s, e, kind in found:
        a, b = max(0, s - _AROUND[kind][0]), min(len(text), e + _AROUND[kind][1])
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


# ---------------------------------------------------------------- the network

_CHARS = 256
HIDDEN = 32
TAGS = 1 + 2 * len(TYPES)  # O, then begin and inside of each type


_CAPITALISED = re.compile(rf"(?<![\w])[{_UP}][{_LO}]+")


def char_codes(text: str, common: frozenset[str] = frozenset()) -> np.ndarray:
    """Small numbers for characters: ASCII its own, others by script and case; capitals that begin a word of ``common``
    have numbers of their own, so commonness is a feature that the words around may outweigh."""
    out = _plain_codes(text)
    if common:
        for m in _CAPITALISED.finditer(text):
            if m[0].lower() in common:
                out[m.start()] = 160 + ord(m[0][0]) - 65 if m[0][0] <= "Z" else 186
    return out


def _plain_codes(text: str) -> np.ndarray:
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    if (c < 128).all():
        return c.astype(np.uint8)
    out = np.full(len(c), 130, np.int64)
    out = np.where(c < 128, c, out)
    out = np.where((c >= 0xC0) & (c <= 0xDE), 131, out)
    out = np.where((c >= 0xDF) & (c <= 0x24F), 132, out)
    out = np.where((c >= 0x400) & (c <= 0x52F), 133, out)
    out = np.where((c >= 0x3040) & (c <= 0x30FF), 134, out)
    out = np.where((c >= 0x4E00) & (c <= 0x9FFF), 135, out)
    out = np.where((c >= 0xAC00) & (c <= 0xD7A3), 136 + (c - 0xAC00) // 588, out)  # Hangul by first letter
    return out.astype(np.uint8)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Tagger:
    """Bidirectional LSTM over characters with a linear-chain CRF on top, in numpy."""

    def __init__(self, seed: int = 7) -> None:
        self.common: frozenset[str] = frozenset()
        r, h = np.random.default_rng(seed), HIDDEN
        f = np.float32
        self.p = {}
        for d in "fb":
            self.p["x" + d] = (r.standard_normal((_CHARS, 4 * h)) * 0.3).astype(f)
            self.p["u" + d] = (r.standard_normal((h, 4 * h)) / np.sqrt(h)).astype(f)
            self.p["x" + d][:, h : 2 * h] += 1.0  # forget less at first
        self.p["o"] = (r.standard_normal((2 * h, TAGS)) * 0.2).astype(f)
        self.p["c"] = np.zeros(TAGS, f)
        self.p["a"] = np.zeros((TAGS, TAGS), f)

    def _run(self, codes: np.ndarray, mask: np.ndarray, d: str, keep: bool):
        """codes (T, B); the hidden states (T, B, h) of one direction, already in the order of time."""
        T, B = codes.shape
        h = HIDDEN
        X, U = self.p["x" + d], self.p["u" + d]
        H, C = np.zeros((B, h), np.float32), np.zeros((B, h), np.float32)
        hs = np.empty((T, B, h), np.float32)
        saved = []
        for t in range(T) if d == "f" else range(T - 1, -1, -1):
            z = X[codes[t]] + H @ U
            s = _sigmoid(z[:, : 3 * h])
            g = np.tanh(z[:, 3 * h :])
            c2 = s[:, h : 2 * h] * C + s[:, :h] * g
            tc = np.tanh(c2)
            h2 = s[:, 2 * h :] * tc
            if keep:
                saved.append((t, H, C, s, g, tc))
            m = mask[t][:, None]
            if m.all():
                H, C = h2, c2
            else:
                H, C = np.where(m, h2, H), np.where(m, c2, C)
            hs[t] = H
        return hs, saved

    def _states(self, codes: np.ndarray, mask: np.ndarray, d: str) -> np.ndarray:
        """The hidden states of one direction without what training keeps: gates as half a tanh, buffers used again."""
        T, B = codes.shape
        h = HIDDEN
        half = np.ones(4 * h, np.float32)
        half[: 3 * h] = 0.5
        X, U = self.p["x" + d] * half, self.p["u" + d] * half
        H, C = np.zeros((B, h), np.float32), np.zeros((B, h), np.float32)
        hs = np.empty((T, B, h), np.float32)
        z, g = np.empty((B, 4 * h), np.float32), np.empty((B, h), np.float32)
        for t in range(T) if d == "f" else range(T - 1, -1, -1):
            np.matmul(H, U, out=z)
            z += X[codes[t]]
            np.tanh(z, out=z)
            s = z[:, : 3 * h]
            s += 1
            s *= 0.5
            np.multiply(s[:, :h], z[:, 3 * h :], out=g)
            c2 = s[:, h : 2 * h] * C
            c2 += g
            h2 = np.tanh(c2)
            h2 *= s[:, 2 * h :]
            m = mask[t]
            if m.all():
                H, C = h2, c2
            else:
                H, C = np.where(m[:, None], h2, H), np.where(m[:, None], c2, C)
            hs[t] = H
        return hs

    def emissions(self, codes: np.ndarray, mask: np.ndarray) -> np.ndarray:
        both = np.concatenate([self._states(codes, mask, "f"), self._states(codes, mask, "b")], axis=2)
        return both @ self.p["o"] + self.p["c"]

    def loss_and_gradients(self, codes: np.ndarray, mask: np.ndarray, tags: np.ndarray):
        T, B = codes.shape
        h, A = HIDDEN, self.p["a"]
        hf, sf = self._run(codes, mask, "f", True)
        hb, sb = self._run(codes, mask, "b", True)
        hh = np.concatenate([hf, hb], axis=2)
        e = hh @ self.p["o"] + self.p["c"]
        # CRF: forward and backward sums, each step scaled to sum to one
        top = e.max(axis=2, keepdims=True)
        E, M = np.exp(e - top), np.exp(A)
        al, be = np.empty_like(e), np.ones_like(e)
        log_z = np.zeros(B)
        x = E[0]
        for t in range(T):
            if t:
                x = (al[t - 1] @ M) * E[t]
            n = x.sum(axis=1, keepdims=True)
            m = mask[t][:, None]
            al[t] = np.where(m, x / n, al[t - 1]) if t else x / n
            log_z += np.where(mask[t], np.log(n[:, 0]) + top[t, :, 0], 0)
        gA = np.zeros_like(A)
        for t in range(T - 1, 0, -1):
            right = E[t] * be[t]
            x = right @ M.T
            norm = (al[t - 1] * x).sum(axis=1, keepdims=True)
            m = mask[t][:, None]
            gA += (np.where(m, al[t - 1] / norm, 0).T @ right) * M
            be[t - 1] = np.where(m, x / x.sum(axis=1, keepdims=True), be[t])
        post = al * be
        post *= mask[:, :, None] / post.sum(axis=2, keepdims=True)
        gold = np.eye(TAGS, dtype=e.dtype)[tags] * mask[:, :, None]
        de = (post - gold) / B
        pairs = (tags[:-1] * TAGS + tags[1:])[mask[1:]]
        counts = np.bincount(pairs, minlength=TAGS * TAGS).reshape(TAGS, TAGS)
        gA = ((gA - counts) / B).astype(A.dtype)
        z, score = log_z.mean(), ((e * gold).sum() + (counts * A).sum()) / B
        grads = {"a": gA, "c": de.sum(axis=(0, 1)), "o": np.einsum("tbi,tbj->ij", hh, de)}
        dh = de @ self.p["o"].T
        for d, saved, part in (("f", sf, dh[:, :, :h]), ("b", sb, dh[:, :, h:])):
            U = self.p["u" + d]
            gX, gU = np.zeros_like(self.p["x" + d]), np.zeros_like(U)
            all_dz = np.empty((T, B, 4 * h), e.dtype)
            dH, dC = np.zeros((B, h), np.float32), np.zeros((B, h), np.float32)
            for t, H0, C0, s, g, tc in reversed(saved):
                m = mask[t][:, None].astype(np.float32)
                dh2 = (dH + part[t]) * m
                keep_h, keep_c = (dH + part[t]) * (1 - m), dC * (1 - m)
                i, f, o = s[:, :h], s[:, h : 2 * h], s[:, 2 * h :]
                dc2 = dC * m + dh2 * o * (1 - tc * tc)
                dz = np.concatenate([dc2 * g * i * (1 - i), dc2 * C0 * f * (1 - f), dh2 * tc * o * (1 - o), dc2 * i * (1 - g * g)], axis=1)
                all_dz[t] = dz
                gU += H0.T @ dz
                dH = dz @ U.T + keep_h
                dC = dc2 * f + keep_c
            flat = codes.ravel()
            order = np.argsort(flat, kind="stable")
            seen, first = np.unique(flat[order], return_index=True)
            gX[seen] = np.add.reduceat(all_dz.reshape(-1, 4 * h)[order], first, axis=0)
            grads["x" + d], grads["u" + d] = gX, gU
        return float(z - score), grads

    def viterbi(self, e: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """Best tags (T, B)."""
        T, B, _ = e.shape
        to_from = np.ascontiguousarray(self.p["a"].T)[None]
        back = np.zeros((T, B, TAGS), np.int8)
        v = e[0]
        for t in range(1, T):
            x = v[:, None, :] + to_from
            k = x.argmax(axis=2)
            n = np.take_along_axis(x, k[:, :, None], 2)[:, :, 0] + e[t]
            m = mask[t][:, None]
            v = np.where(m, n, v)
            back[t] = np.where(m, k, np.arange(TAGS)[None])
        out = np.empty((T, B), np.int64)
        out[-1] = v.argmax(axis=1)
        rows = np.arange(B)
        for t in range(T - 1, 0, -1):
            out[t - 1] = back[t][rows, out[t]]
        return out


def _padded(rows: list[np.ndarray], dtype) -> tuple[np.ndarray, np.ndarray]:
    n = max(map(len, rows))
    out, mask = np.zeros((n, len(rows)), dtype), np.zeros((n, len(rows)), bool)
    for j, r in enumerate(rows):
        out[: len(r), j] = r
        mask[: len(r), j] = True
    return out, mask


_DIGIT = re.compile(r"\d")


# fixed values: parts of names of other scripts and forms, drawn in training only
_HANGUL_FAMILIES = "김 이 박 최 정 강 조 윤 장 임 한 오 서 신 권 황 안 송 류 홍 전 고 문 양 손 배 백 허 유 남 심 노 하 곽 성 차 주 우 구 민 남궁 황보 제갈 사공 선우 서문 독고 동방".split()
_HANGUL_GIVEN = "민 수 영 희 지 훈 서 준 현 우 진 은 하 연 도 윤 예 성 재 혜 주 경 미 정 태 호 동 승 유 나 래 마 루 솔 빛 다 온 가 람 누 리 찬".split()
_HAN_FAMILIES = "王 李 张 刘 陈 杨 黄 赵 吴 周 徐 孙 马 朱 胡 林 郭 何 高 罗 山田 佐藤 鈴木 高橋 田中 伊藤 渡辺 中村 小林 加藤".split()
_HAN_GIVEN = "小明 伟 芳 娜 秀英 敏 静 丽 强 磊 军 洋 勇 艳 杰 涛 太郎 花子 健一 美咲 陽子 大輔 直樹 恵子".split()
_CYRILLIC = "Иван Пётр Анна Мария Олег Сергей Ольга Дмитрий".split(), "Петров Иванова Смирнов Кузнецова Соколов Попова Волков Морозов".split()
_PARTICLES = "van,von,de,de la,van der,del,di,da,dos,bin,von der".split(",")
_AFTER_HANGUL = ["가", "는", "은", "이", "의", "에게", "입니다", "님이", "와"]


def _foreign(rng: np.random.Generator, hangul: bool) -> str:
    """A name in another script."""
    pick = lambda xs: xs[rng.integers(len(xs))]
    kind = 0 if hangul else rng.integers(4)
    if kind == 0:
        family = pick(_HANGUL_FAMILIES)
        return family + pick(_HANGUL_GIVEN) + (pick(_HANGUL_GIVEN) if rng.random() < 0.9 else "")
    if kind == 1:
        return f"{pick(_CYRILLIC[0])} {pick(_CYRILLIC[1])}"
    return pick(_HAN_FAMILIES) + pick(_HAN_GIVEN)


def _varied(text: str, tags: np.ndarray, names: list[tuple[str, str]], rng: np.random.Generator, words: list[str] = []) -> tuple[str, np.ndarray]:
    """A copy of a labelled window with other digits in its labelled spans and other names, in other orders and cases;
    some of these hold one of ``words``."""
    kinds = (tags + 1) // 2
    chars = list(text)
    for i in np.flatnonzero((kinds == 2) | (kinds == 3) | (kinds == 4)):
        if chars[i].isdigit() and rng.random() < 0.8:
            chars[i] = str(rng.integers(0, 10))
    if rng.random() < 0.15:  # phone numbers as bare digits
        keep = np.array([k != 2 or c.isdigit() for k, c in zip(kinds, chars)], bool)
        lost = np.flatnonzero(~keep & (tags == 3))  # a first character that goes leaves its tag to the next
        tags = tags.copy()
        for i in lost:
            nxt = next((j for j in range(i + 1, len(tags)) if keep[j]), None)
            if nxt is not None and kinds[nxt] == 2:
                tags[nxt] = 3
        chars, tags = [c for c, k in zip(chars, keep) if k], tags[keep]
    text = "".join(chars)
    out, labels, at = [], [], 0
    starts = np.flatnonzero(tags == 2 * TYPES.index("person_name") + 1)
    for s in starts:
        e = s + 1
        while e < len(tags) and tags[e] == tags[s] + 1:
            e += 1
        hangul = "가" <= text[s] <= "힣"
        if e == len(tags) or not names or hangul and rng.random() < 0.2:
            continue
        given, family = names[rng.integers(len(names))][0], names[rng.integers(len(names))][1]
        if words and rng.random() < 0.12:
            word = words[rng.integers(len(words))].title()
            given, family = (word, family) if rng.random() < 0.8 else (given, word)
        middle = f"{chr(65 + rng.integers(26))}. " if rng.random() < 0.15 else ""
        new = f"{family}, {given}" if rng.random() < 0.2 else f"{given} {middle}{family}"
        if rng.random() < 0.12:
            new = new.upper()
        elif rng.random() < 0.1:
            new = f"{given} {_PARTICLES[rng.integers(len(_PARTICLES))]} {family}"
        after = ""
        if hangul or rng.random() < 0.1:
            new = _foreign(rng, hangul)
            if "가" <= new[0] and rng.random() < 0.25:
                after = _AFTER_HANGUL[rng.integers(len(_AFTER_HANGUL))]
        out += [text[at:s], new + after]
        labels += [tags[at:s], np.concatenate([[tags[s]], np.full(len(new) - 1, tags[s] + 1), np.zeros(len(after), np.int64)])]
        at = e
    out.append(text[at:])
    labels.append(tags[at:])
    return "".join(out), np.concatenate(labels).astype(np.int64)


def train(
    texts: list[str],
    spans: list[list[tuple[int, int, str]]],
    common: frozenset[str] = frozenset(),
    epochs: int = 14,
    batch: int = 128,
    rate: float = 0.012,
    windows: int = 5500,
    seed: int = 7,
) -> Tagger:
    """Fit on windows around the candidates of labelled texts: about ``windows`` windows an epoch, rare types repeated with
    other digits and names, and half as many windows without a label."""
    rng = np.random.default_rng(seed)
    by_type: dict[int, list[tuple[str, np.ndarray]]] = {}
    without: list[tuple[str, np.ndarray]] = []
    names: list[tuple[str, str]] = []
    for text, labels in zip(texts, spans):
        tags = np.zeros(len(text), np.int64)
        for s, e, kind in labels:
            k = 1 + 2 * TYPES.index(kind)
            tags[s] = k
            tags[s + 1 : e] = k + 1
            if kind == "person_name" and " " in text[s:e]:
                w = [x for x in text[s:e].replace(",", " ,").split() if not x.endswith(".")]
                pair = (w[2], w[0]) if len(w) == 3 and w[1] == "," else (w[0], w[-1])
                names.append((pair[0].title(), "-".join(x.capitalize() if i == 0 else x.lower() for i, x in enumerate(pair[1].split("-")))))
        around = stretches(text, candidates(text) + labels)
        if len(text) > WINDOW and rng.random() < 0.1:  # text without any candidate
            a = int(rng.integers(len(text) - WINDOW))
            around = [*around, (a, a + WINDOW)]
        for a, b in around:
            for p in range(a, b, WINDOW - OVERLAP):
                q = min(b, p + WINDOW)
                present = {int(k) for k in np.unique((tags[p:q] + 1) // 2) if k}
                if present:
                    # kept under the rarest type it holds, judged later by the order of types
                    by_type.setdefault(max(present), []).append((text[p:q], tags[p:q]))
                else:
                    without.append((text[p:q], tags[p:q]))
                if q == b:
                    break
    model = Tagger(seed)
    model.common = common
    words = sorted(w for w in common if 3 <= len(w) <= 9)
    if not by_type:
        return model
    m = {k: np.zeros_like(v) for k, v in model.p.items()}
    v2 = {k: np.zeros_like(v) for k, v in model.p.items()}
    share = windows // len(TYPES)
    step = 0
    for epoch in range(epochs):
        data: list[tuple[np.ndarray, np.ndarray]] = []
        for rows in by_type.values():
            for j in rng.integers(0, len(rows), share) if len(rows) > share else np.resize(rng.permutation(len(rows)), share):
                t, g = _varied(*rows[j], names, rng, words) if rng.random() < 0.7 else rows[j]
                data.append((char_codes(t, common), g))
        for j in rng.permutation(len(without))[: windows // 2]:
            data.append((char_codes(without[j][0], common), without[j][1]))
        order = sorted(range(len(data)), key=lambda i: (len(data[i][0]) // 12, rng.random()))
        groups = [order[i : i + batch] for i in range(0, len(order), batch)]
        lr = rate * (1 - epoch / epochs) + 0.0008
        for gi in rng.permutation(len(groups)):
            rows = [data[i] for i in groups[gi]]
            codes, mask = _padded([r[0] for r in rows], np.int64)
            tags, _ = _padded([r[1] for r in rows], np.int64)
            _, grads = model.loss_and_gradients(codes, mask, tags)
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
            clip = min(1.0, 5.0 / (norm + 1e-6))
            step += 1
            for k, g in grads.items():
                g = g.astype(np.float32) * clip
                m[k] = 0.9 * m[k] + 0.1 * g
                v2[k] = 0.995 * v2[k] + 0.005 * g * g
                model.p[k] -= lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v2[k] / (1 - 0.995**step)) + 1e-7)
    return model


# ---------------------------------------------------------------- tagging and finding


def tag_stretches(model: Tagger, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Tags of each text, and how far each scores over no tag: overlapping windows give the scores, each character's from the window that sees most on its
    shorter side, and one Viterbi pass over each line or long sentence decides."""
    windows: list[tuple[int, int, np.ndarray]] = []
    for i, t in enumerate(texts):
        codes = char_codes(t, model.common)
        for p in range(0, max(1, len(codes)), WINDOW - OVERLAP):
            windows.append((i, p, codes[p : p + WINDOW]))
            if p + WINDOW >= len(codes):
                break
    scores = [np.zeros((len(t), TAGS), np.float32) for t in texts]
    margin = [np.full(len(t), -1, np.int64) for t in texts]
    order = sorted(range(len(windows)), key=lambda k: len(windows[k][2]))
    for at in range(0, len(order), 384):
        part = [windows[k] for k in order[at : at + 384]]
        codes, mask = _padded([w[2] for w in part], np.int64)
        e = model.emissions(codes, mask)
        for j, (i, p, c) in enumerate(part):
            n = len(c)
            whole = np.arange(n)
            left = whole if p else np.full(n, WINDOW)
            right = n - 1 - whole if p + n < len(texts[i]) else np.full(n, WINDOW)
            see = np.minimum(left, right)
            better = see > margin[i][p : p + n]
            scores[i][p : p + n][better] = e[:n, j][better]
            margin[i][p : p + n][better] = see[better]
    tags = [np.zeros(len(t), np.int64) for t in texts]
    parts = sorted(((i, a, b) for i, t in enumerate(texts) for a, b in sequences(t)), key=lambda x: x[2] - x[1])
    at = 0
    while at < len(parts):
        end = at + 1
        while end < len(parts) and end - at < 384 and (parts[end][2] - parts[end][1]) * (end - at) < 150_000:
            end += 1
        part = parts[at:end]
        n = part[-1][2] - part[-1][1]
        e, mask = np.zeros((n, len(part), TAGS), np.float32), np.zeros((n, len(part)), bool)
        for j, (i, a, b) in enumerate(part):
            e[: b - a, j] = scores[i][a:b]
            mask[: b - a, j] = True
        best = model.viterbi(e, mask)
        for j, (i, a, b) in enumerate(part):
            tags[i][a:b] = best[: b - a, j]
        at = end
    return [(t, s[np.arange(len(t)), t] - s[:, 0]) for t, s in zip(tags, scores)]


_ENDS = re.compile(r"\n+")
_STOPS = re.compile(r"[.!?。!?;] ?(?=\S)|(?<=\S) ")


def sequences(text: str, longest: int = 600) -> list[tuple[int, int]]:
    """What one Viterbi pass decides: no detail crosses a line's end, and lines of more than ``longest`` characters are cut
    after the next stop or blank. The scores have seen what stands around."""
    out, at = [], 0
    for m in [*_ENDS.finditer(text), None]:
        end = m.end() if m else len(text)
        while end - at > longest:
            cut = next((c.end() for c in _STOPS.finditer(text, at + longest, end) if c[0] != " "), None) if end - at > 3 * longest else None
            cut = cut if cut and cut - at < 3 * longest else next((c.end() for c in _STOPS.finditer(text, at + longest, end)), end)
            out.append((at, cut))
            at = cut
        if end > at:
            out.append((at, end))
        at = end
    return out


_MARKED = re.compile("b?i+")
_SHAPE = {
    "email": lambda t: bool(re.search(r"\w ?(?:@|[(\[{]at[)\]}]|AT) ?\w", t)),
    "phone": lambda t: 7 <= sum(c.isdigit() for c in t) <= 15 and not re.search(r"[^\W\d_]{2}", t),
    "id_number": lambda t: sum(c.isdigit() for c in t) >= 5 and len(t) <= 24,
    "address": lambda t: any(c.isdigit() for c in t) and sum(c.isalpha() for c in t) >= 3,
    "person_name": lambda t: len(t.split()) >= 2 and not any(c.isdigit() for c in t) and all(w[0].isalpha() and w.replace("'", "").replace("-", "").replace("’", "").isalpha() for w in t.split()),
}
#: Least mean score of a run's tags over that of no tag, where no pattern meets the run.
SURE = 4.0


def decide(text: str, found: list[tuple[int, int, str]], tags: np.ndarray, over: np.ndarray | None = None) -> list[tuple[int, int, str]]:
    """The details that the tags (for each character of the text) mark, with their exact extent. ``over`` is how far each tag
    scores over no tag; without it runs that no candidate meets don't count."""
    kinds = (tags + 1) // 2
    out, met = [], np.zeros((len(TYPES) + 1, len(text)), bool)
    for s, e, kind in found:
        k = TYPES.index(kind) + 1
        met[k, s:e] = True
        if kind == "person_name" and _SCRIPT_RUN.match(text, s):
            out += [(s + m.start(), s + m.end(), kind) for m in _MARKED.finditer("".join("b" if t == 2 * k - 1 else "i" if t == 2 * k else "o" for t in tags[s:e])) if m.end() - m.start() >= 2]
            continue
        if kind != "person_name":
            if (kinds[s:e] == k).mean() >= 0.3:
                out.append((s, e, kind))
            continue
        run: list[tuple[int, int]] = []
        for m in _NAME_TOKEN.finditer(text[s:e]):
            a, b = s + m.start(), s + m.end()
            inside = (kinds[a:b] == k).mean() >= 0.35
            begins = bool(run) and tags[a] == 2 * k - 1
            if run and (not inside or begins):
                out += _name(text, run)
                run = []
            if inside:
                run.append((a, b))
        out += _name(text, run)
    if over is not None:
        out += _unmet_runs(text, tags, kinds, met, over)
    return _disjoint(out)


def _unmet_runs(text: str, tags: np.ndarray, kinds: np.ndarray, met: np.ndarray, over: np.ndarray) -> list[tuple[int, int, str]]:
    """Runs of tags that no pattern of their type meets, out to the ends of their words."""
    out = []
    starts = np.flatnonzero((kinds > 0) & ((np.concatenate([[0], kinds[:-1]]) != kinds) | (tags == 2 * kinds - 1)))
    for s in starts.tolist():
        k, e = kinds[s], s + 1
        while e < len(tags) and tags[e] == 2 * k:
            e += 1
        if e - s < 2 or met[k, s:e].any() or over[s:e].mean() < SURE:
            continue
        kind = TYPES[k - 1]
        if text[s] < "\u3000":  # scripts with blanks
            while s > 0 and (text[s - 1].isalnum() or text[s - 1] == "_"):
                s -= 1
            while e < len(text) and (text[e].isalnum() or text[e] == "_"):
                e += 1
        while e > s and not (text[e - 1].isalnum() or text[e - 1] in ")º."):
            e -= 1
        if _SHAPE[kind](text[s:e]) and not met[k, s:e].any():
            out.append((s, e, kind))
    return out


def _name(text: str, run: list[tuple[int, int]]) -> list[tuple[int, int, str]]:
    full = [x for x in run if not text[x[1] - 1] == "."]
    return [(run[0][0], run[-1][1], "person_name")] if len(full) >= 2 else []


def find(model: Tagger, texts: list[str | None]) -> list[list[tuple[int, int, str]]]:
    """Personal details of each text as (start, end, type)."""
    out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
    at = 0
    while at < len(texts):
        chars, end = 0, at
        while end < len(texts) and (end == at or chars < 600_000):
            chars += len(texts[end] or "")
            end += 1
        some = [i for i in range(at, end) if texts[i]]
        for i, (tags, over) in zip(some, tag_stretches(model, [texts[i] for i in some])):
            out[i] = decide(texts[i], candidates(texts[i]), tags, over)
        at = end
    return out


def fitted(documents: DataFrame, text_col: str, sample_rows: int = SAMPLE_ROWS) -> Tagger:
    """The model for a corpus: fitted on the sentences written by hand and on at most ``sample_rows`` documents of up to
    ``SAMPLE_LONGEST`` characters, those of least hash. A model fitted on the same sample before is read again."""
    spark = documents.sparkSession
    texts = sampled_texts(documents.select(F.col(text_col).alias("text")), sample_rows, 40, SAMPLE_LONGEST)
    digest = xxhash.xxh3_128()
    for t in [_VERSION, *texts]:
        digest.update(t.encode("utf-8", "surrogatepass") + b"\0")
    path = f"{checkpoint_dir(spark).rstrip('/')}/personal-{digest.hexdigest()}.npz"
    common = common_words(texts)
    stored = _stored(spark, path)
    if stored is not None:
        model = Tagger()
        model.p, model.common = stored, common
        return model
    given = given_names(texts)
    seeds = sentences(SEED_ROWS)
    model = train([*texts, *(t for t, _ in seeds)], [*(weak_spans(t, given, common) for t in texts), *(s for _, s in seeds)], common)
    _store(spark, path, model.p)
    return model


#: Part of the stored model's name: changes with what it is fitted on.
_VERSION = "4"


def _file_system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p, jvm


def _stored(spark: SparkSession, path: str) -> dict[str, np.ndarray] | None:
    fs, p, _ = _file_system(spark, path)
    if not fs.exists(p):
        return None
    raw = spark.sparkContext.binaryFiles(path).first()[1]
    with np.load(io.BytesIO(raw)) as f:
        return dict(f)


def _store(spark: SparkSession, path: str, weights: dict[str, np.ndarray]) -> None:
    """Written beside its place and renamed, so that a reader sees all of it or none."""
    out = io.BytesIO()
    np.savez(out, **weights)
    fs, p, jvm = _file_system(spark, path)
    beside = jvm.org.apache.hadoop.fs.Path(f"{path}.{xxhash.xxh3_64_hexdigest(out.getvalue())}")
    stream = fs.create(beside, True)
    stream.write(bytearray(out.getvalue()))
    stream.close()
    if not fs.rename(beside, p):
        fs.delete(beside, False)


PLACEHOLDER = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "address": "[ADDRESS]", "person_name": "[PERSON_NAME]"}


def replace(text: str | None, spans: list[tuple[int, int, str]]) -> str | None:
    """The text with each detail replaced by its type's placeholder; the rest stays as it was."""
    if text is None:
        return None
    out, at = [], 0
    for s, e, kind in spans:
        out += [text[at:s], PLACEHOLDER[kind]]
        at = e
    return "".join(out) + text[at:]


def personal_details(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, pii_type, found_text), distinct."""
    model = documents.sparkSession.sparkContext.broadcast(fitted(documents, text_col))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = {(i, k, t[s:e]) for i, t, spans in zip(f["id"], f["text"], find(model.value, f["text"].tolist())) for s, e, k in spans}
            yield pd.DataFrame(sorted(rows), columns=["doc_id", "pii_type", "found_text"])

    d = documents.filter(F.length(text_col) > 0).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return d.mapInPandas(run, "doc_id long, pii_type string, found_text string").distinct()


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_details(table(spark, sf_dir, "documents"))


def p9_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text): every document with its personal details replaced; null texts stay null."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = spark.sparkContext.broadcast(fitted(d, "text"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            texts = [t if isinstance(t, str) else None for t in f["text"]]
            yield pd.DataFrame({"doc_id": f["doc_id"], "text": [replace(t, s) for t, s in zip(texts, find(model.value, texts))]})

    return d.mapInPandas(run, "doc_id long, text string")
