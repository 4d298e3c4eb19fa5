"""Queries compiled on the driver: words, tokens and qualified names of a search text."""

from __future__ import annotations

from dataclasses import dataclass, field

import regex

_ATOM_EDGE = regex.compile(r"(?<!\\)\s+")
_SPLIT = regex.compile(r"(?<=[\p{Ll}0-9])(?=\p{Lu})|(?<=\p{Lu})(?=\p{Lu}\p{Ll})|(?<=[0-9])(?=\p{L})|(?<=\p{Lo})(?=[\p{Lu}\p{Ll}0-9])|(?<=[\p{Lu}\p{Ll}0-9])(?=\p{Lo})|[_-]+", flags=regex.V1)
MAX_QUERY_BYTES = 10_000


def split_identifier(word: str) -> list[str]:
    return [w.lower() for w in _SPLIT.split(word) if w]


def _unique(xs) -> list[str]:
    return list(dict.fromkeys(x for x in xs if x))


@dataclass(frozen=True)
class Query:
    """A compiled search text; see ``compile_query``."""

    raw_words: list[str] = field(default_factory=list)
    words: list[str] = field(default_factory=list)
    tokens: list[str] = field(default_factory=list)
    qualified: bool = False
    terms: list[str] = field(default_factory=list)

    @property
    def supplement(self) -> bool:
        """Whether a second, plain-token query should add owner-exact candidates."""
        return any("::" in w or ("." in w and (w.split(".", 1)[1].startswith("_") or w.split(".", 1)[1].endswith("_"))) for w in self.raw_words)

    @property
    def qualified_words(self) -> list[str]:
        return [w for w in self.raw_words if "::" in w or "." in w]


def compile_query(text: str) -> Query:
    """Words by white space, words by signs, and their parts, lower case, each once in order; the terms of the index are the
    alphanumeric runs of all tokens. Blank text gives an empty query, text over ``MAX_QUERY_BYTES`` an error."""
    if len(text.encode()) > MAX_QUERY_BYTES:
        raise ValueError("query too long")
    raw = _unique(w.lower() for w in text.split())
    words, tokens = [], []
    for w in regex.split(r"[^\p{L}\p{N}_-]+", text):
        if w:
            words.append(w.lower())
            tokens += [w.lower(), *split_identifier(w.lower())]
    qualified = any(regex.search(r"[^\p{L}\p{N}_-]", w) for w in raw)
    terms = _unique(t for tok in _unique(tokens) for t in regex.findall(r"[\p{L}\p{N}]+", tok))
    return Query(raw, _unique(words), _unique(tokens), qualified, terms)


# ---------------------------------------------------------------- conjunctive searches


@dataclass(frozen=True)
class Atom:
    """One condition: ``field`` is case, lang, file or content."""

    field: str
    value: str
    negated: bool = False


def write_atoms(pattern: str, glob: str | None = None, file_type: str | None = None, prefix: str | None = None, ignore_case: bool = False) -> str:
    """The text of a conjunctive search: case, language or extension, glob, path prefix and pattern, in this order. Blanks of the
    pattern are escaped, so that a phrase stays one condition; a type that is no language is an extension."""
    from quarrylens.functions.languages import normalize_language_hint
    from quarrylens.plans.globs import glob_regex

    out = ["case:no"] if ignore_case else []
    kind = (file_type or "").strip().lower()
    if kind:
        language = normalize_language_hint(kind)
        out.append(f"lang:{language}" if language else f"file:\\.{regex.escape(kind)}$")
    if glob and glob.strip():
        out.append(f"file:{glob_regex(glob.strip(), simple=True)}")
    if prefix:
        out.append(f"file:^{regex.escape(prefix)}/")
    return " ".join([*out, regex.sub(r"(?<!\\) ", r"\\ ", pattern)])


def read_atoms(text: str) -> list[Atom]:
    """The conditions of a conjunctive search; a leading minus negates, an escaped blank is a blank of its condition."""
    out = []
    for part in _ATOM_EDGE.split(text.strip()):
        if not part:
            continue
        negated = part.startswith("-") and len(part) > 1
        part = part[negated:]
        name, colon, value = part.partition(":")
        known = bool(colon and value) and name in ("case", "lang", "file", "content")
        out.append(Atom(name if known else "content", (value if known else part).replace("\\ ", " "), negated))
    return out
