"""Chunked lexing: lexer states composed over pieces of a file.

A lexer here is a finite automaton over code, comments and strings. For a piece of text with an unknown start state it is
run from each state, which gives a map from start to end state; maps compose associatively, so the start state of each
piece of a huge file follows from a parallel prefix over small tuples, and every piece is then lexed once, on its own.
Bracket structure is summarised likewise: a piece's brackets, matched ones cancelled, are its unmatched closers and
openers, and summaries combine associatively.

Pieces are cut where no delimiter can straddle: after a line end where there is one nearby, else between two letters.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass
from functools import lru_cache

CODE, LINE, BLOCK, DOUBLE, SINGLE, BACK, DOUBLE3, SINGLE3 = range(8)
STATES = tuple(range(8))
STRING_MARK, ERROR_MARK = "\x01", "\x02"

# fixed values: file extensions and the lexical family of each
FAMILY = {
    "py": "python", "pyi": "python", "go": "go", "rs": "rust", "java": "java", "kt": "java", "c": "c", "h": "c", "cc": "c", "cpp": "c", "hpp": "c",
    "js": "js", "mjs": "js", "cjs": "js", "jsx": "js", "ts": "ts", "mts": "ts", "cts": "ts", "tsx": "ts", "json": "json", "jsonc": "jsonc",
    "yaml": "yaml", "yml": "yaml", "toml": "toml", "tf": "hcl", "tfvars": "hcl", "hcl": "hcl", "css": "css", "xml": "xml", "props": "xml", "html": "xml",
}


def extension(path: str | None) -> str:
    base = (path or "").rpartition("/")[2]
    return base.rpartition(".")[2].lower() if "." in base else ""


@dataclass(frozen=True)
class Rules:
    """Tokens of a family: (pattern of the whole token, pattern of its rest when a piece begins inside it, state)."""

    tokens: tuple[tuple[str, str, int], ...]
    nested_block: bool = False

    def pattern(self) -> re.Pattern[str]:
        return _compiled(self.tokens)


@lru_cache(None)
def _compiled(tokens: tuple[tuple[str, str, int], ...]) -> re.Pattern[str]:
    return re.compile("|".join(f"({t})" for t, _, _ in tokens), re.S)


# a token either ends with its closer or with the end of the text (group "open"); single-line strings that meet a line
# end first are errors and end there
_LINE2 = (r"//[^\r\n]*", r"[^\r\n]*", LINE)
_HASH = (r"\#[^\r\n]*", r"[^\r\n]*", LINE)
_BLOCK2 = (r"/\*(?:[^*]|\*(?!/))*(?:\*/|\Z)", r"(?:[^*]|\*(?!/))*(?:\*/|\Z)", BLOCK)
_DQ = (r'"(?:[^"\\\r\n]|\\(?:\r\n|.))*(?:"|\Z|(?=[\r\n]))', r'(?:[^"\\\r\n]|\\(?:\r\n|.))*(?:"|\Z|(?=[\r\n]))', DOUBLE)
_SQ = (r"'(?:[^'\\\r\n]|\\(?:\r\n|.))*(?:'|\Z|(?=[\r\n]))", r"(?:[^'\\\r\n]|\\(?:\r\n|.))*(?:'|\Z|(?=[\r\n]))", SINGLE)
_DQ_LONG = (r'"(?:[^"\\]|\\.)*(?:"|\Z)', r'(?:[^"\\]|\\.)*(?:"|\Z)', DOUBLE)
_BACK_ESC = (r"`(?:[^`\\]|\\.)*(?:`|\Z)", r"(?:[^`\\]|\\.)*(?:`|\Z)", BACK)
_BACK_RAW = (r"`[^`]*(?:`|\Z)", r"[^`]*(?:`|\Z)", BACK)
_D3 = (r'"""(?:[^"\\]|\\.|"(?!""))*(?:"""|\Z)', r'(?:[^"\\]|\\.|"(?!""))*(?:"""|\Z)', DOUBLE3)
_S3 = (r"'''(?:[^'\\]|\\.|'(?!''))*(?:'''|\Z)", r"(?:[^'\\]|\\.|'(?!''))*(?:'''|\Z)", SINGLE3)
_RUST_CHAR = (r"'(?:[^'\\\r\n]|\\[^\r\n]{1,9}?)'", r"", SINGLE)
_REGEX = (r"(?<=[=(,:!&|?{;])[ \t]*/(?![/*])(?:[^/\\\r\n\[]|\\.|\[(?:[^\]\\\r\n]|\\.)*\])+/[a-z]*", r"", SINGLE)

RULES = {
    "python": Rules((_HASH, _D3, _S3, _DQ, _SQ)),
    "go": Rules((_LINE2, _BLOCK2, _DQ, _SQ, _BACK_RAW)),
    "rust": Rules((_LINE2, _BLOCK2, _DQ_LONG, _RUST_CHAR)),
    "java": Rules((_LINE2, _BLOCK2, _D3, _DQ, _SQ)),
    "c": Rules((_LINE2, _BLOCK2, _DQ, _SQ)),
    "js": Rules((_LINE2, _BLOCK2, _DQ, _SQ, _BACK_ESC, _REGEX)),
    "ts": Rules((_LINE2, _BLOCK2, _DQ, _SQ, _BACK_ESC, _REGEX)),
    "json": Rules((_DQ,)),
    "jsonc": Rules((_LINE2, _BLOCK2, _DQ)),
    "yaml": Rules(((r"(?:(?<=\s)|(?<=\A))\#[^\r\n]*", r"[^\r\n]*", LINE), _DQ_LONG)),
    "toml": Rules((_HASH, _D3, _S3, _DQ, (r"'[^'\r\n]*(?:'|\Z|(?=[\r\n]))", r"[^'\r\n]*(?:'|\Z|(?=[\r\n]))", SINGLE))),
    "hcl": Rules((_HASH, _LINE2, _BLOCK2, _DQ)),
    "css": Rules((_BLOCK2, _DQ, _SQ)),
    "xml": Rules(((r"<!--(?:[^-]|-(?!->))*(?:-->|\Z)", r"(?:[^-]|-(?!->))*(?:-->|\Z)", BLOCK),)),
}
_CLOSER = {LINE: ("",), BLOCK: ("*/", "-->"), DOUBLE: ('"',), SINGLE: ("'",), BACK: ("`",), DOUBLE3: ('"""',), SINGLE3: ("'''",)}
_OPENER = {BLOCK: ("/*", "<!--"), DOUBLE: ('"',), SINGLE: ("'",), BACK: ("`",), DOUBLE3: ('"""',), SINGLE3: ("'''",)}


def _closed(token: str, state: int, from_inside: bool) -> bool:
    if state == LINE:
        return True
    if state in (DOUBLE, SINGLE, BACK) and not from_inside and len(token) > 2 and token[-1] == token[0] and token[-2] != "\\":
        return True
    opener = 0 if from_inside else max(len(o) for o in _OPENER[state] if token.startswith(o)) if any(token.startswith(o) for o in _OPENER[state]) else 0
    body = token[opener:]
    for c in _CLOSER[state]:
        if body.endswith(c):
            if state in (BLOCK,):
                return True
            # the closer must not be escaped
            slashes = len(body) - len(c) - len(body[: len(body) - len(c)].rstrip("\\"))
            return slashes % 2 == 0
    return False


def spans(text: str, family: str, state: int = CODE) -> tuple[list[tuple[int, int, int, bool]], int]:
    """Comments and strings as (start, end, state, ended well), and the state at the end of the text."""
    rules = RULES[family]
    out: list[tuple[int, int, int, bool]] = []
    at = 0
    if state != CODE:
        rest = next((r for _, r, s in rules.tokens if s == state and r), None)
        if rest is not None:
            m = re.compile(rest, re.S).match(text)
            at = m.end()
            ok = _closed(m[0], state, True)
            if (not ok or state == LINE) and at == len(text):
                return [(0, at, state, True)], state
            out.append((0, at, state, ok))
    end_state = CODE
    for m in rules.pattern().finditer(text, at):
        s = rules.tokens[m.lastindex - 1][2]
        ok = _closed(m[0], s, False)
        if m.end() == len(text) and not ok:
            end_state = s
        elif m.end() == len(text) and s == LINE:
            end_state = LINE
        out.append((m.start(), m.end(), s, ok or m.end() == len(text)))
    return out, end_state


def state_map(text: str, family: str) -> tuple[int, ...]:
    """End state for each start state. The text is lexed once, from code; a run from inside a token joins that run
    at the token's end unless it ends inside another token there, when it is lexed on from that point."""
    found, from_code = spans(text, family, CODE)
    starts = [s for s, _, _, _ in found]
    rests = {s: r for _, r, s in RULES[family].tokens if r}
    out = list(STATES)
    out[CODE] = from_code
    for state, rest in rests.items():
        m = re.compile(rest, re.S).match(text)
        at = m.end()
        if at == len(text):
            out[state] = state if state == LINE or not _closed(m[0], state, True) else CODE
            continue
        i = bisect_right(starts, at) - 1
        inside = i >= 0 and starts[i] < at < found[i][1]
        out[state] = spans(text[at:], family, CODE)[1] if inside else from_code
    return tuple(out)


def compose(first: tuple[int, ...], second: tuple[int, ...]) -> tuple[int, ...]:
    return tuple(second[s] for s in first)


def mask(text: str, family: str, state: int = CODE, keep_comments: bool = False) -> tuple[str, int]:
    """The text with comments blanked (line ends kept) and strings as one mark each; a string cut by a line end
    becomes an error mark. Also the end state."""
    found, end = spans(text, family, state)
    parts, at = [], 0
    for s, e, st, ok in found:
        parts.append(text[at:s])
        if st in (LINE, BLOCK):
            parts.append("\n" if "\n" in text[s:e] or "\r" in text[s:e] else " ")
        elif s == 0 and state != CODE:  # the mark stands where the string begins
            parts.append("" if ok else ERROR_MARK)
        else:
            parts.append(STRING_MARK if ok else ERROR_MARK)
        at = e
    parts.append(text[at:])
    return "".join(parts), end


_BRACKET = re.compile(r"[()\[\]{}]")
_PAIR = {")": "(", "]": "[", "}": "{"}


def bracket_summary(masked: str) -> tuple[str, str, bool]:
    """(unmatched closers, unmatched openers, mismatch seen) of a masked text."""
    closers: list[str] = []
    stack: list[str] = []
    for b in _BRACKET.findall(masked):
        if b in "([{":
            stack.append(b)
        elif not stack:
            closers.append(b)
        elif stack.pop() != _PAIR[b]:
            return "".join(closers), "".join(stack), True
    return "".join(closers), "".join(stack), False


def combine_brackets(a: tuple[str, str, bool], b: tuple[str, str, bool]) -> tuple[str, str, bool]:
    """Associative: the summary of two neighbouring pieces."""
    if a[2] or b[2]:
        return a[0], b[1], True
    n = min(len(a[1]), len(b[0]))
    tail = a[1][len(a[1]) - n :][::-1]
    if any(_PAIR[c] != o for c, o in zip(b[0][:n], tail)):
        return a[0], b[1], True
    return a[0] + b[0][n:], a[1][: len(a[1]) - n] + b[1], False


_AFTER_STATEMENT = re.compile(r"(?<=\w[)\]])[;},](?=[A-Za-z])|(?<=\w)[;},](?=[A-Za-z])")
_BETWEEN_LETTERS = re.compile(r"(?<![\\'\"`/*\-<>#])[A-Za-z0-9 ](?=[A-Za-z0-9])")


def cut_points(text: str, size: int) -> list[int]:
    """Starts of pieces of about ``size`` characters, each cut where no delimiter can straddle."""
    out, at = [0], 0
    while len(text) - at > size + size // 2:
        p = text.find("\n", at + size, at + size + size // 4)
        if p >= 0:
            p += 1
        else:
            m = _AFTER_STATEMENT.search(text, at + size, at + size + size // 4) or _BETWEEN_LETTERS.search(text, at + size)
            if not m:
                break
            p = m.end()
        if p >= len(text):
            break
        out.append(p)
        at = p
    return out


def pieces(text: str, size: int) -> list[str]:
    starts = cut_points(text, size)
    return [text[a:b] for a, b in zip(starts, [*starts[1:], len(text)])]
