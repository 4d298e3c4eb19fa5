"""Source files that don't parse in the language of their extension.

Each file is reduced in two steps. First pieces of it become lexer-state maps and bracket summaries, which combine
associatively, so a file of any size is read in parallel pieces; unterminated strings and comments and unbalanced
brackets show here. Then the statements between brackets, with strings and comments masked, meet the local grammar
of the language: pieces are masked and reduced to templates in parallel, and one machine reads a file's templates in order, its
open statements being what is carried over a border, so the verdict is the same for pieces of any size. An exact parser of the
standard library follows for Python, JSON, TOML and XML, on the whole file.

Files up to ``PIECE_CHARS`` are one piece and never leave their task; only pieces of larger files are shuffled.
Defined cases: null content, and extensions without a grammar, are never flagged; empty and comment-only code files are
valid; an empty JSON or XML file isn't; a byte-order mark is ignored; rates count exact duplicate rows once.
"""

from __future__ import annotations

import ast
import json
import re
import tomllib
import warnings
from collections.abc import Iterator
from functools import lru_cache
from xml.parsers import expat

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylens.llm import lexer as L
from quarrylens.llm.pieces import PIECE_CHARS, pieces_with_start
from quarrylens.session import table

# ---------------------------------------------------------------- statements of brace languages

# fixed values: words that begin or join statements, so that two operands beside them are no error
_KEYWORDS = {
    "js": "abstract as async await break case catch class const continue debugger default delete do else export extends finally for from function get if import in instanceof let new of return set static super switch throw try typeof var void while with yield",
    "java": "abstract assert break case catch class const continue default do else enum extends final finally for goto if implements import instanceof interface native new non-sealed package permits private protected public record return sealed static strictfp super switch synchronized throw throws transient try var volatile while yield",
    "go": "break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var",
    "rust": "as async await break const continue crate dyn else enum extern fn for if impl in let loop match mod move mut pub ref return static struct super trait type union unsafe use where while",
    "c": "auto break case class const continue default do else enum explicit extern for friend goto if inline mutable namespace new operator override private protected public register return signed sizeof static struct switch template throw try typedef typename union unsigned using virtual volatile while",
}
_KEYWORDS["ts"] = _KEYWORDS["js"] + " any asserts boolean declare enum implements infer interface is keyof module namespace never number object override private protected public readonly require satisfies string symbol type undefined unique unknown"

_NUMBER = re.compile(r"\b(?:0[xXbBoO][\da-fA-F_]+|\d[\d_]*(?:\.\d[\d_]*)?(?:[eE][+-]?\d+)?)[A-Za-z]{0,3}\d{0,2}\b")
_LIST = re.compile(r"\b\d+(?:,[ \t]*\d+)+")  # runs of numbers count as one
_SPACE = re.compile(r"(?<=\S)(?:[ \t\f]{2,}|[\t\f])")


_IDENTIFIER = re.compile(r"(?<![\w$@#])[^\W\d][\w$]*")
_KEYWORD_SETS = {f: frozenset(words.split()) for f, words in _KEYWORDS.items()}


# statement words as names of properties
_PROPERTY = re.compile(r"(?<=[\w$)\]?]\.)(?:if|while|switch|catch|for|else|import|return)\b|\b(?:if|while|switch|catch|for)(?= ?:)")


def _template(masked: str, family: str) -> str:
    keywords = _KEYWORD_SETS[family]
    t = _IDENTIFIER.sub(lambda m: m[0] if m[0] in keywords else "I", _LIST.sub("0", masked))
    t = _NUMBER.sub("I", t).replace(L.STRING_MARK, "I" if family in ("rust", "c", "java") else "S")
    if family in ("js", "ts"):
        t = _PROPERTY.sub("I", t)
    return _SPACE.sub(" ", t)


_REDUCE = [
    (re.compile(r"I ?(?:\.|\?\.|::|->) ?I"), "I"),
    (re.compile(r"I ?!?\( ?(?:[IS](?:, ?[IS])*,? ?)?\)"), "I"),
    (re.compile(r"I ?\[ ?(?:[IS] ?)?\]"), "I"),
]


def _reduced(t: str) -> str:
    before = None
    while before != t:
        before = t
        for p, r in _REDUCE:
            t = p.sub(r, t)
    return t


_CONFLICT = re.compile(r"^(?:<{7}(?: .*)?|={7}|>{7}(?: .*)?|\|{7}(?: .*)?)\r?$", re.M)
_NOT_CODE = re.compile(r"^\s*(?:version https?://\S+|oid sha256:[0-9a-f]+|Traceback \(most recent call last\):)", re.M)

# definite errors inside one line, whatever stands around it
_COMMON_BAD = re.compile(
    r"(?:[=/%]|(?<!\.)\.)\s*[;)\]]|(?<![+-])[+-]\s*[;)\]]|\|\|\s*[;)\]]|&&\s*[;)\]]|,\s*,|\(\s*,|,\s*;|=\s*,|^\s*(?:=(?!>)|\)\s*I\b.*[^{]$)"
)
_BAD = {
    # an operand right after another, headers without parentheses, signs of other languages
    "js": re.compile(r"[IS)\]] +[IS](?![\w$])|[IS]I|^\s*#(?!!|[\w$]+\s*(?:[=;(]|in\b|$))|:=|(?<!-)->|::|^import (?:I\.|I;|I$)|\b(?:if|while|switch|catch|for) *(?! |\(|\{|await)|^\s*@I.*I$|\)\s*:\s*$|^[^?]*\bfor \([^;)]*\)\s*:|^else\b.*:\s*$|^\s*:I|\b(?:if|while|switch) [^(]"),
    "java": re.compile(r"I +I +I(?![\w$])|^\s*#|:=|^(?:export|function|def|fn|func|let|use|impl|pub|from) |\b(?:if|while|switch|catch|for) *[^ (]|\b(?:if|while|switch|for) [^(]|\)\s*:\s*$|^import [^;]*$|^package [^;]*$|\)\s*->\s*\w+[^{;]*\{|^\s*:I|\S\s*\) I \{$|^S"),
    "go": re.compile(r"I +I +I(?![\w$])|^\s*#|::|=>|->|===|!==|^\s*(?:if|for|switch) *\{?$(?<!for \{)|\b(?:else)\s*:|\)\s*:\s*$|^import (?!\(|S|I S|_ S|\. S)|;\s*$|^(?:export|private|public|static|let|class|def|async|from|extends|implements) |^\s*:I|^I I$(?<=^I I)(?!)"),
    "rust": re.compile(r"I +I(?![\w!'])|:=|===|!==|^\s*#(?![!\[])|\)\s*:\s*$|^\s*:I|\b(?:if|while|match)\s*$|^import |^package |^(?:export|function|class|private|public|def|func|var|package|import) "),
    "c": re.compile(r"I +I +I(?![\w$])|:=|===|!==|=>|^import |^package |^use |\b(?:if|while|switch|for) *[^ (]|\b(?:if|while|switch|for) [^(]|\)\s*:\s*$|^\s*:I|^(?:export|function|fn|func|def|let|pub|impl) |\) *-> *I|^\s*#(?!\s*(?:I|include|if|ifdef|ifndef|else|elif|endif|define|undef|pragma|error|warning|line)\b)"),
}
_BAD["ts"] = re.compile(r"[IS)\]] +[IS](?![\w$])|[IS]I|^\s*#(?!!|I|[\w$]+\s*(?:[=;(:]|in\b|$))|:=|(?<![=-])->|::|^import (?:I\.|I;|I$)|\b(?:while|switch|catch) *[^ (\{]|\)\s*:\s*$|^else\b.*:\s*$|\b(?:if|while|switch) [^(]")
_TYPED_JS = re.compile(r"\bfunction\b[^({]*\([^)]*I\??\s*:|^(?:\s*(?:async|static|get|set) )*\s*I\([^)]*I\s*:\s*I[^)]*\)\s*(?::[^{]*)?\{|\)\s*:\s*[^{?]*\{\s*$|\b(?:const|let|var) I\s*:|^(?:export )?(?:interface|enum|declare|namespace|abstract) I|^(?:export )?type I\s*=|\bimport type\b|\bI as (?:const|I)\b")
_SEMICOLON = frozenset({"java", "c"})
_ENDS_OPEN = re.compile(r"(?:[,;{}(\[=+\-*/%&|<>!?:.~^\\]|=>|\b(?:else|do|return|in|of|and|or))$")
_STARTS_CONTINUED = re.compile(r"^(?:[.,;)\]}?:=+*/%&|<>^{]|-(?!-)|&&|\|\||instanceof\b|throws\b|extends\b|implements\b|where\b|else\b)")


# typed parameters and declarations in packed script, where a colon may also belong to an object or a conditional
_TYPED_PACKED = re.compile(r"\bfunction\b[^({]*\((?:I(?:=[^,()]*)?, ?)*I\??\s*:|\bfunction\b[^({]*\([^()?]*\)\s*:\s*[^{?]*\{$|^\}?(?:(?:async|static|get|set) )*I\((?:I, ?)*I\s*:\s*I[^()?]*\)\s*\{$|^\}?(?:const|let|var) I\s*:|^\}?(?:export )?(?:interface|enum|declare|namespace|abstract) I|^\}?(?:export )?type I\s*=|\bimport type\b|\bas const\b")
#: Statements longer than this are taken apart before they meet the patterns; none is left out.
LONG = 2000


# in scripts: a condition is no operand to what follows it, and arrays may have holes
_CONDITION = re.compile(r"\b(if|while|for|with) ?\((?:[^()]|\((?:[^()]|\([^()]*\))*\))*\) +(?=[IS])")
_HOLES = re.compile(r"(?<=\[)[ ,]*,|,(?= ?,[^()\[\]{}]*\])")


def _bad_form(r: str, t: str, family: str, packed: bool = False) -> bool:
    if family in ("js", "ts"):
        if "," in r and "[" in r:
            r = _HOLES.sub("", r)
        if ") " in r:
            r = _CONDITION.sub(r"\1 (I) {", r)
    if _COMMON_BAD.search(r) or _BAD[family].search(r):
        return True
    return family == "js" and bool((_TYPED_PACKED if packed else _TYPED_JS).search(t))


@lru_cache(200_000)
def _line_facts(t: str, family: str, packed: bool = False) -> tuple[bool, str]:
    """(bad, reduced form) of one statement's template."""
    t = t.strip()
    if not t:
        return False, ""
    r = _reduced(t)
    depth = t.count("(") + t.count("[") - t.count(")") - t.count("]")
    if depth:
        return family == "js" and bool((_TYPED_PACKED if packed else _TYPED_JS).search(t)), r
    return _bad_form(r, t, family, packed), r


_LEVEL = re.compile(r"[()\[\]{},]")
_CLOSED_BY = {"(": ")", "[": "]", "{": "}"}


def _long_facts(t: str, family: str) -> tuple[bool, str]:
    """As ``_line_facts`` for a statement of any length: each element between commas is judged by itself, innermost
    brackets first, and counts as one operand in what stands around it."""
    levels: list[list] = [["", [], 0, ""]]  # opener, parts of the element so far, elements before it, the first of them
    at = 0

    def judged(level: list, more: bool) -> bool:
        opener, parts, n, _ = level
        e = "".join(parts).strip()
        if not e:  # a comma may end a list; arrays of scripts may have holes
            return not more or (opener == "[" and family in ("js", "ts"))
        if not opener and not n:
            t = e + ")" if more else e
        else:
            t = f"({e})"
        if more and not n:
            level[3] = e
        return not _bad_form(_reduced(t), t, family, True)

    for m in _LEVEL.finditer(t):
        ch, level = m[0], levels[-1]
        level[1].append(t[at : m.start()])
        at = m.end()
        if ch == ",":
            if not judged(level, True):
                return True, ""
            level[1], level[2] = [], level[2] + 1
        elif ch in _CLOSED_BY:
            levels.append([ch, [], 0, ""])
        elif level[0] and _CLOSED_BY[level[0]] == ch:
            empty = not level[2] and not "".join(level[1]).strip()
            if not judged(level, False):
                return True, ""
            levels.pop()
            levels[-1][1].append(level[0] + ("" if empty else "I") + ch)
        else:
            level[1].append(ch)
    levels[-1][1].append(t[at:])
    r = []
    for level in levels:
        if len(levels) == 1 and not judged(level, False):
            return True, ""
        r.append(level[0] + (level[3] + "," if level[2] else "") + "".join(level[1]))
    return False, _reduced("".join(r).strip())


_BLOCK_HEAD = {
    "js": re.compile(r"(?:=>|\))\s*$|\b(?:class|else|do|try|finally|static|catch)\b[^(){}\[\],;]*$"),
    "java": re.compile(r"(?:->|\))\s*$|\b(?:class|else|do|try|finally|static)\b[^(){}\[\],;]*$"),
    "go": re.compile(r"\bfunc ?\([^{}]*$|\b(?:if|for|switch|select|else|struct|interface)\b[^{},]*$"),
    "rust": re.compile(r"(?:\||=>|\))\s*$|\|\s*->[^{},|]*$|\b(?:if|else|match|loop|while|for|unsafe|async|move)\b[^{},;]*$"),
    "c": re.compile(r"\]\s*\([^()]*\)[^(){},;]*$|\b(?:do|else)\s*$|\b(?:if|for|while|switch)\b.*\)\s*$"),
}
_BLOCK_HEAD["ts"] = re.compile(_BLOCK_HEAD["js"].pattern + r"|\)\s*:[^(){},;=]*$")
_EDGE = re.compile(r"[()\[\]{}]")
_EDGE_PACKED = re.compile(r"[()\[\]{};]")


class _Frame:
    """The statements of one block: what they leave to the next, and the statement that is still open."""

    __slots__ = ("braces", "held", "inits", "opened", "previous")

    def __init__(self) -> None:
        self.previous, self.held = "", ""
        self.inits: list[bool] = []  # for each open brace: does it hold values instead of statements
        self.opened: list[str] = []  # open brackets of the held statement
        self.braces = 0


def _statement_ok(line: str, family: str, frame: _Frame, packed: bool) -> bool:
    """One whole statement in the order of its block."""
    bad, r = _line_facts(line, family, packed) if len(line) <= LONG else _long_facts(line, family)
    if bad:
        return False
    previous, inits = frame.previous, frame.inits
    if not r:
        return True
    if r.startswith("else") and previous and not previous.endswith(("}", ";")) or r.startswith(("catch", "finally")) and family != "c" and previous and not previous.endswith("}"):
        return False
    if family in _SEMICOLON and previous and not (inits and inits[-1]) and not _STARTS_CONTINUED.match(r) and not _ENDS_OPEN.search(previous) and not previous.startswith("@") and not re.match(r"(?:if|for|while|else|switch|do|case|default)\b", previous) and not previous.endswith(")") | bool(re.search(r"\b(?:class|enum|interface|struct|union)\b[^;]*$", previous)):
        return False
    if family in _SEMICOLON and r.startswith("}") and not (inits and inits[-1]) and re.match(r"(?:return\b.*|[\w ]*I = .*)[^;{},:]$", previous) and previous[-1] in "ISN)]":
        return False
    if family == "rust" and re.match(r"(?:let|use|pub const|const|static|return)\b[^{]*[^;{},(]$", previous) and not _STARTS_CONTINUED.match(r):
        return False
    header = re.match(r"(?:(?:export|default|async|public|private|protected|static|final|pub|unsafe|extern) )*(?:function|func|fn|class|struct|impl|trait|interface|enum)\b", previous)
    if header and not previous.endswith(("{", "}", ";", ",", "(", "=")) and not r.startswith(("{", "where", "extends", "implements", ":", "throws", "|", "&", "=>", ")")) and family != "c":
        return False
    for i, ch in enumerate(r):
        if ch == "{":
            head = r[:i].rstrip()
            inits.append(head.endswith(("=", ",", "(", "[", "]", ":", "{")) or (not head and previous.endswith(("=", ",", "("))) or bool(inits and inits[-1]) or bool(re.search(r"\benum\b[^;]*$", head)))
        elif ch == "}" and inits:
            inits.pop()
    frame.previous = r
    return True


class Statements:
    """The grammar over a file's lines of templates in their order. A statement goes on while round or square brackets are open;
    blocks of statements inside such brackets (callbacks) are frames of their own, and packed lines are cut at semicolons and braces."""

    def __init__(self, family: str) -> None:
        self.family, self.frames = family, [_Frame()]

    def line(self, line: str) -> bool:
        """Take one line; false where it is a definite error."""
        family, frames = self.family, self.frames
        line = line.strip()
        if not line:
            return True
        frame = frames[-1]
        if family == "c" and line.startswith("#"):
            return not _line_facts(line, family)[0]
        packed = len(line) > LONG
        if not packed and not frame.held and (len(frames) == 1 or "}" not in line) and line.count("(") == line.count(")") and line.count("[") == line.count("]"):
            frame.braces += line.count("{") - line.count("}")
            return _statement_ok(line, family, frame, False)
        at = 0
        for m in (_EDGE_PACKED if packed else _EDGE).finditer(line):
            ch, frame = m[0], frames[-1]
            if ch in "([":
                frame.opened.append(ch)
            elif ch in ")]":
                if frame.opened:
                    frame.opened.pop()
            elif ch == ";":
                if not frame.opened:
                    if not _statement_ok(f"{frame.held} {line[at : m.end()]}".strip(), family, frame, True):
                        return False
                    frame.held, at = "", m.end()
            elif ch == "{":
                if frame.opened:
                    if _BLOCK_HEAD[family].search(f"{frame.held[-400:]} {line[max(at, m.start() - 400) : m.start()]}"):
                        frame.held, at = f"{frame.held} {line[at : m.end()]}".strip(), m.end()
                        frames.append(_Frame())
                    else:
                        frame.opened.append(ch)
                else:
                    frame.braces += 1
                    if packed:
                        if not _statement_ok(f"{frame.held} {line[at : m.end()]}".strip(), family, frame, True):
                            return False
                        frame.held, at = "", m.end()
            elif frame.opened:
                frame.opened.pop()
            elif frame.braces > 0 or len(frames) == 1:
                frame.braces -= 1
                if packed:
                    if not _statement_ok(f"{frame.held} {line[at : m.start()]}".strip(), family, frame, True):
                        return False
                    frame.held, at = "", m.start()
            else:
                if not _statement_ok(f"{frame.held} {line[at : m.start()]}".strip(), family, frame, packed):
                    return False
                frames.pop()
                at = m.start()
        frame = frames[-1]
        rest = line[at:].strip()
        if rest:
            frame.held = f"{frame.held} {rest}" if frame.held else rest
        if not frame.opened and frame.held:
            if not _statement_ok(frame.held, family, frame, packed):
                return False
            frame.held = ""
        return True

    def end(self) -> bool:
        return all(_statement_ok(f.held, self.family, f, False) for f in self.frames if f.held and not f.opened)


def _unix_lines(text: str) -> str:
    return text.replace("\r\n", "\n").replace("\r", "\n") if "\r" in text else text


def _brace_statements_ok(masked: str, family: str) -> bool:
    s = Statements(family)
    return all(map(s.line, _template(_unix_lines(masked), family).split("\n"))) and s.end()


# ---------------------------------------------------------------- languages of other forms

_YAML_LINE = re.compile(r"""^(?:\s*(?:-\s+)*(?:(?:"(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|\x01|[^\s:#\-\[\]{}&*!|>'"%@`,][^:#]*?|<<)\s*:(?:\s.*)?|-(?:\s.*)?)|\s*(?:---|\.\.\.)(?:\s.*)?|\s*[\[\]{}],?.*|%\w.*)$""")
_YAML_BLOCK = re.compile(r"^(\s*)(?:-\s+)*(?:[^\s:#][^:#]*:\s*|-\s*)(?:!\S+\s+)?[|>][+-]?\d?[+-]?\s*(?:#.*)?$")


def _yaml_ok(text: str) -> bool:
    if _CONFLICT.search(text):
        return False
    block = -1
    quote = False
    last_scalar = -1
    for line in text.replace("\r\n", "\n").replace("\r", "\n").split("\n"):
        if not line.strip():
            continue
        indent = len(line) - len(line.lstrip(" "))
        if block >= 0:
            if indent > block:
                continue
            block = -1
        if line.lstrip().startswith("#"):
            continue
        if quote:
            quote = not re.search(r'(?<!\\)"\s*(?:#.*)?$', line)
            continue
        if line[indent] == "\t":
            return False
        m = _YAML_BLOCK.match(line)
        if m:
            block = indent
            last_scalar = -1
            continue
        v = re.sub(r'"(?:[^"\\]|\\.)*"|\'(?:[^\']|\'\')*\'', L.STRING_MARK, line)
        value = re.match(r"^\s*(?:-\s+)*[^:]*:\s+(.*)$", v)
        if value and value[1][:1] in ('"', "'"):
            if value[1][0] == "'":
                return False
            quote = True
            continue
        if value and value[1].startswith(L.STRING_MARK) and re.match(r"\x01\s*[^\s#,\]}]", value[1]):
            return False
        if value and re.search(r"^[@`%]|^[^\x01\"'\[{]*:\s", value[1]):
            return False
        if not _YAML_LINE.match(v) and not (last_scalar >= 0 and indent > last_scalar):
            return False
        last_scalar = indent if value and value[1] and not value[1].startswith((L.STRING_MARK, "[", "{", "|", ">")) else -1
    return not quote


_HCL_LINE = re.compile(r'^(?:[\w."\x01\- \[\]*()]+\s*(?:=(?!=)\s*\S.*|\{.*)|[\])},].*|\x01\s*[=:].*|[\w.]+\s*:.*|\x01,?|[\w.\x01\[(${+!-].*[,)\]}]|\d+)$')


def _hcl_ok(text: str) -> bool:
    text = re.sub(r"<<[-~]?(\w+)[^\S\n]*\r?\n(?:.*\r?\n)*?[^\S\n]*\1\b", L.STRING_MARK, text)
    masked, end = L.mask(text, "hcl")
    if end not in (L.CODE, L.LINE) or L.ERROR_MARK in masked or "<<" in masked or _CONFLICT.search(masked):
        return False
    if L.bracket_summary(masked) != ("", "", False):
        return False
    depth = 0
    for line in masked.splitlines():
        line = line.strip()
        if line and depth == 0 and not _HCL_LINE.match(line):
            return False
        depth += line.count("(") + line.count("[") - line.count(")") - line.count("]")
    return True


def _jsonc_ok(text: str) -> bool:
    found, end = L.spans(text, "jsonc")
    at, parts = 0, []
    for s, e, st, ok in found:
        if st in (L.LINE, L.BLOCK):
            parts.append(text[at:s] + " ")
            at = e
    return _json_ok("".join(parts) + text[at:])


def _json_ok(text: str) -> bool:
    try:
        json.loads(text, parse_constant=_reject)
    except (ValueError, RecursionError):
        return False
    return True


def _reject(_: str):
    raise ValueError("not JSON")


def _toml_ok(text: str) -> bool:
    try:
        tomllib.loads(text.replace("\r\n", "\n").replace("\r", "\n"))
    except (ValueError, RecursionError):
        return False
    return True


def _xml_ok(text: str) -> bool:
    p = expat.ParserCreate("utf-8")
    try:
        p.Parse(text.encode("utf-8", "surrogatepass"), True)
    except expat.ExpatError:
        return False
    return True


def _python_ok(text: str) -> bool:
    """The full compiler is faster than a syntax tree made of objects; what only it refuses (a return outside a function)
    is still valid syntax."""
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        for flags in (0, ast.PyCF_ONLY_AST):
            try:
                compile(text, "f", "exec", flags, True)
                return True
            except (SyntaxError, ValueError, RecursionError, MemoryError):
                continue
    return False


_CSS_RULE = re.compile(r"[^{};]*\{(?:\s*(?:[\w-]+\s*:\s*[^{};]+|@[\w-]+[^{};]*)?\s*;?)*\}")


def _css_ok(masked: str) -> bool:
    before = None
    while before != masked:
        before, masked = masked, _CSS_RULE.sub(" ", masked)
    return not re.sub(r"@[\w-]+[^;{}]*;", "", masked).strip()


# ---------------------------------------------------------------- one file, from pieces or whole


def _without_bom(text: str) -> str:
    return text[1:] if text[:1] == "﻿" else text


_STRAY_QUOTES = {"rust": "\"`"}


def _marks_ok(masked: str, family: str) -> bool:
    """Nothing in masked lines that no file of the language holds: strings without end, conflict marks, stray quotes."""
    if L.ERROR_MARK in masked or _CONFLICT.search(masked) or _NOT_CODE.search(masked):
        return False
    return family not in PIECEWISE or not any(q in masked for q in _STRAY_QUOTES.get(family, "\"'`"))


def _masked_ok(masked: str, family: str) -> bool:
    """The local grammar on masked text whose brackets are known to balance over the whole file."""
    return _marks_ok(masked, family) and (family not in PIECEWISE or _brace_statements_ok(masked, family))


def is_valid(text: str | None, family: str | None) -> bool:
    """Whether a whole text parses in a language family; true where there is no grammar."""
    if text is None or family is None:
        return True
    text = _without_bom(text)
    if family in _WHOLE:
        return _WHOLE[family](text)
    masked, end = L.mask(text, family)
    if end not in (L.CODE, L.LINE) or not _masked_ok(masked, family):
        return False
    if L.bracket_summary(masked) != ("", "", False):
        return False
    if family == "css":
        return _css_ok(masked)
    return _python_ok(text) if family == "python" else True


_WHOLE = {"json": _json_ok, "jsonc": _jsonc_ok, "toml": _toml_ok, "xml": _xml_ok, "yaml": _yaml_ok, "hcl": _hcl_ok}
#: Families whose large files are checked by pieces; the rest hold few large files and are parsed whole, one file a task.
PIECEWISE = frozenset({"js", "ts", "java", "go", "rust", "c"})


def _check_whole(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        bad = [i for i, p, t in zip(f["file_id"], f["file_path"], f["content"]) if not is_valid(t, L.FAMILY.get(L.extension(p)))]
        yield pd.DataFrame({"file_id": pd.Series(bad, dtype="int64")})


def piece_facts(piece: str, family: str, start: int) -> tuple:
    """What is kept of a piece: its bracket summary, whether its whole lines hold anything that no file does, its end state, and its
    text: the beginning of its first line and the end of its last as masked, for the next pieces to complete, and whole lines between
    as templates (null where it has no line end)."""
    masked, end = L.mask(piece, family, start)
    masked = _unix_lines(masked)
    closers, openers, clash = L.bracket_summary(masked)
    head, line_end, rest = masked.partition("\n")
    if not line_end:
        return closers, openers, clash, True, end, head, None, ""
    middle, _, tail = rest.rpartition("\n")
    return closers, openers, clash, _marks_ok(middle, family), end, head, _template(middle, family), tail


_FACTS = "closers string, openers string, clash boolean, ok boolean, end int, head string, middle string, tail string"
_FACT_NAMES = [c.split()[0] for c in _FACTS.split(", ")]


def _piece_facts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        rows = [(i, k, m, *piece_facts(p, m, int(s))) for i, k, m, p, s in zip(f["file_id"], f["k"], f["family"], f["piece"], f["start"])]
        yield pd.DataFrame(rows, columns=["file_id", "k", "family", *_FACT_NAMES])


class FileFold:
    """Reads the facts of one file's pieces in their order."""

    def __init__(self, family: str) -> None:
        self.family, self.good, self.end = family, True, L.CODE
        self.brackets, self.open, self.statements = ("", "", False), [], Statements(family)

    def _line(self) -> None:
        """The line that stands across a border is whole now."""
        masked = "".join(self.open)
        self.open = []
        self.good = self.good and _marks_ok(masked, self.family) and self.statements.line(_template(masked, self.family))

    def add(self, closers: str, openers: str, clash: bool, ok: bool, end: int, head: str, middle: str | None, tail: str) -> None:
        self.brackets = L.combine_brackets(self.brackets, (closers, openers, bool(clash)))
        self.good, self.end = self.good and bool(ok), end
        self.open.append(head)
        if middle is None or not self.good:
            return
        self._line()
        self.good = self.good and all(map(self.statements.line, middle.split("\n")))
        self.open = [tail]

    def valid(self) -> bool:
        if self.good:
            self._line()
        return self.good and self.brackets == ("", "", False) and self.end in (L.CODE, L.LINE) and self.statements.end()


def _fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Files whose pieces follow each other in order, one piece at a time."""
    at, fold = None, None
    for f in frames:
        bad = []
        for i, family, *facts in zip(f["file_id"], f["family"], *(f[c] for c in _FACT_NAMES)):
            if i != at:
                if fold is not None and not fold.valid():
                    bad.append(at)
                at, fold = i, FileFold(family)
            fold.add(*facts)
        yield pd.DataFrame({"file_id": pd.Series(bad, dtype="int64")})
    yield pd.DataFrame({"file_id": pd.Series([at] if fold is not None and not fold.valid() else [], dtype="int64")})


def invalid_files(source_files: DataFrame) -> DataFrame:
    """(file_id) of the files that aren't valid; see the module's text."""
    d = source_files.select("file_id", "file_path", "content").filter(F.col("content").isNotNull())
    ext = F.lower(F.regexp_extract("file_path", r"\.([A-Za-z0-9]+)$", 1))
    big = (F.length("content") > PIECE_CHARS) & ext.isin([e for e, f in L.FAMILY.items() if f in PIECEWISE])
    whole = d.filter(~big).mapInPandas(_check_whole, "file_id long")
    facts = pieces_with_start(d.filter(big), PIECE_CHARS).mapInPandas(_piece_facts, f"file_id long, k int, family string, {_FACTS}")
    files = facts.repartition("file_id").sortWithinPartitions("file_id", "k")
    return whole.unionByName(files.mapInPandas(_fold, "file_id long")).distinct()


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return invalid_files(table(spark, sf_dir, "source_files"))


def p4_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per repo and language (the most frequent one that tags give the file, else the extension): files, invalid
    files, their rate, and the symbols that the extractor still got out of invalid files (null counts as none)."""
    src = table(spark, sf_dir, "source_files").select("file_id", "repo", "file_path")
    tags = table(spark, sf_dir, "tags").filter("language is not null").distinct()
    per = tags.groupBy(F.col("repo").alias("r"), F.col("file").alias("f"), "language").agg(F.count("*").alias("n"))
    lang = per.groupBy("r", "f").agg(F.max_by("language", F.struct("n", "language")).alias("language"))
    ext = F.lower(F.regexp_extract("file_path", r"\.([A-Za-z0-9]+)$", 1))
    syms = table(spark, sf_dir, "extracted_files").select("file_id", F.coalesce("symbol_count", F.lit(0)).alias("symbols"))
    bad = p4_found(spark, sf_dir).withColumn("bad", F.lit(1))
    d = src.join(bad, "file_id", "left").join(syms, "file_id", "left").join(lang, (src.repo == F.col("r")) & (src.file_path == F.col("f")), "left")
    d = d.withColumn("language", F.coalesce("language", ext))
    return d.groupBy("repo", "language").agg(
        F.count("*").alias("n_files"),
        F.count("bad").alias("n_invalid"),
        F.round(F.count("bad") / F.count("*"), 6).alias("invalid_rate"),
        F.sum(F.when(F.col("bad") == 1, F.coalesce("symbols", F.lit(0))).otherwise(0)).alias("symbols_in_invalid"),
    )
