"""Functions and methods paired with their documentation.

Recursive patterns of the ``regex`` library capture comment, signature and balanced body together, with strings and
comments protected; pairs whose documentation says nothing are dropped.

A symbol gives a pair where comment, signature and body are captured from the source and the captured comment says
something. Where the body doesn't balance (broken code) a second pattern takes it up to the end of the range, with
``balanced`` false. Where no comment stands at the symbol, or one with other words than its ``docstring`` field (a symbol of an older
generation), the field is the documentation.

The symbols of a file meet its text once. Files with more than ``GROUP_ROWS`` symbols are cut into blocks of ``BLOCK_LINES`` lines, each with the
lines that its own symbols' ranges need and no others, so the text isn't repeated for each group and no group grows beyond ``GROUP_ROWS`` or so,
however many begin in one block. Defined cases: exact duplicate rows count once; symbols whose file is gone, whose range
is null or ends past the file give no pair; null and blank docstrings give none.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylens.session import table

BLOCK_LINES = 1000
#: A group of symbols of one block larger than this is split by the hash of their ids.
GROUP_ROWS = 4096
FUNCTION_KINDS = ["fn", "method", "function"]

# ---------------------------------------------------------------- capture of comment, signature and body

_BRACES = regex.compile(
    r"""(?(DEFINE)
      (?<str>"(?:[^"\\\n]|\\.)*+"|`(?:[^`\\]|\\.)*+`|'(?:[^'\\\n]|\\.)*+')
      (?<com>//[^\n]*+|/\*(?:[^*]|\*(?!/))*+\*/)
      (?<par>\((?:[^()"'`/]++|(?&str)|(?&com)|(?&par)|['"`/])*+\))
      (?<blk>\{(?:[^{}"'`/]++|(?&str)|(?&com)|(?&blk)|['"`/])*+\})
    )
    \s*+(?<comment>(?:(?&com)\s*+)*+)
    (?<signature>(?:[^{}();"'`/]++|(?&par)|(?&str)|(?&com)|/)*+)
    (?<body>(?&blk))""",
    regex.X | regex.S,
)
_INDENTED = regex.compile(
    r"""(?(DEFINE)
      (?<str>[rRbBuUfF]{0,2}(?:\"{3}(?:[^"\\]|\\.|"(?!""))*+\"{3}|'{3}(?:[^'\\]|\\.|'(?!''))*+'{3}|"(?:[^"\\\n]|\\.)*+"|'(?:[^'\\\n]|\\.)*+'))
      (?<com>\#[^\n]*+)
      (?<brk>[(\[{](?:[^()\[\]{}"'\#]++|(?&str)|(?&com)|(?&brk))*+[)\]}])
    )
    \s*+(?<comment>(?:(?&com)\s*+)*+)
    (?<signature>(?:@[^\n]*+\n\s*+)*+(?:async\s++)?(?:def|class)\s++\w++\s*+(?:\[[^\]]*+\])?\s*+(?&brk)?+[^:\n\#]*+:)
    (?<body>(?:[ \t]*+(?&com))?+\s*+(?<inner>(?&str))?+(?:[^"'()\[\]{}\#]++|(?&str)|(?&com)|(?&brk))*+)""",
    regex.X | regex.S,
)
# what doesn't balance inside the range: the signature ends at the first opening of a body or at its line's end
_BRACES_OPEN = regex.compile(
    r"""(?(DEFINE)
      (?<str>"(?:[^"\\\n]|\\.)*+"|`(?:[^`\\]|\\.)*+`|'(?:[^'\\\n]|\\.)*+')
      (?<com>//[^\n]*+|/\*(?:[^*]|\*(?!/))*+\*/)
      (?<par>\((?:[^()"'`/]++|(?&str)|(?&com)|(?&par)|['"`/])*+\))
    )
    \s*+(?<comment>(?:(?&com)\s*+)*+)
    (?<signature>(?=\S)(?:(?&par)|(?&str)|(?&com)|[^{;\n])*+)
    (?<body>.*+)""",
    regex.X | regex.S,
)
_INDENTED_OPEN = regex.compile(
    r"""(?(DEFINE)
      (?<str>[rRbBuUfF]{0,2}(?:\"{3}(?:[^"\\]|\\.|"(?!""))*+\"{3}|'{3}(?:[^'\\]|\\.|'(?!''))*+'{3}|"(?:[^"\\\n]|\\.)*+"|'(?:[^'\\\n]|\\.)*+'))
      (?<com>\#[^\n]*+)
      (?<brk>[(\[{](?:[^()\[\]{}"'\#]++|(?&str)|(?&com)|(?&brk))*+[)\]}])
    )
    \s*+(?<comment>(?:(?&com)\s*+)*+)
    (?<signature>(?=\S)(?:@[^\n]*+\n\s*+)*+(?:(?&brk)|[^:\n\#])*+:?+)
    (?<body>(?:[ \t]*+(?&com))?+\s*+(?<inner>(?&str))?+.*+)""",
    regex.X | regex.S,
)
_INDENTED_LANGUAGES = frozenset({"py", "pyi"})


def _parts(m: regex.Match, indented: bool) -> tuple[str, str, str]:
    return (m["inner"] if indented and m["inner"] else m["comment"]).strip(), m["signature"].strip(), m["body"]


def capture(code: str, extension: str) -> tuple[str, str, str] | None:
    """(comment, signature, body) of the function that begins ``code``; null where brackets don't balance."""
    indented = extension in _INDENTED_LANGUAGES
    m = (_INDENTED if indented else _BRACES).match(code)
    return _parts(m, indented) if m else None


def capture_open(code: str, extension: str) -> tuple[str, str, str] | None:
    """The same where the body doesn't balance: it goes to the end of ``code``. Null where there is no signature."""
    indented = extension in _INDENTED_LANGUAGES
    m = (_INDENTED_OPEN if indented else _BRACES_OPEN).match(code)
    return _parts(m, indented) if m and m["signature"].strip() else None


_LINE_END = regex.compile(r"\r\n|\r|\n")


def split_lines(text: str) -> list[str]:
    return _LINE_END.split(text)


def range_text(lines: list[str], start_line: int, start_col: int, end_line: int, end_col: int) -> str:
    """The text of a 1-based range; ``end_col`` is exclusive."""
    part = lines[start_line - 1 : end_line]
    if not part:
        return ""
    part[-1] = part[-1][: end_col - 1] if len(part) > 1 else part[-1][: max(0, end_col - 1)]
    part[0] = part[0][max(0, start_col - 1) :]
    return "\n".join(part)


_COMMENT_LINE = regex.compile(r"\s*(?://|\#|/?\*|\*/)")


def leading_comment(lines: list[str], start_line: int) -> str:
    """The comment lines right above a symbol."""
    at = start_line - 1
    while at > 0 and _COMMENT_LINE.match(lines[at - 1]):
        at -= 1
    return "\n".join(lines[at : start_line - 1])


# ---------------------------------------------------------------- does the documentation say anything

_MARKS = regex.compile(r"^\s*(?:/\*+!?|\*+/|//[/!]?|\*(?!\w)|\#+|[rRuU]?\"{3}|'{3})\s?|\s*(?:\*+/|\"{3}|'{3})\s*$")
# fixed values: markers that stand for missing documentation
_STUBS = regex.compile(
    r"(?i)^\W*(?:(?:todo|fixme|xxx|tbd|hack|wip|n/?a|none|null|nil|undocumented|placeholder|stub|no (?:documentation|description|docs?|comment)|missing (?:docs?|documentation|description))\b[\s\W]*)+"
    r"(?:(?:later|soon|here|this|it|me|please|document(?:ation|ed)?|docs?|describe|description|write|add|fill|in|out|explain|update|fix|needs?|comment)\b[\s\W]*)*$"
    r"|^\W*(?:auto[- ]?generated|generated|automatically generated)(?: \w+)? (?:stub|comment|docs?|documentation|method|code|by \w+)\W*$"
    r"|^\W*(?:to be (?:documented|done|written|determined)|not (?:yet )?documented|document (?:this|me)|write me|fill (?:me )?in|see (?:above|below|code|super|parent|base(?: class)?))\W*$"
)
_INHERIT = regex.compile(r"(?i)\{?@inherit_?docs?\}?|\{@inheritdoc\}|:inherit(?:ed)?:|\binherit(?:ed)? (?:docs?|documentation|javadoc)(?: (?:from|of) [\w.#]+)?|\b(?:see|same as) (?:the )?(?:base|super|parent)(?: ?class)?(?: (?:method|docs?|documentation))?\W*$")
_LICENCE = regex.compile(r"(?i)copyright (?:\(c\)|©|\d{4}|the )|\(c\) \d{4}|SPDX-License|all rights reserved|licen[cs]ed under|permission is hereby granted|see the licen[cs]e file|without warranty|redistribution and use|apache license|\bMIT licen[cs]e|GNU (?:lesser |general |affero )")
_TAG = regex.compile(
    r"^\s*(?:[@\\](?:param|arg|argument|tparam|typeparam|prop|property|throws|exception|raises?|template)\b\s*(?:\{[^}]*\}\s*)?(?:\[?[\w.$]+\]?)?\s*(?:\{[^}]*\})?|[@\\](?:returns?|yields?|type|rtype)\b\s*(?:\{[^}]*\})?|[@\\]\w+|:(?:param|arg|type|raises?|keyword|var|ivar)\s+[\w. *]+:|:(?:returns?|rtype|yields?):|\{@\w+[^}]*\})\s*[-–:]?\s*"
)
_TYPE_TAG = regex.compile(r"^\s*(?::(?:rtype|type)\b[^:]*:|[@\\](?:type|rtype|author|since|version|see|ref|link|file|module|class|function|method|memberof)\b).*$")
_LIST_NAME = regex.compile(r"^\s*[-*+•]\s*`?[\w.$]+`?(?:\s*[:(]?\s*(?:int|str|string|bool|float|any|object|number|bytes)\)?)?\s*[:.]?\s*$")
_CODE = regex.compile(
    r"""^\s*(?:
      [\w.$\[\]<>:&*]+\s*\([^()]*(?:\([^()]*\)[^()]*)*\)\s*;?\s*(?://.*|\#.*)?            # a call
    | (?:return|throw|raise|await|yield|assert|import|from|using|package|break|continue|pass)\b(?:\s+[\w.*]+)?\s*;?\s*   # a statement
    | (?:return|throw|raise|await|yield|assert|import|from|using|package)\b.*(?:\w\([^()]*\)|[;=\[\]{}]).*
    | (?:let|var|const|auto|final|static|public|private|int|mut|val|def|fn|func|function|class)\s+[\w\s:<>\[\],&*]*[=({:].*
    | (?:if|for|while|switch|elif|else\ if|match)\b.*[({:].*[;){}:]\s*(?:[\w.]+(?:\(.*\))?;?)?\s*$
    | [\w.$\[\]"']+\s*(?:[-+*/|&]?=|:=)\s*\S.*
    | .*;\s*(?://.*)?$
    | [\s(){}\[\];,]+
    | .*[^\s.]\s*[{}]\s*$
    | \$\s.+
    | (?i:select|insert|update|delete)\s.*\b(?i:from|into|set|where)\b.*
    )$""",
    regex.X,
)
_CODE_START = regex.compile(r"^\s*(?:return|pass|break|continue)\s+\w+\s*(?:\(|;|$)")
_WORD = regex.compile(r"[\p{L}\p{N}]+(?:['’][\p{L}]+)?")
_CJK = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}]")
_SUBWORD = regex.compile(r"\p{Lu}+(?!\p{Ll})|\p{Lu}?\p{Ll}+|\p{N}+|\p{Lo}+")
_FILLERS = frozenset("a an the this that it is of to for in and or constructor destructor getter setter accessor method function class helper internal private public gets sets returns default main".split())


def name_words(name: str) -> set[str]:
    return {w.lower() for w in _SUBWORD.findall(name or "")}


def clean_description(doc: str) -> str:
    """The documentation without comment marks, one entry a line."""
    out = []
    for line in split_lines(doc):
        previous = None if line.lstrip()[:1] in "/*#\"'rRuU" or line.rstrip()[-1:] in "/\"'" else line
        while previous != line:
            previous, line = line, _MARKS.sub("", line)
        out.append(line.strip())
    return "\n".join(out).strip()


def says_something(doc: str | None, name: str | None) -> bool:
    """False where the documentation is null, blank, punctuation, a stub or inherit note, a one-word filler, tags without
    description, code, licence text, or only the symbol's own name or its words."""
    if not doc or not doc.strip():
        return False
    text = clean_description(doc)
    text = _INHERIT.sub(" ", text)
    if _LICENCE.search(text):
        return False
    kept = []
    for line in split_lines(text):
        line = line.strip()
        if not line or _TYPE_TAG.match(line) or _LIST_NAME.match(line):
            continue
        line = _TAG.sub("", line)
        if not line or _CODE.match(line) or _CODE_START.match(line):
            continue
        kept.append(line)
    text = " ".join(kept)
    words = _WORD.findall(text)
    if not words:
        return False
    if name and words[0] == name:  # the style that begins with the name
        text = text[text.index(name) + len(name) :]
        words = words[1:]
    if not words or _STUBS.match(text):
        return False
    if _CJK.search(text):
        return len(_CJK.findall(text)) >= 4
    own = name_words(name or "") | {"test", (name or "").lower()}
    told = [w for w in words if w.lower() not in own and name_words(w) - own]
    if len(words) < 2 or not told:
        return False
    return any(w.lower() not in _FILLERS and not w.isdigit() for w in told) and not (len(told) < 2 and len(words) <= 3)


# ---------------------------------------------------------------- the operator


def _pair_schema() -> str:
    return "symbol_id long, file_id long, repo string, file_path string, name string, kind string, description string, comment string, signature string, code string, balanced boolean"


def _same_words(a: str, b: str) -> bool:
    return _WORD.findall(a.lower()) == _WORD.findall(b.lower())


def pair_of(lines: list[str], symbol, extension: str) -> tuple[str, str, str, str, bool] | None:
    """(description, comment, signature, code, balanced) of a symbol whose range lies within ``lines``, those of its file from its
    leading comment on; null where nothing is captured or the documentation says nothing."""
    code = range_text(lines, symbol["start_line"], symbol["start_col"], symbol["end_line"], symbol["end_col"])
    above = leading_comment(lines, symbol["start_line"])
    whole = f"{above}\n{code}" if above else code
    got = capture(whole, extension) or (capture(code, extension) if above else None)
    balanced = got is not None
    got = got or capture_open(whole, extension)
    if got is None:
        return None
    description, field = clean_description(got[0]), clean_description(symbol["docstring"])
    if not _same_words(description, field):  # another generation's, or none
        description = field
    return (description, got[0], got[1], code, balanced) if says_something(description, symbol["name"]) else None


def _pairs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pairs of groups of symbols; ``first_line`` is the number of the first line in ``content``, ``total`` the file's lines
    where ``content`` is a part of it."""
    cols = [c.split()[0] for c in _pair_schema().split(", ")]
    for f in frames:
        rows: list[tuple] = []
        for content, first, total, path, repo, file_id, symbols in zip(f["content"], f["first_line"], f["total"], f["file_path"], f["repo"], f["file_id"], f["symbols"]):
            lines = split_lines(content or "")
            count = total if total >= 0 else line_count(lines)
            ext = (path or "").rpartition(".")[2].lower()
            for s in symbols:
                if s["end_line"] > count:
                    continue
                here = {**s, "start_line": s["start_line"] - first + 1, "end_line": s["end_line"] - first + 1}
                got = pair_of(lines, here, ext)
                if got:
                    rows.append((s["symbol_id"], file_id, repo, path, s["name"], s["kind"], *got))
                if len(rows) >= 2000:
                    yield pd.DataFrame(rows, columns=cols)
                    rows = []
        yield pd.DataFrame(rows, columns=cols)


def line_count(lines: list[str]) -> int:
    return len(lines) - (1 if lines and not lines[-1] else 0)


def _cut_blocks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of each file, for each block that symbols begin in, the lines their ranges need, leading comments with them."""
    for f in frames:
        for file_id, repo, path, content, blocks in zip(f["file_id"], f["repo"], f["file_path"], f["content"], f["blocks"]):
            lines = split_lines(content)
            count = line_count(lines)
            rows = []
            for b in blocks:
                lo, hi = min(b["lo"], len(lines)), min(b["hi"], len(lines))
                lo -= len(leading_comment(lines, lo).split("\n")) if leading_comment(lines, lo) else 0
                rows.append((file_id, repo, path, b["block"], lo, count, "\n".join(lines[lo - 1 : hi])))
            yield pd.DataFrame(rows, columns=["file_id", "repo", "file_path", "block", "first_line", "total", "content"])


def documented_functions(symbols: DataFrame, source_files: DataFrame) -> DataFrame:
    """One row per function or method with real documentation: its code, signature, comment and description."""
    need = ["start_line", "start_col", "end_line", "end_col"]
    s = symbols.filter(F.col("kind").isin(FUNCTION_KINDS) & (F.length(F.trim("docstring")) > 0) & F.col("file_id").isNotNull())
    for c in need:
        s = s.filter(F.col(c).isNotNull())
    s = s.filter((F.col("start_line") >= 1) & (F.col("end_line") >= F.col("start_line")))
    s = s.select("file_id", "symbol_id", "name", "kind", *need, "docstring").distinct()
    item = F.struct("symbol_id", "name", "kind", *need, "docstring")
    files = source_files.select("file_id", "repo", "file_path", "content").filter(F.col("content").isNotNull())
    # files with more symbols than a group may hold: counted with partial sums, few, and absent in ordinary data
    s = s.withColumn("block", F.expr(f"start_line div {BLOCK_LINES}"))
    blocks = s.groupBy("file_id", "block").agg(F.count("*").alias("n"), F.min("start_line").alias("lo"), F.max("end_line").alias("hi"))
    large = blocks.groupBy("file_id").agg(F.sum("n").alias("all"), F.collect_list(F.struct("block", "lo", "hi")).alias("blocks")).filter(F.col("all") > GROUP_ROWS)
    parts = blocks.join(large.select("file_id"), "file_id").select("file_id", "block", F.ceil(F.col("n") / GROUP_ROWS).alias("parts"))
    s = s.join(parts, ["file_id", "block"], "left")
    small = s.filter("parts is null").groupBy("file_id").agg(F.collect_list(item).alias("symbols"))
    once = small.join(files, "file_id").select("file_id", "repo", "file_path", "content", F.lit(1).alias("first_line"), F.lit(-1).alias("total"), "symbols")
    cut = files.join(large.select("file_id", "blocks"), "file_id").mapInPandas(_cut_blocks, "file_id long, repo string, file_path string, block int, first_line int, total int, content string")
    groups = s.filter("parts is not null").withColumn("part", F.pmod(F.xxhash64("symbol_id"), "parts")).groupBy("file_id", F.col("block").cast("int").alias("block"), "part").agg(F.collect_list(item).alias("symbols"))
    many = groups.join(cut, ["file_id", "block"]).select("file_id", "repo", "file_path", "content", "first_line", "total", "symbols")
    return once.unionByName(many).mapInPandas(_pairs, _pair_schema())


def p1_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documented_functions(table(spark, sf_dir, "symbols"), table(spark, sf_dir, "source_files"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p1_pairs(spark, sf_dir).select("symbol_id").distinct()
