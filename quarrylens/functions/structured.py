"""Functions that built-in expressions can't say: nesting, Unicode normal forms, shell words. Each comes as a plain Python
function and, where it runs over tables, as an Arrow-batched UDF."""

from __future__ import annotations

import json
import re
import unicodedata
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

# ---------------------------------------------------------------- JSON inside text


def first_json_object(text: str | None) -> str | None:
    """The first balanced JSON object of a text, a fenced one first; null where none parses."""
    if not text:
        return None
    for block in re.findall(r"```(?:json)?\s*\n(.*?)```", text, re.S):
        try:
            if isinstance(json.loads(block), dict):
                return block.strip()
        except ValueError:
            pass
    decoder = json.JSONDecoder()
    at = text.find("{")
    while at >= 0:
        try:
            value, end = decoder.raw_decode(text, at)
            if isinstance(value, dict):
                return text[at:end]
        except ValueError:
            pass
        at = text.find("{", at + 1)
    return None


# fixed values: stances of an opinion, the last where none is given, and the summary of an answer without structure
STANCES = ("agree", "disagree", "partial", "insufficient_info")
NO_STRUCTURE = "Pair agent did not return structured JSON. See raw_answer."


def parsed_opinion(text: str | None) -> dict[str, Any]:
    """An opinion from the first JSON object of an answer. Summary and recommendation must be texts, else the whole answer is kept as a
    fallback; an unknown stance is "insufficient_info"; lists keep their texts that aren't blank."""
    raw = first_json_object(text)
    o = json.loads(raw) if raw else {}
    filled = lambda v: isinstance(v, str) and v.strip() != ""
    lists = {k: [x for x in o.get(k) or [] if filled(x)] if isinstance(o.get(k), list) else [] for k in ("agreements", "concerns", "follow_up_questions")}
    if not (filled(o.get("summary")) and filled(o.get("recommendation"))):
        return {"stance": STANCES[-1], "summary": NO_STRUCTURE, "recommendation": "", **{k: [] for k in lists}, "parse_status": "fallback", "raw_answer": text or ""}
    return {"stance": o["stance"] if o.get("stance") in STANCES else STANCES[-1], "summary": o["summary"], "recommendation": o["recommendation"], **lists, "parse_status": "parsed", "raw_answer": None}


def schema_errors(value: Any, schema: dict, root: dict | None = None, at: str = "$") -> list[str]:
    """Violations of a subset of JSON schema: $ref, const, enum, type, required, properties, additionalProperties, items."""
    root = root or schema
    if "$ref" in schema:
        target: Any = root
        for part in schema["$ref"].lstrip("#/").split("/"):
            target = target[part]
        return schema_errors(value, target, root, at)
    out = []
    if "const" in schema and value != schema["const"]:
        out.append(f"{at}: not the constant")
    if "enum" in schema and value not in schema["enum"]:
        out.append(f"{at}: not in the list")
    kinds = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}
    wanted = schema.get("type")
    if wanted is not None:
        names = wanted if isinstance(wanted, list) else [wanted]

        def fits(k: str) -> bool:
            if k == "integer":
                return isinstance(value, int) and not isinstance(value, bool)
            if k == "number":
                return isinstance(value, (int, float)) and not isinstance(value, bool)
            return isinstance(value, kinds[k])

        if not any(fits(k) for k in names):
            return [*out, f"{at}: not {' or '.join(names)}"]
    if isinstance(value, dict):
        props = schema.get("properties", {})
        out += [f"{at}.{k}: missing" for k in schema.get("required", []) if k not in value]
        for k, v in value.items():
            if k in props:
                out += schema_errors(v, props[k], root, f"{at}.{k}")
            elif schema.get("additionalProperties") is False:
                out.append(f"{at}.{k}: unknown")
    if isinstance(value, list) and "items" in schema:
        for i, v in enumerate(value):
            out += schema_errors(v, schema["items"], root, f"{at}[{i}]")
    return out


# ---------------------------------------------------------------- text


def folded_words(text: str | None) -> list[str]:
    """Words of a text in compatibility form, case folded."""
    return re.findall(r"\w+", unicodedata.normalize("NFKC", text).casefold()) if text else []


_SHELLS = frozenset({"sh", "bash", "zsh", "dash", "ksh"})
_WORD_PARTS = re.compile(r"""(?P<blank>\s+)|'(?P<single>[^']*)(?:'|\Z)|"(?P<double>(?:[^"\\]|\\.)*\\?)(?:"|\Z)|\\(?P<escaped>.)|(?P<plain>[^\s'"\\]+|\\\Z)""", re.S)


def shell_words(command: str | None) -> list[str]:
    """Words of a command line; quotes and escapes resolved, everything else, such as pipes and redirections, as it stands. An
    unfinished quote ends with the line."""
    out: list[str] = []
    word: str | None = None
    for m in _WORD_PARTS.finditer(command or ""):
        kind = m.lastgroup
        if kind == "blank":
            if word is not None:
                out.append(word)
            word = None
            continue
        part = m[kind]
        if kind == "double":
            part = re.sub(r'\\(["\\$`])', r"\1", part)
        word = (word or "") + part
    return out if word is None else [*out, word]


def command_words(command: str | None) -> list[str]:
    """Words of the command, or of the one that a shell runs for it (``bash -c "..."``)."""
    words = shell_words(command)
    if words and re.split(r"[/\\]", words[0])[-1] in _SHELLS:
        at = next((i for i, w in enumerate(words) if i and w in ("-c", "--command")), None)
        if at is not None and at + 1 < len(words):
            return shell_words(words[at + 1]) or words
    return words


_BEFORE_TYPE = re.compile(r"\s*(?:new\s+|:\s*)*(?:[&*]\s*(?:'\w+\s+)?|(?:const|mut|ref)\s+)*(?:(?:struct|class|enum|union)\s+)?")
_HEAD = re.compile(r"[A-Za-z0-9_.:]+", re.A)


def owner_type(text: str | None) -> str | None:
    """The type that owns a collection, with its namespace: what marks a reference, a qualifier, an optional or a declaration is taken off,
    balanced generics with it. Null where more than one type or anything else is left."""
    t = (text or "").strip().rstrip(";").strip()
    t = t[_BEFORE_TYPE.match(t).end() :].rstrip("&* ").rstrip("?!").strip()
    head = _HEAD.match(t)
    if not head:
        return None
    rest, depth = t[head.end() :].strip(), 0
    if rest and not rest.startswith("<"):
        return None
    for i, c in enumerate(rest):
        depth += (c == "<") - (c == ">")
        if c in "|&" or rest.startswith("->", i) or (depth == 0 and i < len(rest) - 1):
            return None
    return head[0] if depth == 0 else None


@F.pandas_udf(StringType())
def first_json_object_udf(text: pd.Series) -> pd.Series:
    return text.map(first_json_object)


@F.pandas_udf(ArrayType(StringType()))
def folded_words_udf(text: pd.Series) -> pd.Series:
    return text.map(folded_words)


@F.pandas_udf(StringType())
def owner_type_udf(text: pd.Series) -> pd.Series:
    return text.map(owner_type)


@F.pandas_udf(StringType())
def main_command_udf(text: pd.Series) -> pd.Series:
    return text.map(lambda t: next(iter(command_words(t)), None))


def navigation_text(c: Column) -> Column:
    """An expression on one line: white space folded, none beside dots, double colons and inside parentheses."""
    out = F.trim(F.regexp_replace(c, r"\s+", " "))
    for wide, narrow in [(" .", "."), (". ", "."), (" ::", "::"), (":: ", "::"), (" (", "("), ("( ", "("), (" )", ")")]:
        out = F.replace(out, F.lit(wide), F.lit(narrow))
    return out


def type_text(c: Column) -> Column:
    """A type as written, without the colon or ``new`` before it and the semicolon after it; null where nothing is left."""
    t = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.trim(c), "^:+", ""), r"^(?:new )+", ""), r"\s*;+\s*$", ""))
    return F.when(F.length(t) > 0, t)


def base_name(c: Column) -> Column:
    """The last name of a qualified, generic or called expression, without marks of pointers; null where there is none."""
    head = F.trim(F.regexp_replace(F.trim(c), r"(?s)[<(\[].*$", ""))
    name = F.regexp_replace(F.regexp_extract(head, r"([^.:/\\ ]+)[.:/\\ ]*$", 1), r"^[*&]+|[*&]+$", "")
    return F.when(F.length(name) > 0, name)
