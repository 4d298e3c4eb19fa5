"""Globs compiled on the driver to regular expressions of the subset common to Java and RE2."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def glob_regex(glob: str, simple: bool = False) -> str:
    """A glob as an anchored regular expression over forward-slash paths.

    ``*`` and ``?`` stay inside a path part, ``**`` crosses parts, ``{a,b}`` are alternatives, ``[...]`` classes. A glob without a
    slash matches the last part at any depth. ``simple``: the dialect in which ``**`` is just "anything" and a slash-less glob
    is anchored nowhere special.
    """
    out, i, depth = [], 0, 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i) and not simple:
            out.append("(?:.*/)?")
            i += 3
            continue
        if glob.startswith("**", i):
            out.append(".*")
            i += 2
            continue
        if c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "{":
            out.append("(?:")
            depth += 1
        elif c == "}" and depth:
            out.append(")")
            depth -= 1
        elif c == "," and depth:
            out.append("|")
        elif c == "[" and "]" in glob[i + 1 :]:
            j = glob.index("]", i + 1)
            body = glob[i + 1 : j].replace("\\", "\\\\")
            out.append("[" + ("^" + body[1:] if body[:1] in "!^" else body) + "]")
            i = j
        else:
            out.append(re.escape(c) if not c.isalnum() and c not in "_/" else c)
        i += 1
    body = "".join(out)
    return f"(?:^|/){body}$" if "/" not in glob and not simple else f"^{body}$"


def matches_globs(path: Column, globs: list[str]) -> Column:
    """Any plain glob matches and no negated one does; with negated ones only, all the rest is included."""
    plain = [g for g in globs if not g.startswith("!")]
    negated = [g[1:] for g in globs if g.startswith("!")]
    keep = F.lit(not plain)
    for g in plain:
        keep = keep | path.rlike(glob_regex(g))
    for g in negated:
        keep = keep & ~path.rlike(glob_regex(g))
    return keep


def static_prefix(glob: str) -> tuple[str, str]:
    """(directory without any pattern sign, rest) of a glob; a ".." part is refused."""
    parts = glob.split("/")
    if ".." in parts:
        raise ValueError("a glob must not leave its root")
    k = next((i for i, p in enumerate(parts) if re.search(r"[*?\[{]", p)), len(parts) - 1)
    return "/".join(parts[:k]), "/".join(parts[k:])
