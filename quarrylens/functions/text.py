"""Scalar column functions over identifiers, paths, documentation and literals. All are built-in expressions, so they stay in
generated code; null in gives null out unless a docstring says otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# word ends: lower to upper, acronym to word, digit to letter, cased to uncased script, and separators
_SPLIT = r"(?<=[\p{Ll}0-9])(?=\p{Lu})|(?<=\p{Lu})(?=\p{Lu}\p{Ll})|(?<=[0-9])(?=\p{L})|(?<=\p{Lo})(?=[\p{Lu}\p{Ll}0-9])|(?<=[\p{Lu}\p{Ll}0-9])(?=\p{Lo})|[_-]+"


def split_identifier(c: Column) -> Column:
    """Lower-case words of an identifier: camel case, acronyms, digits and separators end words."""
    return F.transform(F.filter(F.split(c, _SPLIT), lambda x: F.length(x) > 0), F.lower)


def tokenize_path(c: Column) -> Column:
    """Path parts, split at slashes of either kind and at dots."""
    return F.filter(F.split(c, r"[/\\.]"), lambda x: F.length(x) > 0)


def file_name(c: Column) -> Column:
    return F.element_at(F.split(c, "/"), -1)


def parent_dir(c: Column) -> Column:
    """The directory of a path, "" at the top."""
    return F.regexp_replace(c, r"/?[^/]*$", "")


def extension(c: Column) -> Column:
    """Lower-case extension, "" without one."""
    return F.lower(F.regexp_extract(file_name(c), r"[^.]\.([^.]+)$", 1))


def normalize_path(c: Column) -> Column:
    """Forward slashes, no "." parts, ".." folded into the part before it; a leading ".." is dropped."""
    parts = F.filter(F.split(F.regexp_replace(c, r"\\", "/"), "/"), lambda x: (F.length(x) > 0) & (x != "."))
    folded = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, x: F.when(x == "..", F.when(F.size(acc) > 0, F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(acc)).otherwise(F.concat(acc, F.array(x))),
    )
    return F.array_join(folded, "/")


def ancestors(c: Column) -> Column:
    """All directories above a path, nearest last; empty for a file at the top."""
    parts = F.split(parent_dir(c), "/")
    n = F.size(parts)
    return F.when(F.length(parent_dir(c)) == 0, F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(1), n), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    )


def is_test_like_path(c: Column) -> Column:
    """Ranking's notion of test and bench paths."""
    low = F.lower(c)
    name = file_name(low)
    stem = F.element_at(F.split(name, r"\."), 1)
    return (
        low.rlike(r"(?:^|/)(?:tests|test|benches|bench|__tests__)/")
        | stem.startswith("test_")
        | stem.endswith("_test")
        | name.contains(".test.")
        | name.contains(".spec.")
    )


def path_indicates_test(c: Column) -> Column:
    """Extraction's notion of test paths, by whole segments and suffixes."""
    low = F.lower(c)
    name = F.element_at(F.split(low, r"[/\\]"), -1)
    return low.rlike(r"(?:^|/)tests?/") | name.startswith("test_") | name.contains("_test.") | name.contains(".test.") | name.contains("_spec.") | name.contains(".spec.")


def clean_docstring(c: Column) -> Column:
    """Text of documentation comments (``///``, ``//!``, ``/** */``); plain comments give null."""
    c = F.regexp_replace(c, r"^\s+|\s+$", "")
    one = F.array_join(
        F.transform(
            F.filter(F.split(c, r"\r?\n"), lambda x: F.trim(x).rlike(r"^//[/!]")),
            lambda x: F.trim(F.regexp_replace(F.trim(x), r"^(?:///+|//!)", "")),
        ),
        "\n",
    )
    block = F.array_join(
        F.transform(
            F.split(F.regexp_replace(F.regexp_replace(F.trim(c), r"^/\*\*", ""), r"\*/$", ""), r"\r?\n"),
            lambda x: F.trim(F.regexp_replace(F.trim(F.regexp_replace(F.trim(x), r"^\*+", "")), r"\*+$", "")),
        ),
        "\n",
    )
    out = F.when(F.trim(c).startswith("/**"), block).otherwise(one)
    out = F.regexp_replace(out, r"^\s+|\s+$", "")
    return F.when(F.length(out) > 0, out)


def strip_quotes(c: Column) -> Column:
    """A literal without its quotes and string prefixes, raw strings included."""
    t = F.trim(c)
    raw = F.regexp_extract(t, r'(?s)^r(#*)"(.*)"\1$', 2)
    is_raw = t.rlike(r'(?s)^r(#*)".*"\1$')
    bare = F.regexp_replace(t, r"^[rRfFbBuU]+(?=[\"'`])", "")
    inner = (
        F.when(bare.rlike(r'(?s)^""".*"""$') | bare.rlike(r"(?s)^'''.*'''$"), F.expr("null"))
        .when(bare.rlike(r'(?s)^".*"$|^\'.*\'$|^`.*`$') & (F.length(bare) >= 2), bare.substr(F.lit(2), F.length(bare) - 2))
        .otherwise(bare)
    )
    triple = bare.substr(F.lit(4), F.length(bare) - 6)
    three = (bare.rlike(r'(?s)^""".*"""$') | bare.rlike(r"(?s)^'''.*'''$")) & (F.length(bare) >= 6)
    return F.when(is_raw, raw).when(three, triple).otherwise(inner)


def qualified_name(language: Column, owner: Column, name: Column) -> Column:
    """``owner::name`` in Rust and C++, ``owner.name`` elsewhere; the name alone without an owner."""
    sep = F.when(F.lower(language).isin("rust", "c++", "cpp"), "::").otherwise(".")
    return F.when(F.length(owner) > 0, F.concat(owner, sep, name)).otherwise(name)


def qualified_leaf(c: Column) -> Column:
    return F.regexp_extract(c, r"([^:.]*)$", 1)


def cap_chars(c: Column, n: int, mark: str = "…") -> Column:
    """At most n characters, with a mark where something was cut."""
    return F.when(F.length(c) > n, F.concat(F.left(c, F.lit(n)), F.lit(mark))).otherwise(c)


def cap_bytes(c: Column, n: int) -> Column:
    """The longest beginning of at most n bytes that ends between characters."""
    chars = F.split(c, "")
    fit = F.aggregate(
        chars,
        F.struct(F.lit(0).alias("b"), F.lit(0).alias("k")),
        lambda acc, ch: F.when(acc["b"] + F.octet_length(ch) <= n, F.struct((acc["b"] + F.octet_length(ch)).alias("b"), (acc["k"] + 1).alias("k"))).otherwise(
            F.struct(F.lit(1 << 30).alias("b"), acc["k"].alias("k"))
        ),
        lambda acc: acc["k"],
    )
    return F.when(F.octet_length(c) <= n, c).otherwise(F.left(c, fit))


def numbered_line(line_no: Column, text: Column) -> Column:
    """A line as a reader shows it: its number to the right of six places, an arrow, the text."""
    return F.concat(F.lpad(line_no.cast("string"), 6, " "), F.lit("→"), text)


def escape_regex(c: Column) -> Column:
    return F.regexp_replace(c, r"([\\.+*?()\[\]{}|^$#&~/-])", r"\\$1")


def lines_of(content: Column) -> Column:
    """Lines of a text without the empty one after a trailing line end."""
    body = F.regexp_replace(content, r"(?:\r\n|\r|\n)\z", "")
    return F.when(F.length(content) == 0, F.array().cast("array<string>")).otherwise(F.split(body, r"\r\n|\r|\n"))
