"""Generated, minified, vendored and data files among source code, so that only hand-written source remains.

Vendored copies are found by winnowing: the normalised token stream of a file (comments and white space dropped, names,
numbers and string contents kept) is hashed in windows of ``GRAM`` tokens, of each ``WINDOW`` consecutive hashes the least is
kept, and a file most of whose fingerprints recur in several repositories is a copy. Fingerprints are aggregated to
distinct repositories per fingerprint before anything is joined back, and only counts meet the files again.

The other kinds show in the file itself: a notice of a tool or of a third party at its top, packed lines, or mostly
numbers and encoded text. Configuration files are hand-written. Size alone and failing to parse prove nothing.

Defined cases: null content is judged by its path only; empty files are hand-written; a repository without a configuration
has no excluded directories; exact duplicate rows count once; a fingerprint with a null repository counts as one
repository of its own.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylens.llm import lexer as L
from quarrylens.session import cut_lineage, table

GRAM, WINDOW = 16, 8
#: A fingerprint recurs when it is in this many repositories or more; a file is a copy when this share of its own recur.
LEAST_REPOS, COPIED_SHARE = 3, 0.75
#: At most so many fingerprints are called hot and broadcast; a fingerprint is hot above its even share of all rows.
MOST_HOT = 10_000
CONFIGURATION = frozenset({"json", "jsonc", "yaml", "toml", "hcl", "xml"})

# ---------------------------------------------------------------- what shows in the file itself

# fixed values: ways in which tools and projects say where a file comes from
_TOOL_NOTICE = re.compile(
    r"""(?ix)
      \bcode\ generated\ by\b | \bauto-?generated\ (?:file|by|code|from)\b | <auto-?generated> | (?<![\w.])@generated\b
    | \b(?:this\ (?:file|code|module|source)\ (?:is|was|has\ been)\ )(?:automatically\ |machine[ -]?|auto-?)generated\b
    | \b(?:automatically|machine)[ -](?:generated|written|produced)\b(?:\ (?:by|from|file))? | (?<!not\ )\bgenerated\ by\ \S+ | \bgenerated\ (?:file|code)\b.{0,40}\b(?:do\ not|don't)\ (?:edit|modify|touch)
    | \b(?:built|produced|compiled|emitted|created|written)\ from\ \S+\.\w+\ by\b | \bmachine\ written\ from\b | \boutput\ of\ \S+?\.?\s+(?:source\ of\ truth|do\ not\ edit)
    | \bsource\ of\ truth:\ \S+\.\w+ | \b(?:do\ not|don't)\ (?:edit|modify|touch)\b.{0,40}\bgenerated\b | \bchanges\ to\ this\ file\ (?:will|may)\ be\ (?:lost|overwritten)\b | \bmanual\ (?:edits|changes)\ (?:are|will\ be)\ (?:overwritten|lost)\b
    | automatisch\ (?:erzeugt|generiert|erstellt) | maschinell\ (?:erzeugt|erstellt) | \b(?:produit|généré|genere)\ (?:automatiquement\ )?par\b | (?:fichier|code)\ généré
    | generado\ (?:automáticamente|por) | gerado\ (?:automaticamente|por) | сгенерирован | создан\ автоматически | 자동으로\ (?:만든|생성) | 자동\ 생성 | 自動生成 | 自动生成
    """
)
_NEAR_TOOL = re.compile(r"(?i)\bids? (?:are|is) auto-?generated|\b(?:module|file|script|code) generates\b|auto-?generated (?:by the database|ids?|keys?)")
_THIRD_PARTY = re.compile(
    r"""(?ix)
      \bvendored\ (?:from|copy) | \bcopied\ (?:unchanged|verbatim|unmodified|as\ is)\ from\b | \bthird[- ]party\ (?:code|source|file|library|component) | \blocal\ (?:changes|modifications):\ none\b | \bupstream:\ https?://\S+
    | ^\W*[\w.@/-]+\ v?\d+\.\d+(?:\.\d+)*[\w.-]*\ \|\ (?:\(c\)|©) | \|\ (?:MIT|BSD|Apache|ISC)\b.{0,20}licen[cs]e\s*(?:\*/)?\s*$ | \bsend\ (?:fixes|patches)\ upstream\b | \bimported\ from\ upstream\b
    """
)
_SCHEMA_SOURCE = re.compile(r"(?im)^\W*source:\s*\S+\.(?:proto|thrift|fbs|avsc|graphql|idl|xsd|g4|y)\b")
_DESCRIPTOR = re.compile(r"(?im)^\W*(?:descriptor|file[ _]descriptor|schema hash|checksum)\b\W*[0-9a-f]{8,}")
# notices that say so in one line of their own, wherever in the file the comment stands
_STRICT_NOTICE = re.compile(r"(?im)^\W*(?:code generated by \S.*\bdo not edit\W*|@generated\W*|<auto-?generated\s*/?>|this (?:file|code|module) (?:is|was) (?:auto|automatically |machine[ -])-?generated\b.*\b(?:do not|don't) (?:edit|modify)\W*)$")
# lines that may stand between the comments at a file's top: packages, imports, directives
_PREAMBLE = re.compile(
    r"""(?mx)(?>\s*(?: \#!.* | \#[ \t]*(?:include|pragma|ifndef|define[ \t]+\w+[ \t]*$).* | <\?php | "";?
      | (?:package|import|from|use|using|extern[ ]crate|mod)\b[^;{(\n]*(?:\{[^{}]*\}|\([^()]*\))?[^;\n]*;? | export\b[^;{\n=(]*(?:\{[^{}]*\})?\s*from\b[^;\n]*;?
      | (?:const|let|var)\s[^;=\n]*=\s*require\([^)]*\);? ))*+\s*"""
)


_BLANK = re.compile(r"\s")
_NUMBERS = re.compile(r"(?:[-+]?(?:0[xX][0-9a-fA-F]+|\d[\d._]*(?:[eE][-+]?\d+)?)[fFuUlL]*\s*,\s*){8,}")


def top_comments(text: str, found: list[tuple[int, int, int, bool]]) -> str:
    """All comments before the first declaration, and Python's first string, however long they are; ``found`` are the
    text's comments and strings."""
    out, gap, at = [], [], 0
    for s, e, st, _ in found:
        gap.append(text[at:s])
        at = e
        if st in (L.LINE, L.BLOCK):
            between = "".join(gap)
            if between.strip() and not _PREAMBLE.fullmatch(between):
                break
            out.append(text[s:e])
            gap = []
        elif st in (L.DOUBLE3, L.SINGLE3) and not out and not "".join(gap).strip():
            out.append(text[s:e])
            gap = []
        else:
            gap.append('""')
    return "\n".join(out)


def later_notice(text: str, found: list[tuple[int, int, int, bool]]) -> bool:
    """Whether a comment on lines of its own, anywhere, says in a line of its own that a tool wrote the file."""
    for s, e, st, _ in found:
        if st in (L.LINE, L.BLOCK) and _STRICT_NOTICE.search(text, s, e) and not text[max(text.rfind("\n", 0, s), text.rfind("\r", 0, s)) + 1 : s].strip():
            return True
    return False


def shape(text: str, found: list[tuple[int, int, int, bool]]) -> tuple[float, float]:
    """(share of the code that is numbers in lists and long encoded strings, share of it on packed lines); ``found``
    are the text's comments and strings."""
    masked, at, comments, encoded = [], 0, 0, 0
    for s, e, st, _ in found:
        masked.append(text[at:s])
        at = e
        if st in (L.LINE, L.BLOCK):
            comments += e - s
        else:
            if e - s >= 60 and _BLANK.search(text, s, e) is None and not text.startswith(("data:", "http"), s + 1):
                encoded += e - s
            masked.append('""')
    masked.append(text[at:])
    code = "".join(masked)
    total = max(1, len(text.strip()) - comments)
    numbers = sum(m.end() - m.start() for m in _NUMBERS.finditer(code))
    size = max(1, len(code.strip()))
    packed = sum(len(x) for x in re.split(r"[\r\n]+", code) if len(x) > 200 and x.count(" ") < 0.12 * len(x))
    return (numbers + encoded) / total, packed / size


def own_reason(text: str, family: str, found: list[tuple[int, int, int, bool]]) -> str | None:
    """Why a code file isn't hand-written, from itself alone: generated, vendored, minified or data; else null."""
    top = top_comments(text, found)
    if later_notice(text, found):
        return "generated"
    if top:
        notice = _NEAR_TOOL.sub(" ", top)
        if _TOOL_NOTICE.search(notice) or (_SCHEMA_SOURCE.search(top) and _DESCRIPTOR.search(top)):
            return "generated"
        if any(_THIRD_PARTY.search(line) for line in top.split("\n")):
            return "vendored"
    data, packed = shape(text, found)
    if data >= 0.6:
        return "data"
    if packed >= 0.5:
        return "minified"
    return None


# ---------------------------------------------------------------- winnowing

_TOKEN = re.compile(r"[^\W\d]\w*|\d[\w.]*|[^\s\w]")


def token_hashes(text: str, found: list[tuple[int, int, int, bool]]) -> np.ndarray:
    out: list[int] = []
    at = 0
    h = xxhash.xxh3_64_intdigest
    for s, e, st, _ in found:
        out += map(h, _TOKEN.findall(text[at:s]))
        if st not in (L.LINE, L.BLOCK):
            out.append(h(text[s + 1 : e - 1]))
        at = e
    out += map(h, _TOKEN.findall(text[at:]))
    return np.array(out, dtype=np.uint64)


_MULTIPLIERS = np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) for k in range(GRAM)], dtype=np.uint64)


def winnow(tokens: np.ndarray) -> np.ndarray:
    """The distinct fingerprints of a token stream. A stream shorter than a gram is one gram of its own length, and of a
    stream shorter than a window every gram is kept, so no stream is without fingerprints."""
    if not len(tokens):
        return np.zeros(0, np.uint64)
    size = min(GRAM, len(tokens))
    n = len(tokens) - size + 1
    with np.errstate(over="ignore"):
        grams = np.full(n, size, np.uint64)
        for k in range(size):
            grams += tokens[k : k + n] * _MULTIPLIERS[k]
        grams = (grams ^ (grams >> np.uint64(31))) * _MULTIPLIERS[0]
    if n <= WINDOW:
        return np.unique(grams)
    return np.unique(np.lib.stride_tricks.sliding_window_view(grams, WINDOW).min(axis=1))


def _judge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per file its own reason, and its fingerprints where it has none."""
    for f in frames:
        rows = []
        for i, r, p, t in zip(f["file_id"], f["repo"], f["file_path"], f["content"]):
            reason, prints = None, np.zeros(0, np.uint64)
            family = L.FAMILY.get(L.extension(p))
            if t and t.strip() and family is not None and family not in CONFIGURATION:
                t = t.lstrip("\ufeff")
                found, _ = L.spans(t, family)
                reason = own_reason(t, family, found)
                if reason not in ("data", "minified"):
                    prints = winnow(token_hashes(t, found))
            rows.append((i, r, reason, prints.view(np.int64)))
        yield pd.DataFrame(rows, columns=["file_id", "repo", "reason", "prints"])


def in_excluded_directory(path, excluded):
    """Column: does a directory of the path have a name in the array column (null array: false)."""
    parts = F.split(path, "/")
    dirs = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    return F.coalesce(F.arrays_overlap(dirs, excluded), F.lit(False))


def not_hand_written(source_files: DataFrame, configs: DataFrame) -> DataFrame:
    """(file_id, reason) of every file that isn't hand-written here; reasons: excluded, generated, vendored, minified, data.

    ``configs`` holds one row per repository, a table whose size follows the number of repositories; Spark picks the join.
    """
    files = source_files.select("file_id", "repo", "file_path", "content").filter(F.col("file_id").isNotNull())
    conf = configs.select(F.col("repo").alias("__r"), "excluded_directories").dropDuplicates(["__r"])
    path_only = files.select("file_id", "repo", "file_path")
    excluded = path_only.join(conf, F.col("repo") == F.col("__r"), "left").filter(in_excluded_directory(F.col("file_path"), F.col("excluded_directories"))).select("file_id", F.lit("excluded").alias("reason"))
    # read several times below: computed once, kept in the shared checkpoint folder
    judged = cut_lineage(files.mapInPandas(_judge, "file_id long, repo string, reason string, prints array<long>"))
    own = judged.filter("reason is not null").select("file_id", "reason")
    copied = vendored_copies(judged)
    rank = F.when(F.col("reason") == "excluded", 0).when(F.col("reason") == "generated", 1).when(F.col("reason") == "vendored", 2).otherwise(3)
    every = excluded.unionByName(own).unionByName(copied)
    return every.groupBy("file_id").agg(F.min_by("reason", rank).alias("reason"))


def vendored_copies(judged: DataFrame) -> DataFrame:
    """(file_id, 'vendored') of files whose fingerprints largely recur in several repositories.

    A fingerprint is first reduced to its distinct repositories (distinct rows, so one in a third of all files sends one row
    a task and repository), then to their number and that of its files. A hot fingerprint, one in more files than
    1 / ``MOST_HOT`` of all rows, never becomes the key of a shuffle: there can be at most ``MOST_HOT`` of them, so they are
    broadcast and met where the files are read. The others are joined by key, each with fewer rows than that.
    """
    some = judged.filter(F.size("prints") > 0)
    prints = some.select("file_id", F.coalesce("repo", F.lit("")).alias("repo"), F.explode("prints").alias("h"))
    total = some.agg(F.sum(F.size("prints")).alias("n")).first().n or 0
    per_repo = prints.groupBy("h", "repo").agg(F.count("*").alias("files"))
    recurring = per_repo.groupBy("h").agg(F.count("*").alias("repos"), F.sum("files").alias("files")).filter(F.col("repos") >= LEAST_REPOS)
    recurring = cut_lineage(recurring.select("h", (F.col("files") > max(4096, total // MOST_HOT)).alias("hot")))
    hot = F.broadcast(recurring.filter("hot").select("h", F.lit(1).alias("is_hot")))
    met = prints.select("file_id", "h").join(hot, "h", "left")
    by_hot = met.filter("is_hot is not null").groupBy("file_id").agg(F.count("*").alias("shared"))
    by_key = met.filter("is_hot is null").join(recurring.filter("not hot").select("h"), "h").groupBy("file_id").agg(F.count("*").alias("shared"))
    shared = by_hot.unionByName(by_key).groupBy("file_id").agg(F.sum("shared").alias("shared"))
    sizes = some.select("file_id", F.size("prints").alias("total"))
    return shared.join(sizes, "file_id").filter(F.col("shared") >= COPIED_SHARE * F.col("total")).select("file_id", F.lit("vendored").alias("reason"))


def p5_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return not_hand_written(table(spark, sf_dir, "source_files"), table(spark, sf_dir, "resolved_configs"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p5_reasons(spark, sf_dir).select("file_id")


def p5_hand_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(result_id, file_id) of search results whose file exists, is hand-written and within its repository's size limit."""
    src = table(spark, sf_dir, "source_files").select("file_id", "repo", "file_path", "size_bytes")
    conf = table(spark, sf_dir, "resolved_configs").select("repo", "max_file_size")
    kept = src.join(p5_found(spark, sf_dir), "file_id", "left_anti").join(conf, "repo", "left").filter("max_file_size is null or size_bytes is null or size_bytes <= max_file_size")
    res = table(spark, sf_dir, "search_results").select("result_id", "repo", "file_path").distinct()
    return res.join(kept, ["repo", "file_path"]).select("result_id", "file_id")
