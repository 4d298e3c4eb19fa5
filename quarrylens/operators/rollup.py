"""Hierarchical overviews: every directory with what lies below it, scopes of a monorepo, and capped listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrylens.functions import text as tx
from quarrylens.operators.symbols import SYM
from quarrylens.session import table

SCOPE_PARENTS = ["apps", "packages", "crates", "libs", "services"]
ROOT_ALIASES = {"all", "root", "repo", "*"}


def file_summaries(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """(file_id, repo, file_path, n_symbols): every file with its distinct symbols."""
    n = symbols.groupBy("file_id").agg(F.count("*").alias("n_symbols"))
    return files.select("file_id", "repo", "file_path").join(n, "file_id", "left").withColumn("n_symbols", F.coalesce("n_symbols", F.lit(0)))


def directory_rollup(summaries: DataFrame) -> DataFrame:
    """(repo, dir, n_files, n_symbols): each file counts in every directory above it."""
    d = summaries.select("repo", "n_symbols", F.explode(tx.ancestors(F.col("file_path"))).alias("dir"))
    return d.groupBy("repo", "dir").agg(F.count("*").alias("n_files"), F.sum("n_symbols").alias("n_symbols"))


def scopes(rollup: DataFrame) -> DataFrame:
    """(repo, scope, n_files): the immediate children of the usual parents, in repositories that have two or more."""
    s = rollup.filter(F.col("dir").rlike(r"^(?:" + "|".join(SCOPE_PARENTS) + r")/[^/]+$"))
    n = s.groupBy("repo").agg(F.count("*").alias("n"))
    return s.join(n.filter("n >= 2"), "repo").select("repo", F.col("dir").alias("scope"), "n_files")


def resolve_scope(wanted: str | None, known: list[str]) -> str | None:
    """A scope by its path, by its only last part, or none for the root's names; an unknown or ambiguous one is an error."""
    w = (wanted or "").strip().strip("/")
    if not w or w.lower() in ROOT_ALIASES:
        return None
    if w in known:
        return w
    last = [k for k in known if k.rpartition("/")[2] == w]
    if len(last) == 1:
        return last[0]
    if len(last) > 1:
        raise ValueError(f"ambiguous scope {w}: {', '.join(sorted(last))}")
    inside = sorted((k for k in known if w.startswith(k + "/")), key=len)
    if inside:
        return inside[-1]
    raise ValueError(f"unknown scope {w}")


def tree_anchors(dirs: list[tuple[str, int]], limit: int = 12) -> list[str]:
    """Directories that show the shape of a tree: leaves, junctions (two children or more) and chains' ends, the
    largest first; ``dirs`` are (path, files below)."""
    kids: dict[str, int] = {}
    for p, _ in dirs:
        parent = p.rpartition("/")[0]
        kids[parent] = kids.get(parent, 0) + 1
    keep = [(n, p) for p, n in dirs if kids.get(p, 0) != 1]
    return [p for n, p in sorted(keep, key=lambda x: (-x[0], x[1]))[:limit]]


def render_overview(rows: list[tuple[str, int, int]], cap: int = 60) -> str:
    """A markdown listing of (directory, files, symbols) rows."""
    shown = [f"- `{d}/` — {f} files, {s} symbols" for d, f, s in rows[:cap]]
    return "\n".join([*shown, *([f"- … {len(rows) - cap} more"] if len(rows) > cap else [])])


# ---------------------------------------------------------------- queries


def _sum(spark: SparkSession, d: str) -> DataFrame:
    return file_summaries(table(spark, d, "source_files"), table(spark, d, "symbols").distinct())


def d3_directory_rollup(spark, d):
    return directory_rollup(_sum(spark, d))


def d4_root_totals(spark, d):
    return _sum(spark, d).groupBy("repo").agg(F.count("*").alias("n_files"), F.sum("n_symbols").alias("n_symbols"), F.count(F.when(F.col("n_symbols") > 0, 1)).alias("n_with_symbols"))


def d4_folder_totals(spark, d):
    """Per folder what lies directly in it, and below it."""
    s = _sum(spark, d)
    direct = s.groupBy("repo", tx.parent_dir(F.col("file_path")).alias("dir")).agg(F.count("*").alias("direct_files"))
    return directory_rollup(s).join(direct, ["repo", "dir"], "left").select("repo", "dir", "n_files", F.coalesce("direct_files", F.lit(0)).alias("direct_files"))


def d26_monorepo_scopes(spark, d):
    return scopes(directory_rollup(_sum(spark, d)))


def l17_root_views(spark, d):
    """Repositories seen as scopes where they are monorepos, else as one root."""
    s = _sum(spark, d)
    sc = scopes(directory_rollup(s)).groupBy("repo").agg(F.count("*").alias("n_scopes"))
    t = s.groupBy("repo").agg(F.count("*").alias("n_files"))
    return t.join(sc, "repo", "left").select("repo", "n_files", F.when(F.col("n_scopes").isNotNull(), "scopes").otherwise("root").alias("view"), F.coalesce("n_scopes", F.lit(0)).alias("n_scopes"))


def f7_capped_directories(spark, d):
    """The largest sixty directories of each repository."""
    w = Window.partitionBy("repo").orderBy(F.desc("n_files"), "dir")
    return directory_rollup(_sum(spark, d)).withColumn("rank", F.row_number().over(w)).filter("rank <= 60").select("repo", "dir", "rank")


def f7_listed_paths(spark, d):
    """The first 200 paths of every repository."""
    w = Window.partitionBy("repo").orderBy("file_path")
    return table(spark, d, "source_files").select("repo", "file_path").withColumn("rank", F.row_number().over(w)).filter("rank <= 200")


def f9_tree_anchors(spark, d):
    """Leaves and junctions of each repository's directory tree (chains are left out), the twelve largest."""
    r = directory_rollup(_sum(spark, d))
    kids = r.groupBy("repo", tx.parent_dir(F.col("dir")).alias("dir")).agg(F.count("*").alias("n_children"))
    j = r.join(kids, ["repo", "dir"], "left").filter("n_children is null or n_children <> 1")
    w = Window.partitionBy("repo").orderBy(F.desc("n_files"), "dir")
    return j.withColumn("rank", F.row_number().over(w)).filter("rank <= 12").select("repo", "dir", "rank")


_SUM_SQL = f"{SYM}, fs as (select f.file_id, f.repo, f.file_path, coalesce(n, 0) as n_symbols from source_files f left join (select file_id, count(*) as n from s group by 1) using (file_id))"
_ROLL_SQL = f"{_SUM_SQL}, roll as (select repo, dir, count(*) as n_files, cast(sum(n_symbols) as bigint) as n_symbols from (select repo, n_symbols, unnest(list_transform(range(1, len(p)), lambda k: array_to_string(p[:k], '/'))) as dir from (select *, string_split(file_path, '/') as p from fs)) group by 1, 2)"
_SCOPE_RE = "^(?:" + "|".join(SCOPE_PARENTS) + ")/[^/]+$"
_SCOPE_SQL = f"sc as (select repo, dir as scope, n_files from (select *, count(*) over (partition by repo) as n from roll where regexp_matches(dir, '{_SCOPE_RE}')) where n >= 2)"

QUERIES = {
    "d3_directory_rollup": (d3_directory_rollup, f"with {_ROLL_SQL} select * from roll"),
    "d4_root_totals": (d4_root_totals, f"with {_SUM_SQL} select repo, count(*) as n_files, cast(sum(n_symbols) as bigint) as n_symbols, count(*) filter (n_symbols > 0) as n_with_symbols from fs group by 1"),
    "d4_folder_totals": (d4_folder_totals, f"with {_ROLL_SQL} select roll.repo, roll.dir, n_files, coalesce(x.n, 0) as direct_files from roll left join (select repo, regexp_replace(file_path, '/?[^/]*$', '') as dir, count(*) as n from fs group by 1, 2) x using (repo, dir)"),
    "d26_monorepo_scopes": (d26_monorepo_scopes, f"with {_ROLL_SQL}, {_SCOPE_SQL} select * from sc"),
    "l17_root_views": (l17_root_views, f"with {_ROLL_SQL}, {_SCOPE_SQL} select t.repo, n_files, case when n_scopes is not null then 'scopes' else 'root' end as view, coalesce(n_scopes, 0) as n_scopes from (select repo, count(*) as n_files from fs group by 1) t left join (select repo, count(*) as n_scopes from sc group by 1) using (repo)"),
    "f7_capped_directories": (f7_capped_directories, f"with {_ROLL_SQL} select repo, dir, rank from (select *, cast(row_number() over (partition by repo order by n_files desc, dir) as int) as rank from roll) where rank <= 60"),
    "f7_listed_paths": (f7_listed_paths, "select repo, file_path, rank from (select repo, file_path, cast(row_number() over (partition by repo order by file_path) as int) as rank from source_files) where rank <= 200"),
    "f9_tree_anchors": (f9_tree_anchors, f"with {_ROLL_SQL}, kids as (select repo, regexp_replace(dir, '/?[^/]*$', '') as dir, count(*) as n_children from roll group by 1, 2) select repo, dir, rank from (select roll.repo, roll.dir, cast(row_number() over (partition by roll.repo order by n_files desc, roll.dir) as int) as rank from roll left join kids using (repo, dir) where n_children is null or n_children <> 1) where rank <= 12"),
}
