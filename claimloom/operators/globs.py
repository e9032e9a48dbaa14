"""Many globs against many paths: a join on what is literal in a glob, then the match.

``*`` and ``?`` stay within a segment, ``**`` crosses segments, ``**/`` may be no folder at all, a trailing ``/`` is a
whole subtree. A glob is looked up by its literal beginning or its literal ending, whole: whichever fewer paths have. A
path offers its beginnings and endings of the lengths that occur among the globs. Only globs without either (``*``,
``**``) meet every path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.functions.storage import stored
from claimloom.functions.unicode import nfc

#: Folders that a glob need not name.
ROOTS = ("sources", "runs/sources")


def whole(pattern: Column) -> Column:
    return F.when(F.endswith(pattern, F.lit("/")), F.concat(pattern, F.lit("**"))).otherwise(pattern)


def regex(pattern: Column) -> Column:
    """A glob as a regular expression for a whole path."""
    out = F.regexp_replace(whole(pattern), r"([\\.+^$(){}|\[\]&-])", r"\\$1")
    for k, mark in enumerate(("**/", "**", "*", "?")):
        out = F.replace(out, F.lit(mark), F.lit(chr(1 + k)))
    for k, meaning in enumerate(("(?:.*/)?", ".*", "[^/]*", "[^/]")):
        out = F.replace(out, F.lit(chr(1 + k)), F.lit(meaning))
    return F.concat(F.lit(r"(?s)\A(?:"), out, F.lit(r")\z"))


def _glob_keys(pattern: Column) -> Column:
    """The literal text before a glob's first wildcard (side 0) and after its last one (side 1); the empty key (side 2) where there is neither. ``**/`` is one wildcard."""
    marked = F.replace(pattern, F.lit("**/"), F.lit("\x01"))
    side = lambda k, key: F.struct(F.lit(k).alias("side"), key.alias("key"))
    found = F.filter(F.array(*[side(k, F.regexp_extract(marked, edge, 0)) for k, edge in enumerate((r"^[^*?\x01]*", r"[^*?\x01]*\z"))]), lambda x: x["key"] != "")
    return F.when(F.size(found) > 0, found).otherwise(F.array(side(2, F.lit(""))))


def matches(paths: DataFrame, globs: DataFrame, path_col: str = "path", pattern_col: str = "pattern") -> DataFrame:
    """Distinct (path, pattern) where a glob matches a path, or what it is below its root."""
    known = paths.select(path_col).distinct().select(nfc(F.col(path_col)).alias("path")).where("path IS NOT NULL").distinct()
    inner = F.array_compact(F.array(F.col("path"), F.coalesce(*[F.when(F.startswith("path", F.lit(f"{r}/")), F.substring("path", len(r) + 2, 1 << 20)) for r in ROOTS])))
    tried = stored(known.select("path", F.explode(inner).alias("tried")), "glob-paths")
    asked = globs.select(nfc(F.col(pattern_col)).alias("pattern")).where("pattern IS NOT NULL").distinct()
    asked = stored(asked.select("pattern", regex(F.col("pattern")).alias("regex"), _glob_keys(whole(F.col("pattern"))).alias("keys")), "globs")

    sides = asked.select("pattern", "regex", F.explode("keys").alias("k")).select("pattern", "regex", "k.side", "k.key")
    lengths = F.broadcast(sides.select("side", F.length("key").alias("n")).distinct())  # no more than the longest glob's characters, twice
    offered = tried.select("path", "tried", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("side")).join(lengths, "side").where(F.length("tried") >= F.col("n"))
    offered = offered.select("path", "tried", "side", F.when(F.col("side") == 1, F.right("tried", F.col("n"))).otherwise(F.left("tried", F.col("n"))).alias("key"))
    met = offered.join(sides.select("side", "key").distinct(), ["side", "key"], "left_semi").groupBy("side", "key").agg(F.count("*").alias("n_paths"))
    # a key that no path has is met by nobody: its glob matches nothing
    rare = sides.join(met, ["side", "key"], "left").groupBy("pattern", "regex").agg(F.min(F.struct(F.coalesce("n_paths", F.lit(0)).alias("n_paths"), "side", "key")).alias("k")).where("k.n_paths > 0").select("pattern", "regex", "k.side", "k.key")
    return offered.join(rare, ["side", "key"]).where(F.rlike("tried", F.col("regex"))).select("path", "pattern").distinct()


def ignored(paths: DataFrame, globs: DataFrame, path_col: str = "path", pattern_col: str = "pattern") -> DataFrame:
    """The distinct paths that any glob matches."""
    return matches(paths, globs, path_col, pattern_col).select("path").distinct()
