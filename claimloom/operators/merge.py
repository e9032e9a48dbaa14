"""Rebuilding the claim table: decisions of the last table are kept, tombstones stay, copies are folded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.functions.ordering import dealt
from claimloom.functions.scalars import canonical_amount, normalize_confidence, source_file
from claimloom.functions.storage import names
from claimloom.functions.unicode import nfc
from claimloom.operators.facts import ENGINE, STATUS_RANK, TOMBSTONE, TRIPLE, clean, first_by, rank

KEY = [*TRIPLE, "file"]
#: By what claims are dealt out, sorted and joined: the hash first, since keys often begin alike.
BY = ["_key", *KEY]
#: Estimated bytes of what a task is dealt. Claims made of written columns are some twenty times their estimate as rows, and a merge sorts two of each.
SHARE = 4 << 20


def composed(claims: DataFrame) -> DataFrame:
    """``claims`` as they are kept: subject, relation, object and source in normal form C, amounts with their unit quoted."""
    parts = {c: nfc(F.col(c)) for c in ("subject", "relation", "source")}
    return claims.withColumns(parts | {"object": canonical_amount(nfc(F.col("object")))})


def keyed(claims: DataFrame) -> DataFrame:
    """``claims`` as they are kept, with their source file: rows that agree in ``KEY`` are one claim."""
    return composed(claims).withColumn("file", source_file(F.col("source")))


def placed(rows: DataFrame, like: DataFrame) -> DataFrame:
    """Keyed rows dealt out by ``BY`` in parts of the size of ``like``: what is grouped or joined by it from then on stays where it is. The hash is not shuffled."""
    key = F.xxhash64(*KEY)
    return dealt(rows, [key, *KEY], like, SHARE).withColumn("_key", key)


def per_file(claims: DataFrame) -> DataFrame:
    """(relation, file, n): how often each source file says each relation; normal form C is made a name, not a row."""
    names = claims.groupBy("relation", source_file(F.col("source")).alias("file")).agg(F.count("*").alias("n"))
    return names.groupBy(nfc(F.col("relation")).alias("relation"), nfc(F.col("file")).alias("file")).agg(F.sum("n").alias("n"))


def normalized(runs: DataFrame, known: DataFrame, like: DataFrame | None = None) -> DataFrame:
    """Clean rows of run files whose source file is in ``known`` (file), one a key: the one with the least source; ``placed`` as ``like``, if given."""
    rows = clean(runs)
    rows = rows.where((F.col("subject") != "") & (F.col("relation") != "") & (F.col("object") != "") & (F.col("source") != ""))
    status = F.when(F.col("status").isin(*STATUS_RANK), F.col("status")).otherwise("needs_review")
    rows = keyed(rows.withColumn("status", status).withColumn("confidence", normalize_confidence(F.col("confidence"))))
    rows = rows.join(names(known.select(nfc(F.col("file")).alias("file")), "known"), "file", "left_semi")
    return first_by(rows if like is None else placed(rows, like), KEY, ["source", "status", "confidence", "note"])


def _paired(runs: DataFrame, last: DataFrame, known: DataFrame) -> DataFrame:
    """A row a key of the runs (``new``; ``run``: is it there) or of the last table: its status there (``old``), its tombstone (``gone``; ``dead``: has it one), whether it has rows that are none (``live``).

    Both are dealt out once by their key, of which the join needs nothing more; ``last`` with ``file`` is keyed already, with ``_key`` placed.
    """
    new = normalized(runs, known, like=runs)
    rest = ["source", *[c for c in new.columns if c not in (*BY, "source")]]
    last = last if "file" in last.columns else keyed(last)
    last = last if "_key" in last.columns else placed(last, runs)
    old = last.groupBy(*BY).agg(
        F.min(F.struct("source", "status")).alias("first"), F.min(F.when(F.col("status") == TOMBSTONE, F.struct(*rest))).alias("gone"),
        F.bool_or(F.col("status") == TOMBSTONE).alias("dead"), F.bool_or(F.col("status") != TOMBSTONE).alias("live"))
    return new.select(*BY, F.struct(*rest).alias("new"), F.lit(True).alias("run")).join(old.select(*BY, F.col("first.status").alias("old"), "gone", "dead", "live"), BY, "full_outer")


def _rebuilt(pairs: DataFrame) -> DataFrame:
    mine = F.col("new.status")
    status = (
        F.when(F.col("old") == TOMBSTONE, TOMBSTONE)
        .when((mine != TOMBSTONE) & F.col("old").isin(*ENGINE), F.col("old"))
        .when(mine.isin(*ENGINE) & (F.col("old") == "needs_review"), "needs_review")
        .otherwise(mine)
    )
    row = F.when(F.col("run").isNotNull(), F.col("new").withField("status", status)).otherwise(F.col("gone"))
    return pairs.where("run OR dead").select(*KEY, row.alias("row")).select(*KEY, "row.*")


def rebuild(runs: DataFrame, last: DataFrame, known: DataFrame, allow_loss: bool = True, with_file: bool = False) -> DataFrame:
    """The new table. Superseded keys of the last table stay so; its engine status is restored; what it held for review is held.

    Without ``allow_loss`` a rebuild that would lose a decided or reviewed claim, or all of them because the runs are
    empty, is refused (``ValueError``). Its claims are composed; ``with_file`` leaves them keyed as well.
    """
    pairs = _paired(runs, last, known)
    if not allow_loss:
        if runs.isEmpty() and not last.where(F.col("status") != TOMBSTONE).isEmpty():
            raise ValueError("no rows in the runs: a rebuild would lose every claim")
        if not (gone := _lost(pairs)).isEmpty():
            raise ValueError(f"a rebuild would lose {gone.count()} decided or reviewed claims")
    table = _rebuilt(pairs)
    return table if with_file else table.drop("file")


def _lost(pairs: DataFrame) -> DataFrame:
    return pairs.where("live AND NOT dead AND run IS NULL").select(*KEY)


def lost(runs: DataFrame, last: DataFrame, known: DataFrame) -> DataFrame:
    """What ``destroyed`` tells of the table that these would be rebuilt to, without making it."""
    return _lost(_paired(runs, last, known))


def destroyed(rebuilt: DataFrame, last: DataFrame) -> DataFrame:
    """Keys that were decided or under review and are absent from the rebuilt table (with ``file``: keyed already)."""
    rebuilt = rebuilt if "file" in rebuilt.columns else keyed(rebuilt)
    return keyed(last).where(F.col("status") != TOMBSTONE).select(*KEY).distinct().join(rebuilt, KEY, "left_anti")


def fold_spellings(claims: DataFrame) -> DataFrame:
    """One row a claim whose rows differ in Unicode form, amount quoting or anchor: (KEY, n_rows, status, confidence, source, disagree, discarded).

    The row with the best status stays, of equal ones that with the least source, with its own confidence. ``discarded``
    lists what the others had as status, confidence and number of rows. ``disagree`` tells statuses or confidences that
    differ. Claims with one row are not listed.
    """
    alike = keyed(clean(claims)).groupBy(*KEY, "status", "confidence").agg(F.count("*").alias("n"), F.min("source").alias("source"))
    own = F.struct(rank(F.col("status")).alias("rank"), "source", "confidence", "status")
    groups = alike.groupBy(*KEY).agg(F.sum("n").alias("n_rows"), F.min(own).alias("own"), F.array_sort(F.collect_list(F.struct("status", "confidence", "n"))).alias("all"))
    kept = lambda x: ((x["status"] == F.col("own.status")) & (x["confidence"] == F.col("own.confidence"))).cast("int")
    rest = F.filter(F.transform("all", lambda x: F.struct(x["status"].alias("status"), x["confidence"].alias("confidence"), (x["n"] - kept(x)).alias("n"))), lambda x: x["n"] > 0)
    shown = F.array_join(F.transform(rest, lambda x: F.concat_ws(" ", x["status"], x["confidence"], x["n"].cast("string"))), ",")
    return groups.where("n_rows > 1").select(*KEY, "n_rows", "own.status", "own.confidence", "own.source", (F.size("all") > 1).alias("disagree"), shown.alias("discarded"))


def reconciliation(table: DataFrame, runs: DataFrame) -> DataFrame:
    """How the table's status of each key stands to the runs': (key, table_status, run_status, class).

    A key of the table is ``ambiguous-table`` where its rows do not say one thing: several decisions, decided and
    pending rows together, or differing pending ones; ``status-unrecognised`` where one is no known status. Statuses of
    several rows are joined by commas. Both sides are dealt out once, together; with ``file`` they are keyed already.
    """
    decided_by = lambda c: c.isin(*ENGINE, TOMBSTONE)

    def side(df: DataFrame, of_table: bool) -> DataFrame:
        return (df if "file" in df.columns else keyed(df)).select(*KEY, "status", F.lit(of_table).alias("of_table"))

    def told(name: str, own: Column) -> list[Column]:
        status = F.when(own, F.col("status"))
        return [F.bool_or(own).alias(f"in_{name}"), F.collect_set(status).alias(f"{name}_set"), F.coalesce(F.bool_or(~status.isin(*STATUS_RANK)), F.lit(False)).alias(f"{name}_odd")]

    rows = placed(side(table, True).unionByName(side(runs, False)), table)
    groups = rows.groupBy(*BY).agg(*told("table", F.col("of_table")), *told("run", ~F.col("of_table")))
    both = groups.select(*KEY, *[c for n in ("table", "run") for c in (
        F.when(F.col(f"in_{n}"), F.array_join(F.array_sort(f"{n}_set"), ",")).alias(f"{n}_status"), (F.size(f"{n}_set") > 1).alias(f"{n}_many"), F.col(f"{n}_odd"))])
    mine, theirs = F.col("table_status"), F.col("run_status")
    kind = (
        F.when(mine.isNull(), "run-only").when(F.col("table_odd"), "status-unrecognised").when(F.col("table_many"), "ambiguous-table")
        .when(theirs.isNull(), "table-only").when(F.col("run_many") | F.col("run_odd"), "runs-disagree")
        .when(mine == theirs, "same")
        .when(decided_by(mine) & ~decided_by(theirs), "repair")
        .when((mine == TOMBSTONE) & theirs.isin(*ENGINE), "repair")
        .when(decided_by(mine) & decided_by(theirs), "both-decided")
        .when(decided_by(theirs), "table-pending-run-decided").otherwise("both-pending")
    )
    return both.select(*KEY, "table_status", "run_status", kind.alias("class"))
