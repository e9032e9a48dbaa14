"""Running sums and dense numbers against plain loops."""

import random
from collections import defaultdict

from pyspark.sql import functions as F

from claimloom.functions.ordering import dense_names, numbered, running


def test_running_sums_of_a_hot_key_equal_a_loop(spark):
    rng = random.Random(3)
    rows = [("hot", k, rng.randint(-5, 9)) for k in range(900)] + [(rng.choice("abc"), 2000 + k, rng.randint(0, 9)) for k in range(300)] + [(None, k, 1) for k in range(5)] + [("one", None, 7)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, at long, v long").repartition(5)
    got = {(r.k, r.at): (r.total, r.n) for r in running(df, ["k"], ["at"], {"total": F.col("v"), "n": F.lit(1).cast("long")}).collect()}
    sums, want = defaultdict(lambda: (0, 0)), {}
    for k, at, v in sorted(rows, key=lambda r: (str(r[0]), r[1] is not None, r[1] or 0)):
        sums[k] = (sums[k][0] + v, sums[k][1] + 1)
        want[k, at] = sums[k]
    assert got == want
    assert numbered(df.where("false"), ["k"], ["at"], "n").count() == 0


def test_dense_names_have_no_gaps(spark):
    df = spark.createDataFrame([(k % 7, str(k % 3)) for k in range(100)], "a long, b string").repartition(6)
    got = dense_names(df, ["a", "b"], "n").collect()
    assert sorted(r.n for r in got) == list(range(21)) and len({(r.a, r.b) for r in got}) == 21
