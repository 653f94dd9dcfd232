"""Every order-dependent helper against the plain window or Python."""

import hashlib
import math

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from poolsift.functions import ranking as R
from poolsift.operators import stopping


def md5(seed, i):
    return hashlib.md5(f"{seed}:{i}".encode()).hexdigest()


@pytest.fixture(scope="module")
def skewed(spark):
    """Ids with gaps; one group holds most of the rows and one group is null."""
    df = spark.range(5000).select(
        (F.col("id") * F.col("id") + 3).alias("id"),
        F.when(F.col("id") % 10 < 7, "hot").when(F.col("id") % 10 == 9, F.lit(None)).otherwise("cold").alias("g"),
        (F.col("id") * 37 % 101).alias("v"),
    )
    return df.repartition(7).cache()


def pairs(df, *cols):
    return sorted(map(tuple, df.select(*cols).collect()), key=str)


@pytest.mark.parametrize("groups", [[], ["g"]])
def test_positions_equal_row_number(skewed, groups):
    plain = skewed.withColumn("p", F.row_number().over(Window.partitionBy(*groups).orderBy("id")).cast("long"))
    mine = R.positions(skewed, "id", groups, "p")
    assert pairs(mine, "id", "p") == pairs(plain, "id", "p")


def test_running_sum_and_max(skewed):
    rare = F.when(F.col("v") % 17 == 0, F.col("v"))
    upto = Window.partitionBy("g").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    plain = skewed.withColumn("s", F.sum("v").over(upto)).withColumn("m", F.max(rare).over(upto))
    mine = R.running(skewed, "id", {"s": (F.col("v"), "sum"), "m": (rare, "max")}, ["g"])
    assert pairs(mine, "id", "s", "m") == pairs(plain, "id", "s", "m")


def test_with_previous_equals_lag(skewed):
    plain = skewed.withColumn("b", F.lag("v").over(Window.partitionBy("g").orderBy("id")))
    mine = R.with_previous(skewed, "id", {"b": "v"}, ["g"])
    assert pairs(mine, "id", "b") == pairs(plain, "id", "b")


@pytest.mark.parametrize("groups", [[], ["g"]])
def test_hash_positions(skewed, groups):
    order = Window.partitionBy(*groups).orderBy(R.seeded_hash("id", 5), "id")
    plain = skewed.withColumn("p", F.row_number().over(order).cast("long"))
    assert pairs(R.hash_positions(skewed, "id", 5, groups, "p"), "id", "p") == pairs(plain, "id", "p")


@pytest.mark.parametrize("n", [0, 1, 7, 4999, 5000, 9000])
def test_first_by_hash_is_exact(skewed, n):
    ids = sorted((r.id for r in skewed.collect()), key=lambda i: (md5(3, i), i))
    assert {r.id for r in R.first_by_hash(skewed, "id", 3, n).collect()} == set(ids[:n])


def test_null_order_raises(spark):
    rows = spark.createDataFrame([(1, "a"), (None, "b")], "id long, g string")
    with pytest.raises(Exception, match="null in the order column id"):
        R.positions(rows, "id").collect()


def test_steps_follow_one_another_in_one_huge_group(spark):
    rows = spark.range(20_000).select("id", F.lit(None).cast("string").alias("g"), (F.col("id") % 7).alias("v")).repartition(9)
    steps = R.Ordered(rows, "id", ["g"]).previous({"b": "v"}).positions("p").running({"s": (F.col("b"), "sum")}).rows
    total = 0
    for r in sorted(steps.collect(), key=lambda r: r.id):
        before = (r.id - 1) % 7 if r.id else None
        total += before or 0
        assert (r.b, r.p, r.s) == (before, r.id + 1, total if r.id else None)


def test_no_window_over_table_rows_in_one_task(spark):
    plan = R.positions(spark.range(100), "id")._jdf.queryExecution().executedPlan().toString()
    for line in plan.split("SinglePartition")[1:]:
        assert "_part" in line


def test_hash_choice_ignores_partitioning(skewed):
    one = pairs(R.first_by_hash(skewed.coalesce(1), "id", 1, 50), "id")
    assert one == pairs(R.first_by_hash(skewed.repartition(7), "id", 1, 50), "id")


@pytest.mark.parametrize("limit", [0, 10**6])
def test_top_n_with_hot_ties(skewed, limit):
    tied = skewed.withColumn("v", F.when(F.col("v") < 90, 50).otherwise(F.col("v")))
    order = [F.desc("v"), F.asc("id")]
    want = tied.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long")).filter("rank <= 3000")
    assert pairs(R.top_n(tied, 3000, order, limit=limit), "id", "rank") == pairs(want, "id", "rank")


def test_plateau_streaks_match_a_plain_loop(spark):
    rows = [(i, 1 + i // 40, None if i % 11 == 5 else math.sin(i * i) / 3 + 0.5) for i in range(400)]
    log = spark.createDataFrame(rows, "id long, run long, selected_samples_avg_uncertainty double").repartition(5)
    got = {r.id: (r.streak, r.plateau) for r in stopping.stop_plateau(log, eps=0.1, patience=2).collect()}
    before, streak, run = None, 0, None
    for i, this, value in rows:
        if this != run:
            before, streak, run = None, 0, this
        if value is None:
            assert got[i] == (None, False)
            continue
        streak = streak + 1 if before is not None and before - value < 0.1 else 0
        before = value
        assert got[i] == (streak, streak >= 2)
