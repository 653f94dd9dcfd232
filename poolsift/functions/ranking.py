"""Order-dependent work without a window over a whole table or a hot group.

One plan for all sizes: narrow rows are range-partitioned on their whole order and written, each
partition is worked through by a window of its own, and a table of one row per group and partition
carries what lies before it.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from poolsift.session import pin

# 4096 buckets of a hash prefix; only one of them per group is ever sorted.
HASH_PREFIX = 3
# Largest n that is taken with one sorted top-n per partition and a merge.
TOP_LIMIT = 50_000


def seeded_hash(id_col, seed) -> Column:
    """The random order of this library: md5 of ``seed:id``, then the id; null ids come last."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.coalesce(F.md5(F.concat(F.lit(f"{seed}:"), c.cast("string"))), F.lit("~"))


def hash_int(h: Column) -> Column:
    """First 8 hex digits of a hash as an integer."""
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("long")


# --- ordered rows ----------------------------------------------------------------------


class Ordered:
    """Rows in a written order: running folds and previous values, per group, null groups included.

    ``df`` should be narrow, as it is written once. ``order`` names columns that are unique
    together; a null in the first of them raises. Every method returns new rows in the same order.
    """

    def __init__(self, df: DataFrame, order, groups=(), placed: bool = False):
        self.order = [order] if isinstance(order, str) else list(order)
        self.groups = list(groups)
        if placed:
            self._rows = df
            return
        first = self.order[0]
        checked = F.coalesce(first, F.raise_error(F.lit(f"null in the order column {first}")).cast(df.schema[first].dataType))
        rows = df.withColumn(first, checked).repartitionByRange(*self.order)
        self._rows = pin(rows.withColumn("_part", F.spark_partition_id()), "ordered")

    @property
    def rows(self) -> DataFrame:
        return self._rows.drop("_part")

    def _next(self, df: DataFrame) -> "Ordered":
        return Ordered(df, self.order, self.groups, placed=True)

    def _carried(self, inside: DataFrame, carried: DataFrame, out) -> "Ordered":
        """Rows joined with what their group carried into their partition; null groups meet, too."""
        left, right = inside.alias("l"), carried.alias("r")
        same = F.col("l._part") == F.col("r._part")
        for g in self.groups:
            same = same & F.col(f"l.{g}").eqNullSafe(F.col(f"r.{g}"))
        return self._next(left.join(right, same, "left").select(*[F.col(f"l.{c}") for c in self._rows.columns], *out))

    def running(self, values: dict) -> "Ordered":
        """``values`` maps an output name to ``(column, "sum" | "max")``."""
        fold = {"sum": F.sum, "max": F.max}
        keys = [*self.groups, "_part"]
        named = self._rows.select("*", *[c.alias(f"_in_{a}") for a, (c, _) in values.items()])
        along = Window.partitionBy(*keys).orderBy(*self.order).rowsBetween(Window.unboundedPreceding, 0)
        inside = named.select("*", *[fold[how](f"_in_{a}").over(along).alias(f"_own_{a}") for a, (_, how) in values.items()])
        parts = named.groupBy(*keys).agg(*[fold[how](f"_in_{a}").alias(f"_sum_{a}") for a, (_, how) in values.items()])
        before = Window.partitionBy(*self.groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        parts = parts.select(*keys, *[fold[how](f"_sum_{a}").over(before).alias(f"_off_{a}") for a, (_, how) in values.items()])

        def both(a, how):
            own, off = F.col(f"_own_{a}"), F.col(f"_off_{a}")
            return F.coalesce(own + off, own, off) if how == "sum" else F.greatest(own, off)

        return self._carried(inside, parts, [both(a, how).alias(a) for a, (_, how) in values.items()])

    def positions(self, alias: str = "position") -> "Ordered":
        """``row_number``."""
        return self.running({alias: (F.lit(1).cast("long"), "sum")})

    def previous(self, columns: dict) -> "Ordered":
        """``lag`` by one row: ``columns`` maps an output name to the column of the row before."""
        keys = [*self.groups, "_part"]
        along = Window.partitionBy(*keys).orderBy(*self.order)
        inside = self._rows.select(
            "*", F.row_number().over(along).alias("_nth"), *[F.lag(c).over(along).alias(f"_own_{a}") for a, c in columns.items()]
        )
        place = F.struct(*self.order)
        parts = self._rows.groupBy(*keys).agg(*[F.max_by(F.col(c), place).alias(f"_last_{a}") for a, c in columns.items()])
        before = Window.partitionBy(*self.groups).orderBy("_part")
        parts = parts.select(*keys, *[F.lag(f"_last_{a}").over(before).alias(f"_off_{a}") for a in columns])
        first = F.col("_nth") == 1
        return self._carried(inside, parts, [F.when(first, F.col(f"_off_{a}")).otherwise(F.col(f"_own_{a}")).alias(a) for a in columns])


def running(df: DataFrame, order, values: dict, groups=()) -> DataFrame:
    """Running ``sum`` or ``max`` over a unique order, per group."""
    return Ordered(df, order, groups).running(values).rows


def positions(df: DataFrame, order, groups=(), alias: str = "position") -> DataFrame:
    """``row_number`` over a unique order, per group."""
    return Ordered(df, order, groups).positions(alias).rows


def with_previous(df: DataFrame, order, columns: dict, groups=()) -> DataFrame:
    """``lag`` by one row over a unique order, per group."""
    return Ordered(df, order, groups).previous(columns).rows


def hash_positions(df: DataFrame, id_col: str, seed, groups=(), alias: str = "position") -> DataFrame:
    """``row_number`` in seeded hash order, per group; narrow rows in, as for the others."""
    keyed = df.withColumn("_hash", seeded_hash(id_col, seed))
    return positions(keyed, ["_hash", id_col], groups, alias).drop("_hash")


# --- exact cuts in seeded hash order -------------------------------------------------


def eligible(df: DataFrame, id_col: str, seed, groups=()) -> DataFrame:
    """``groups``, ``_id`` and ``_hash`` of every row, written once: eligibility may look at texts."""
    narrow = df.select(*groups, F.col(id_col).alias("_id"), seeded_hash(id_col, seed).alias("_hash"))
    return pin(narrow, "eligible")


def hash_cut(df: DataFrame, id_col: str, seed, quota, groups=()) -> DataFrame:
    """Per group, the hash and id at which ``quota`` rows are reached; see ``cut_of``."""
    return cut_of(eligible(df, id_col, seed, groups), quota, groups)


def cut_of(narrow: DataFrame, quota, groups=()) -> DataFrame:
    """Per group of an ``eligible`` table, the hash and id at which ``quota`` rows are reached.

    ``quota`` is a function of the group's row count (a column), or a DataFrame of
    ``groups`` plus ``quota``. Taking rows up to the cut is then a plain filter: the
    wide rows are never shuffled, only (hash, id) of one bucket per group is sorted.
    Groups whose quota is 0 have no row.
    """
    groups = list(groups)
    keyed = narrow.withColumn("_bucket", F.substring("_hash", 1, HASH_PREFIX))
    counts = keyed.groupBy(*groups, "_bucket").agg(F.count("*").alias("_n"))
    by_bucket = Window.partitionBy(*groups).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
    table = counts.select(
        "*",
        F.sum("_n").over(by_bucket).alias("_through"),
        F.sum("_n").over(Window.partitionBy(*groups)).alias("_total"),
    )
    if isinstance(quota, DataFrame):
        table = table.join(F.broadcast(quota.select(*groups, F.col("quota").alias("_quota"))), groups)
    else:
        table = table.withColumn("_quota", quota(F.col("_total")))
    need = F.least("_quota", "_total")
    edge = table.filter((F.col("_through") - F.col("_n") < need) & (need <= F.col("_through"))).select(
        *groups, "_bucket", (need - F.col("_through") + F.col("_n")).alias("_need")
    )
    # one edge row per group; groups are label values, so the hint is bounded by the label space
    inside = Window.partitionBy(*groups, "_bucket").orderBy("_hash", "_id")
    return (
        keyed.join(F.broadcast(edge), [*groups, "_bucket"])
        .withColumn("_rn", F.row_number().over(inside))
        .filter(F.col("_rn") == F.col("_need"))
        .select(*groups, F.struct("_hash", "_id").alias("_cut"))
    )


def up_to_cut(df: DataFrame, cut: DataFrame, id_col: str, seed, groups=(), keep=None) -> DataFrame:
    """Rows at or before the cut. With ``keep``, mark them in that column instead."""
    mine = F.struct(seeded_hash(id_col, seed).alias("_hash"), F.col(id_col).alias("_id"))
    if groups:
        joined = df.join(F.broadcast(cut), list(groups), "left")
    else:
        joined = df.withColumn("_cut", cut.select("_cut").scalar())
    inside = F.coalesce(mine <= F.col("_cut"), F.lit(False))
    if keep:
        return joined.withColumn(keep, inside).drop("_cut").select(*df.columns, keep)
    return joined.filter(inside).select(*df.columns)


def fold_cuts(narrow: DataFrame, k: int, groups=()) -> DataFrame:
    """Per group of an ``eligible`` table, ``_cuts``: the last (hash, id) of each of k ranges but the final one.

    All cuts are found at once: bucket counts tell in which buckets they fall, and only those
    buckets are sorted. Range sizes differ by one at most, larger ones first; groups may be null.
    """
    groups = list(groups)
    keyed = narrow.withColumn("_bucket", F.substring("_hash", 1, HASH_PREFIX))
    counts = keyed.groupBy(*groups, "_bucket").agg(F.count("*").alias("_n"))
    by_bucket = Window.partitionBy(*groups).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
    table = counts.select(
        *groups,
        "_bucket",
        "_n",
        F.sum("_n").over(by_bucket).alias("_through"),
        F.sum("_n").over(Window.partitionBy(*groups)).alias("_total"),
    )

    def quota(j):
        return j * F.floor(F.col("_total") / k) + F.least(j, F.col("_total") % k)

    needs = F.transform(F.sequence(F.lit(1), F.lit(k - 1)) if k > 1 else F.array().cast("array<int>"), quota)
    before = F.col("_through") - F.col("_n")
    inside = F.transform(F.filter(needs, lambda q: (q > before) & (q <= F.col("_through"))), lambda q: q - before)
    edges = table.select(*[F.col(g).alias(f"_of_{g}") for g in groups], F.col("_bucket").alias("_in"), inside.alias("_needs"))
    edges = edges.filter(F.size("_needs") > 0)
    same = F.col("_bucket") == F.col("_in")
    for g in groups:
        same = same & F.col(g).eqNullSafe(F.col(f"_of_{g}"))
    # at most k - 1 buckets of each group are left; windows hold one bucket of one group
    along = Window.partitionBy(*groups, "_bucket").orderBy("_hash", "_id")
    placed = keyed.join(edges, same).withColumn("_rn", F.row_number().over(along).cast("long"))
    cuts = placed.filter(F.array_contains(F.transform("_needs", lambda q: q.cast("long")), F.col("_rn")))
    return cuts.groupBy(*groups).agg(F.array_sort(F.collect_list(F.struct("_hash", "_id"))).alias("_cuts"))


def first_by_hash(df: DataFrame, id_col: str, seed, quota) -> DataFrame:
    """The first ``quota`` rows in seeded hash order."""
    size = quota if callable(quota) else (lambda total: F.lit(int(quota)).cast("long"))
    return up_to_cut(df, hash_cut(df, id_col, seed, size), id_col, seed)


# --- top n ---------------------------------------------------------------------------


def top_n(df: DataFrame, n: int, order, alias: str = "rank", limit: int = TOP_LIMIT) -> DataFrame:
    """The first ``n`` rows by ``order`` (sort expressions, unique together) with their rank.

    Pass narrow rows. A batch-sized n is a top-n per partition and one merge of n rows.
    A larger n is range-partitioned on the full sort key, so equal scores still split
    by id, and ranked per partition. ``limit`` is the n up to which the merge is used.
    """
    if n <= limit:
        return df.orderBy(*order).limit(n).withColumn(
            alias, F.row_number().over(Window.orderBy(*order)).cast("long")
        )
    placed = pin(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ordered")
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order)).cast("long")
    ranked = placed.withColumn("_own", own).join(offsets, "_part").withColumn(alias, F.col("_own") + F.col("_off"))
    return ranked.filter(F.col(alias) <= n).drop("_part", "_own", "_off")
