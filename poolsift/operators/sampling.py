"""Sampling, splitting, balancing and folds.

Random means first in seeded hash order, so a result depends on the seed and the
ids only, never on how the data is partitioned.
"""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from poolsift.functions.columns import not_blank, present, stripped
from poolsift.functions.ranking import (
    Ordered,
    cut_of,
    eligible,
    first_by_hash,
    fold_cuts,
    hash_cut,
    hash_int,
    positions,
    seeded_hash,
    up_to_cut,
)
from poolsift.operators.pool import unlabelled_rows
from poolsift.session import pin

# Fixed value: this many of the smallest classes may be taken whole.
MINORITY_CLASSES = 4


def label_table(spark: SparkSession, labels, alias: str = "label") -> DataFrame:
    """The label space as rows ``label, code``; bounded by the list it is made of."""
    listed = F.posexplode(F.array(*[F.lit(x) for x in labels])).alias("code", alias)
    return spark.range(1).select(listed).select(alias, "code")


def random_sampling(pool: DataFrame, n: int, seed=42) -> DataFrame:
    """``n`` random rows among all unlabelled ones with a text; all if there are fewer."""
    return first_by_hash(unlabelled_rows(pool).filter(present("description")), "id", seed, n)


def fallback_random(selected: DataFrame, pool: DataFrame, n: int, seed=42) -> DataFrame:
    """The selection, or ``n`` random unlabelled rows if it is empty."""
    if not selected.isEmpty():
        return selected
    usable = unlabelled_rows(pool).filter(present("description") & present("label"))
    return first_by_hash(usable, "id", seed, n)


def sample_n(df: DataFrame, n: int, seed=42, key: str = "id") -> DataFrame:
    return first_by_hash(df, key, seed, n)


def train_test_split(df: DataFrame, test_size: float = 0.2, seed=42, key: str = "id") -> DataFrame:
    """Marks every row ``train`` or ``test`` in a column ``part``; the test part is rounded up."""
    cut = hash_cut(df, key, seed, lambda total: F.ceil(total * F.lit(float(test_size))).cast("long"))
    marked = up_to_cut(df, cut, key, seed, keep="_test")
    return marked.withColumn("part", F.when(F.col("_test"), "test").otherwise("train")).drop("_test")


def class_counts(df: DataFrame, label_col: str = "label") -> DataFrame:
    return df.groupBy(F.col(label_col).alias("label")).agg(F.count("*").alias("rows"))


# --- balancing -----------------------------------------------------------------------


def balancing_rows(df: DataFrame, labels, label_col: str = "label", text_col: str = "description") -> DataFrame:
    """Rows whose stripped label is allowed and whose text is not blank; the label is stored stripped."""
    return df.withColumn(label_col, stripped(label_col)).filter(
        F.col(label_col).isin(list(labels)) & not_blank(text_col)
    )


def _checked_counts(rows: DataFrame, labels, label_col: str) -> DataFrame:
    """``label, code, n`` over the label space; an empty class fails the job."""
    counts = rows.groupBy(F.col(label_col).alias("label")).agg(F.count("*").alias("_n"))
    whole = label_table(rows.sparkSession, labels).join(F.broadcast(counts), "label", "left")
    empty = F.raise_error(F.concat(F.lit("no rows for label "), F.col("label"))).cast("long")
    return whole.select("label", "code", F.when(F.col("_n") > 0, F.col("_n")).otherwise(empty).alias("n"))


def _undersample(rows: DataFrame, narrow: DataFrame, quotas: DataFrame, seed, key: str, label_col: str) -> DataFrame:
    """Texts are read twice in all: once for the ``eligible`` table ``narrow``, once for the result."""
    named = quotas.select(F.col("label").alias(label_col), "quota")
    cut = cut_of(narrow, named, [label_col])
    return up_to_cut(rows, cut, key, seed, [label_col])


def balance_min_class(
    df: DataFrame, labels, seed=42, key: str = "id", label_col: str = "label", text_col: str = "description"
) -> DataFrame:
    """Every class cut down at random to the size of the smallest."""
    rows = balancing_rows(df, labels, label_col, text_col)
    narrow = eligible(rows, key, seed, [label_col])
    counts = _checked_counts(narrow, labels, label_col)
    smallest = counts.agg(F.min("n")).scalar()
    return _undersample(rows, narrow, counts.select("label", smallest.alias("quota")), seed, key, label_col)


def balance_fixed(
    df: DataFrame, labels, target: int, seed=42, key: str = "id", label_col: str = "label", text_col: str = "description"
) -> DataFrame:
    """Exactly ``target`` rows per class; a short class is drawn from with replacement.

    Column ``draw`` numbers the draws of a short class and is null elsewhere. A draw is
    a hash of (label, number), hence the same under any partitioning; draws and rows
    meet by an equi-join on (label, rank).
    """
    if target <= 0:
        raise ValueError("target must be positive")
    rows = balancing_rows(df, labels, label_col, text_col)
    narrow = eligible(rows, key, seed, [label_col])
    counts = _checked_counts(narrow, labels, label_col)
    enough = counts.filter(F.col("n") >= target).select("label", F.lit(target).cast("long").alias("quota"))
    under = _undersample(rows, narrow, enough, seed, key, label_col).withColumn("draw", F.lit(None).cast("long"))

    short = counts.filter(F.col("n") < target).select(F.col("label").alias(label_col), "n")
    few = F.broadcast(short.select(label_col))  # at most the label space
    short_rows = rows.join(few, label_col, "left_semi")
    ranked = positions(narrow.join(few, label_col, "left_semi"), ["_hash", "_id"], [label_col], "_rank")
    numbers = rows.sparkSession.range(1, target + 1).withColumnRenamed("id", "draw")
    per_label = numbers.select("draw", F.explode(F.array(*[F.lit(x) for x in labels])).alias(label_col))
    point = seeded_hash(F.concat_ws(":", F.col(label_col), F.col("draw").cast("string")), seed)
    draws = per_label.join(F.broadcast(short), label_col).select(
        label_col, "draw", (hash_int(point) % F.col("n") + 1).alias("_rank")
    )
    drawn = draws.join(ranked, [label_col, "_rank"]).select(F.col("_id").alias(key), "draw")
    over = short_rows.join(drawn, key).select(*under.columns)
    return under.unionByName(over)


def intelligent_quotas(counts: DataFrame, target_total: int) -> DataFrame:
    """``label, quota`` from ``label, code, n``.

    In ascending order of size, up to four classes are taken whole while the running
    total stays below the target; the rest of the target is shared evenly, the first
    classes getting one more. Windows here run over one row per class.
    """
    order = Window.orderBy("n", "code")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    ordered = counts.select("*", F.row_number().over(order).alias("_pos"), F.sum("n").over(upto).alias("_sum"))
    whole = ordered.withColumn("_whole", (F.col("_pos") <= MINORITY_CLASSES) & (F.col("_sum") < target_total))
    everyone = Window.partitionBy()
    shared = whole.select(
        "*",
        F.sum(F.when(F.col("_whole"), F.col("n")).otherwise(0)).over(everyone).alias("_taken"),
        F.sum(F.when(F.col("_whole"), 0).otherwise(1)).over(everyone).alias("_others"),
        F.sum(F.when(F.col("_whole"), 0).otherwise(1)).over(upto).alias("_place"),
    )
    left = F.lit(target_total).cast("long") - F.col("_taken")
    share = F.floor(left / F.col("_others")) + F.when(F.col("_place") <= left % F.col("_others"), 1).otherwise(0)
    quota = F.when(F.col("_whole"), F.col("n")).otherwise(F.least("n", share.cast("long")))
    return shared.select("label", quota.cast("long").alias("quota"))


def balance_intelligent(
    df: DataFrame,
    labels,
    target_total: int,
    seed=42,
    key: str = "id",
    label_col: str = "label",
    text_col: str = "description",
) -> DataFrame:
    """Small classes whole, the rest of the target spread over the large ones."""
    if target_total <= 0:
        raise ValueError("target_total must be positive")
    rows = balancing_rows(df, labels, label_col, text_col)
    narrow = eligible(rows, key, seed, [label_col])
    quotas = intelligent_quotas(_checked_counts(narrow, labels, label_col), target_total)
    return _undersample(rows, narrow, quotas, seed, key, label_col)


def balanced_usable(
    df: DataFrame, labels, min_rows: int = 2000, label_col: str = "label", text_col: str = "description"
) -> DataFrame:
    """Whether a balanced file can be used again: enough valid rows, no class empty."""
    counts = class_counts(balancing_rows(df, labels, label_col, text_col), label_col)
    total = F.coalesce(F.sum("rows"), F.lit(0)).cast("long")
    return counts.agg(total.alias("valid_rows"), F.count("*").alias("classes")).select(
        "valid_rows",
        "classes",
        ((F.col("valid_rows") >= min_rows) & (F.col("classes") == len(set(labels)))).alias("usable"),
    )


def stratified_subsample(ranked: DataFrame, n: int, seed=42, rank: str = "rank", label_col: str = "label") -> DataFrame:
    """About equally many rows per class from a ranked candidate list, best ranks first.

    Quota n/k per class, one more for the first n mod k classes in hash order of the
    label. Open places go to the leftovers, class after class in first-seen order. All
    rows are returned when there are at most ``n``. Class sizes come from one row per
    class; ranks inside a class do not need the class in one task.
    """
    ordered = Ordered(ranked, rank, [label_col])
    placed = ordered.positions("_in_class").rows
    sizes = ordered.rows.groupBy(label_col).agg(F.count("*").alias("_n"), F.min(rank).alias("_seen"))
    name = F.coalesce(F.col(label_col).cast("string"), F.lit(""))
    drawn = Window.orderBy(seeded_hash(name, seed), name)
    everyone = Window.partitionBy()
    quota = sizes.select(
        "*",
        F.row_number().over(drawn).alias("_drawn"),
        F.count("*").over(everyone).alias("_k"),
        F.sum("_n").over(everyone).alias("_total"),
    ).withColumn(
        "_quota",
        F.least(
            F.col("_n"),
            F.floor(F.lit(n) / F.col("_k")) + F.when(F.col("_drawn") <= F.lit(n) % F.col("_k"), 1).otherwise(0),
        ),
    )
    seen = Window.orderBy("_seen").rowsBetween(Window.unboundedPreceding, -1)
    table = quota.select(
        F.col(label_col).alias("_label"),
        "_total",
        "_quota",
        F.coalesce(F.sum(F.col("_n") - F.col("_quota")).over(seen), F.lit(0)).alias("_skip"),
        (F.lit(n) - F.sum("_quota").over(everyone)).alias("_open"),
    )
    joined = placed.join(table, F.col(label_col).eqNullSafe(F.col("_label")))
    place = F.col("_skip") + F.col("_in_class") - F.col("_quota")
    picked = (F.col("_in_class") <= F.col("_quota")) | (place <= F.col("_open"))
    return joined.filter((F.col("_total") <= n) | picked).select(*ranked.columns)


# --- folds ---------------------------------------------------------------------------


def kfold(df: DataFrame, k: int = 5, seed=42, key: str = "id") -> DataFrame:
    """Adds ``fold`` 0..k-1: consecutive ranges of the seeded hash order, sizes at most one apart."""
    return _fold(df, k, seed, key, [])


def stratified_kfold(df: DataFrame, k: int = 5, seed=42, key: str = "id", label_col: str = "label") -> DataFrame:
    """Adds ``fold`` 0..k-1, sizes at most one apart within every label."""
    return _fold(df, k, seed, key, [label_col])


def _fold(df, k, seed, key, groups):
    """A fold is the number of cuts before a row: a comparison, so that no wide row is shuffled.

    Rows of equal keys share a fold. Rows without a key have no place in the order; they go to the
    first fold. The written cuts, k - 1 for each label, are broadcast if their size allows it.
    """
    if k < 1:
        raise ValueError("k must be positive")
    narrow = eligible(df.filter(F.col(key).isNotNull()), key, seed, groups)
    cuts = fold_cuts(narrow, k, groups)
    if groups:
        named = pin(cuts.select(*[F.col(g).alias(f"_of_{g}") for g in groups], "_cuts"), "cuts")
        same = F.lit(True)
        for g in groups:
            same = same & F.col(g).eqNullSafe(F.col(f"_of_{g}"))
        joined = df.join(named, same, "left")
    else:
        joined = df.withColumn("_cuts", cuts.select("_cuts").scalar())
    mine = F.struct(seeded_hash(key, seed).alias("_hash"), F.col(key).alias("_id"))
    passed = F.aggregate("_cuts", F.lit(0), lambda n, c: n + F.when(c < mine, 1).otherwise(0))
    fold = F.when(F.col(key).isNull(), 0).otherwise(F.coalesce(passed, F.lit(0)))
    return joined.select(*df.columns, fold.cast("int").alias("fold"))
