"""Reading and changing the labelling state of a pool.

A pool is ``id, description, is_labelled, label, model_prediction, uncertainty_score``.
Every change is a function from pool to pool.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from poolsift.functions.columns import label_code, label_name, present
from poolsift.functions.ranking import hash_cut, top_n, up_to_cut

POOL_COLUMNS = ["id", "description", "is_labelled", "label", "model_prediction", "uncertainty_score"]
# Fixed value: at most this share of the pool becomes the random seed set.
SEED_SHARE = 0.10


def page(df: DataFrame, limit: int | None = None, offset: int = 0, key: str = "id") -> DataFrame:
    """Rows in id order, ``offset`` skipped, at most ``limit``; all of them without both."""
    if limit is None and not offset:
        return df
    if limit is None:
        skipped = top_n(df.select(key), offset, [F.col(key)])
        return df.join(skipped, key, "left_anti")
    ids = top_n(df.select(key), offset + limit, [F.col(key)]).filter(F.col("rank") > offset)
    return df.join(ids.select(key), key, "left_semi")


def unlabelled_rows(pool: DataFrame) -> DataFrame:
    return pool.filter(~F.col("is_labelled"))


def usable(pool: DataFrame) -> DataFrame:
    """Rows with a text and a label."""
    return pool.filter(present("description") & present("label"))


def unlabelled_page(pool: DataFrame, limit: int | None = None, offset: int = 0) -> DataFrame:
    return page(unlabelled_rows(pool), limit, offset)


def unlabelled_with_labels(pool: DataFrame, limit: int | None = None, offset: int = 0) -> DataFrame:
    return page(usable(unlabelled_rows(pool)), limit, offset)


def labelled_rows(pool: DataFrame, limit: int | None = None) -> DataFrame:
    """Rows whose label has been revealed. A hidden label does not count."""
    return page(usable(pool.filter("is_labelled")), limit)


def test_page(test: DataFrame, limit: int | None = None, offset: int = 0) -> DataFrame:
    return page(test, limit, offset)


def unlabelled_count(pool: DataFrame) -> DataFrame:
    return usable(unlabelled_rows(pool)).agg(F.count("*").alias("unlabelled"))


def label_filter(df: DataFrame, labels, text_col: str = "description", label_col: str = "label") -> DataFrame:
    """Rows with a text and exactly one of the labels."""
    return df.filter(present(text_col) & F.col(label_col).isin(list(labels)))


def label_rejects(df: DataFrame, labels, text_col: str = "description", label_col: str = "label") -> DataFrame:
    """Rows dropped by :func:`label_filter` for an unknown label, per label and as a total."""
    known = present(text_col) & present(label_col)
    out = df.filter(known & ~F.col(label_col).isin(list(labels)))
    per_label = out.groupBy(F.col(label_col).alias("label")).agg(F.count("*").alias("dropped"))
    return per_label.withColumn("dropped_in_all", F.sum("dropped").over(Window.partitionBy()))  # one row per label


def label_encode(df: DataFrame, labels, label_col: str = "label", alias: str = "label_code") -> DataFrame:
    return df.withColumn(alias, label_code(label_col, labels))


def label_decode(df: DataFrame, labels, code_col: str = "predicted_class", alias: str = "predicted_label") -> DataFrame:
    return df.withColumn(alias, label_name(code_col, labels))


def fetch_selected(pool: DataFrame, selected: DataFrame) -> DataFrame:
    """Pool rows whose id was selected."""
    return pool.join(selected.select("id"), "id", "left_semi")


def remaining_pool(pool: DataFrame, moved: DataFrame) -> DataFrame:
    """Pool rows whose id was not moved away."""
    return pool.join(moved.select("id"), "id", "left_anti")


def save_predictions(pool: DataFrame, predictions: DataFrame) -> DataFrame:
    """Store ``model_prediction`` and ``uncertainty_score`` of the scored ids; others keep theirs.

    No id is repeated by it, however often it was scored.
    """
    # an id scored twice counts once: the highest score, then the last prediction by name
    best = F.max(F.struct(F.col("uncertainty_score").alias("s"), F.col("model_prediction").cast("string").alias("p")))
    new = predictions.groupBy("id").agg(best.alias("_new"))
    new = new.select("id", F.col("_new.p").alias("_prediction"), F.col("_new.s").alias("_score"), F.lit(True).alias("_scored"))
    scored = F.col("_scored").isNotNull()
    return (
        pool.join(new, "id", "left")
        .withColumn("model_prediction", F.when(scored, F.col("_prediction")).otherwise(F.col("model_prediction")))
        .withColumn("uncertainty_score", F.when(scored, F.col("_score")).otherwise(F.col("uncertainty_score")))
        .select(*pool.columns)
    )


def apply_labels(pool: DataFrame, labels: DataFrame) -> DataFrame:
    """Reveal ``id, label`` pairs. A pair without a label changes nothing; of several the last by name holds."""
    new = labels.filter(present("label")).groupBy("id").agg(F.max("label").alias("_label"))  # one row per id
    given = F.col("_label").isNotNull()
    return (
        pool.join(new, "id", "left")
        .withColumn("is_labelled", F.col("is_labelled") | given)
        .withColumn("label", F.coalesce("_label", "label"))
        .select(*pool.columns)
    )


def mark_labelled(pool: DataFrame, ids: DataFrame) -> DataFrame:
    """Set the flag of the ids and keep their label."""
    new = ids.select("id").distinct().withColumn("_marked", F.lit(True))
    return (
        pool.join(new, "id", "left")
        .withColumn("is_labelled", F.col("is_labelled") | F.col("_marked").isNotNull())
        .select(*pool.columns)
    )


def reset_pool(pool: DataFrame, clear_labels: bool = True, clear_predictions: bool = True) -> DataFrame:
    if clear_labels:
        pool = pool.withColumn("is_labelled", F.lit(False)).withColumn("label", F.lit(None).cast("string"))
    if clear_predictions:
        pool = pool.withColumn("model_prediction", F.lit(None).cast("string")).withColumn(
            "uncertainty_score", F.lit(None).cast("double")
        )
    return pool


def reset_counts(pool: DataFrame, clear_labels: bool = True, clear_predictions: bool = True) -> DataFrame:
    """Rows :func:`reset_pool` touches: those with a text, those holding a prediction or score."""
    with_text = F.count_if(F.col("description").isNotNull())
    predicted = F.count_if(F.col("model_prediction").isNotNull() | F.col("uncertainty_score").isNotNull())
    return pool.agg(
        (with_text if clear_labels else F.lit(0).cast("long")).alias("labels_cleared"),
        (predicted if clear_predictions else F.lit(0).cast("long")).alias("predictions_cleared"),
    )


def seed_quota(wanted: int):
    """min(wanted, available, max(1, 10 % of available))."""

    def quota(total):
        share = F.floor(total * F.lit(SEED_SHARE)).cast("long")
        return F.least(F.lit(wanted).cast("long"), total, F.greatest(F.lit(1).cast("long"), share))

    return quota


def init_labelled(pool: DataFrame, n: int = 100, seed=42) -> DataFrame:
    """Reveal a random seed set. The cut is a filter, so the texts are not shuffled."""
    eligible = ~F.col("is_labelled") & present("label")
    cut = hash_cut(pool.filter(eligible), "id", seed, seed_quota(n))
    marked = up_to_cut(pool, cut, "id", seed, keep="_seed")
    return marked.withColumn("is_labelled", F.col("is_labelled") | (eligible & F.col("_seed"))).select(*pool.columns)


def split_cut(pool: DataFrame, fraction: float = 0.2, test_size: int | None = None, seed=42) -> DataFrame:
    def quota(total):
        if test_size is not None:
            return F.lit(int(test_size)).cast("long")
        return F.floor(total * F.lit(float(fraction))).cast("long")

    return hash_cut(usable(pool), "id", seed, quota)


def split_test(pool: DataFrame, fraction: float = 0.2, test_size: int | None = None, seed=42):
    """``(test, remaining)``: a random share, or a fixed number, of the usable rows moves out."""
    cut = split_cut(pool, fraction, test_size, seed)
    marked = up_to_cut(pool, cut, "id", seed, keep="_moved")
    moved = present("description") & present("label") & F.col("_moved")
    test = marked.filter(moved).drop("_moved").withColumn("moved_at", F.current_timestamp())
    return test, marked.filter(~moved).drop("_moved")


def committee_upsert(outputs: DataFrame, sequence: str = "seq") -> DataFrame:
    """The latest output per (member, id). An aggregate, so repeated writes combine before the shuffle."""
    rest = [c for c in outputs.columns if c not in ("member", "id", sequence)]
    latest = F.max_by(F.struct(*rest), sequence)
    return outputs.groupBy("member", "id").agg(latest.alias("_row")).select("member", "id", "_row.*")
