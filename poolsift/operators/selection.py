"""Selection strategies: which unlabelled rows are worth a label."""

import math

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from poolsift.functions.columns import (
    LOG_EPS,
    array_total,
    bind,
    entropy,
    normalize_probs,
    normalized_entropy,
    predicted_class,
    present,
    rounded,
)
from poolsift.functions.ranking import hash_int, seeded_hash, top_n
from poolsift.operators.pool import page, unlabelled_rows, usable
from poolsift.session import pin

#: Ids of a batch that travel in the plan; a batch is a few thousand rows to be labelled by hand.
ID_LIST = 10_000
#: Rows of the coreset for each cluster of diversity sampling.
PER_CENTRE = 40
#: Roots below which a centre hangs in the tree of centres.
OVERLAP = 4
#: Rounds in which its first centres are found.
SEED_ROUNDS = 4


def with_rank(pool: DataFrame, ranked: DataFrame, n: int) -> DataFrame:
    """Whole pool rows of a narrow ranked selection of at most ``n`` rows.

    The selection is written once. Up to ``ID_LIST`` ids become a filter, which reaches the texts
    below the joins that a pool may consist of: then no text is shuffled. More ids are joined.
    """
    ranked = pin(ranked, "selection")
    if n > ID_LIST:
        return pool.join(ranked, "id")
    ids = [r["id"] for r in ranked.select("id").collect()]
    return pool.filter(F.col("id").isin(ids)).join(F.broadcast(ranked), "id")


def uncertainty_ids(pool: DataFrame, n: int) -> DataFrame:
    """``id, rank`` of the unlabelled scored rows with the highest score, ties by id."""
    scored = unlabelled_rows(pool).filter(F.col("uncertainty_score").isNotNull() & ~F.isnan("uncertainty_score"))
    narrow = scored.select("id", rounded(F.col("uncertainty_score")).alias("_score"))
    return top_n(narrow, n, [F.desc("_score"), F.asc("id")]).drop("_score")


def uncertainty_sampling(pool: DataFrame, n: int) -> DataFrame:
    return with_rank(pool, uncertainty_ids(pool, n), n)


# --- committee -----------------------------------------------------------------------


def committee_by_id(committee: DataFrame) -> DataFrame:
    """All members' outputs per id, ordered by member. One row per member at most."""
    outputs = F.array_sort(F.collect_list(F.struct("member", "probs")))
    return committee.groupBy("id").agg(outputs.alias("outputs"))


def committee_scores(committee: DataFrame) -> DataFrame:
    """Disagreement per id: mean KL of the members to their mean, entropy of the mean.

    Rows without a usable distribution do not count; ids with one member are left out.
    """
    valid = committee.withColumn("probs", normalize_probs("probs")).filter(F.col("probs").isNotNull())
    outputs = committee_by_id(valid).filter(F.size("outputs") >= 2)
    probs = outputs.select("id", F.transform("outputs", lambda o: o["probs"]).alias("_probs"))
    members = F.size("_probs").cast("double")
    first = F.col("_probs")[0]
    summed = F.aggregate(
        F.slice("_probs", 2, F.size("_probs")), first, lambda acc, p: F.zip_with(acc, p, lambda a, b: a + b)
    )

    def divergence(p, mean):
        terms = F.zip_with(
            p,
            mean,
            lambda a, m: F.when(a > 0, a * F.log(a / (m + F.lit(LOG_EPS)) + F.lit(LOG_EPS))).otherwise(0.0),
        )
        return array_total(terms)

    def measures(mean):
        total = array_total(F.transform("_probs", lambda p: divergence(p, mean)))
        return F.struct(
            rounded(total / members).alias("js"),
            rounded(entropy(mean)).alias("mean_entropy"),
            rounded(normalized_entropy(mean)).alias("normalized_entropy"),
        )

    mean = F.transform(summed, lambda x: x / members)
    return probs.select("id", bind(mean, measures).alias("_m")).select("id", "_m.*")


def _unlabelled_members(committee: DataFrame, pool: DataFrame) -> DataFrame:
    open_ids = unlabelled_rows(pool).filter(present("description")).select("id")
    return committee.join(open_ids, "id", "left_semi")


def committee_js(committee: DataFrame, pool: DataFrame, n: int) -> DataFrame:
    """The ``n`` unlabelled rows the members disagree on most; ties by entropy of the mean, then id."""
    scores = committee_scores(_unlabelled_members(committee, pool))
    order = [F.desc("js"), F.desc("mean_entropy"), F.asc("id")]
    return with_rank(pool, top_n(scores.select("id", "js", "mean_entropy"), n, order), n)


def vote_scores(committee: DataFrame) -> DataFrame:
    """``id, votes, vote_entropy``: distinct predicted classes and mean entropy of the members."""
    one = committee.select("id", predicted_class("probs").alias("_class"), entropy("probs").alias("_entropy"))
    return one.groupBy("id").agg(
        F.size(F.collect_set("_class")).cast("long").alias("votes"),
        rounded(F.coalesce(F.avg("_entropy"), F.lit(0.0))).alias("vote_entropy"),
    )


def committee_vote(committee: DataFrame, pool: DataFrame, n: int) -> DataFrame:
    """The ``n`` unlabelled rows with most distinct predictions; ties by mean entropy, then id."""
    scores = vote_scores(_unlabelled_members(committee, pool))
    order = [F.desc("votes"), F.desc("vote_entropy"), F.asc("id")]
    return with_rank(pool, top_n(scores, n, order), n)


# --- diversity -----------------------------------------------------------------------


def nearest_to_centroid(points: DataFrame, centres: DataFrame) -> DataFrame:
    """Per cluster the id closest to its centre, lowest id on ties.

    ``points``: ``id, cluster, embedding``; ``centres``: ``cluster, centre``. The minimum
    is an aggregate, so a huge cluster is combined before the shuffle.
    """
    squares = F.zip_with("embedding", "centre", lambda a, b: F.pow(a.cast("double") - b.cast("double"), F.lit(2.0)))
    far = F.sqrt(F.aggregate(squares, F.lit(0.0), lambda acc, x: acc + x))
    near = points.join(centres, "cluster").select("cluster", "id", rounded(far).alias("distance"))
    best = F.min(F.struct("distance", "id")).alias("_best")
    return near.groupBy("cluster").agg(best).select(
        "cluster", F.col("_best.id").alias("id"), F.col("_best.distance").alias("distance")
    )


def _squared(a, b) -> Column:
    squares = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    return F.aggregate(squares, F.lit(0.0), lambda acc, x: acc + x)


def _measured(vector, packed) -> Column:
    """``far, cluster`` of every centre; the smallest is the closest, the lowest number on ties."""

    def measured(c):
        return F.struct(rounded(_squared(vector, c["centre"])).alias("far"), c["cluster"].alias("cluster"))

    return F.transform(packed, measured)


def coreset(points: DataFrame, size: int, seed=42) -> DataFrame:
    """``id, embedding, weight``: a weighted sample that stands for all points in k-means.

    A row counts half for being there and half for its squared distance to the mean of all. The
    sample holds the ``size`` rows with the highest priority, importance by a uniform hash of the
    seed and the id; its weights make sums over it unbiased. Up to ``size`` rows are all kept, each with weight 1.
    """
    vectors = points.select("id", F.col("embedding").cast("array<double>").alias("embedding"))
    mean = vectors.agg(Summarizer.mean(array_to_vector("embedding")).alias("_m"))
    mean = mean.select(F.transform(vector_to_array("_m"), lambda x: rounded(x)).alias("_m")).scalar()
    apart = vectors.withColumn("_mean", mean).select("id", F.round(1e6 * _squared("embedding", F.col("_mean"))).cast("long").alias("_apart"))
    apart = pin(apart, "apart")
    n, total = apart.agg(F.count("*")).scalar(), apart.agg(F.sum("_apart")).scalar()
    chance = (0.5 / n) + F.when(total > 0, (0.5 * F.col("_apart")) / total).otherwise(0.5 / n)
    uniform = (hash_int(seeded_hash("id", seed)) + 0.5) / 4294967296.0
    scored = apart.select("id", chance.alias("_q")).select("id", "_q", (uniform / F.col("_q")).alias("_score"))
    ranked = pin(top_n(scored, size + 1, [F.asc("_score"), F.asc("id")], alias="_nth"), "priorities")
    cut = ranked.filter(F.col("_nth") == size + 1).select("_score").scalar()
    weight = F.greatest(F.lit(1.0), 1.0 / (cut * F.col("_q")))
    return vectors.join(ranked.filter(F.col("_nth") <= size).select("id", weight.alias("weight")), "id")


def assign(points: DataFrame, centres: DataFrame, k: int) -> DataFrame:
    """``points`` with ``cluster`` and ``far``, the squared distance, found through a tree of centres.

    The first 2 sqrt(k) centres are roots. Every centre hangs below the ``OVERLAP`` closest of them, so that it is found
    from their neighbourhoods too, and a point meets the roots and what hangs below its own: some
    4 sqrt(k) distances a row. The roots travel as one value, the centres are joined.
    """
    pack = F.array_sort(F.collect_list(F.struct("cluster", "centre")))
    roots = centres.filter(F.col("cluster") <= 2 * (math.isqrt(max(k - 1, 0)) + 1)).agg(pack).scalar()
    hung = F.slice(F.array_sort(_measured("centre", F.col("_roots"))), 1, OVERLAP)
    hung = centres.withColumn("_roots", roots).select("cluster", "centre", F.explode(hung["cluster"]).alias("_root"))
    below = hung.groupBy("_root").agg(pack.alias("_below"))
    root = F.array_min(_measured("embedding", F.col("_roots")))["cluster"].alias("_root")
    near = points.withColumn("_roots", roots).select(*points.columns, root).join(below, "_root")
    near = near.withColumn("_near", F.array_min(_measured("embedding", F.col("_below"))))
    return near.select(*points.columns, "_near.cluster", "_near.far")


def weighted_centres(sample: DataFrame, k: int, seed=42, passes: int = 5) -> DataFrame:
    """``cluster, centre`` of a fixed number of k-means passes over ``id, embedding, weight``.

    The first centres are sample rows: a quarter in seeded order, then in three rounds those with the highest
    priority, weight times squared distance to the centres so far by a uniform hash. A centre without
    rows stays where it is.
    """
    step = -(-k // SEED_ROUNDS)
    score = hash_int(seeded_hash("id", f"{seed}/0")).cast("double")
    scored, centres = sample.select("id", score.alias("_score")), None
    for had in range(0, k, step):
        if had:
            uniform = (hash_int(seeded_hash("id", f"{seed}/{had}")) + 0.5) / 4294967296.0
            far = F.when(F.col("far") > 0, uniform / (F.col("weight") * F.col("far")))
            scored = assign(sample, centres, had).select("id", far.alias("_score"))
        more = top_n(scored, min(step, k - had), [F.asc_nulls_last("_score"), F.asc("id")], alias="cluster")
        more = sample.join(more.select("id", (F.col("cluster") + had).alias("cluster")), "id").select("cluster", F.col("embedding").alias("centre"))
        centres = pin(centres.unionByName(more) if had else more, "centres")
    for _ in range(passes):
        mean = Summarizer.mean(F.col("_v"), F.col("weight")).alias("_m")
        moved = assign(sample, centres, k).withColumn("_v", array_to_vector("embedding")).groupBy("cluster").agg(mean)
        moved = moved.select("cluster", F.transform(vector_to_array("_m"), lambda x: rounded(x)).alias("_moved"))
        centre = F.coalesce("_moved", "centre").alias("centre")
        centres = pin(centres.join(moved, "cluster", "left").select("cluster", centre), "centres")
    return centres


def diversity_sampling(
    pool: DataFrame, embeddings: DataFrame, n: int, max_samples: int | None = None, seed=42, passes: int = 5
) -> DataFrame:
    """``n`` unlabelled rows, one per cluster of their embeddings; every row of a smaller pool.

    The clusters are learned on a coreset of ``PER_CENTRE`` rows for each of them; then all rows are assigned,
    and each cluster gives the row closest to its centre. Where clusters stay empty, rows of the coreset
    in seeded order fill up. Rows without an embedding do not count; vectors have one length.
    ``max_samples`` keeps the first rows by id, as an option of the caller.
    """
    candidates = page(usable(unlabelled_rows(pool)), max_samples)
    known = embeddings.filter("embedding is not null").select("id", F.col("embedding").cast("array<double>").alias("embedding"))
    points = pin(known.join(candidates.select("id"), "id", "left_semi"), "points")
    if points.limit(n + 1).count() <= n:
        return candidates.join(points.select("id"), "id", "left_semi")
    sample = pin(coreset(points, PER_CENTRE * n, seed), "coreset")
    near = assign(points, weighted_centres(sample, n, seed, passes), n)
    best = near.groupBy("cluster").agg(F.min(F.struct("far", "id")).alias("_best"))
    best = pin(best.select(F.col("_best.id").alias("id"), F.lit(0).alias("_late"), F.lit("").alias("_hash")), "closest")
    others = sample.join(best, "id", "left_anti").select("id", F.lit(1).alias("_late"), seeded_hash("id", f"{seed}/0").alias("_hash"))
    chosen = top_n(best.unionByName(others), n, [F.asc("_late"), F.asc("_hash"), F.asc("id")])
    return with_rank(candidates, chosen.select("id"), n)
