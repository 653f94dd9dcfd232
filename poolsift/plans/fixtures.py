"""The driver tables in the shapes the operators expect.

``documents`` stand in for postings and the pool (label = language, revealed where
``labels`` knows the document), ``embeddings`` for a committee of three members, and
``orders`` for a results log: a customer is a run, a year an iteration, the market
segment of the customer the method. All rows of the tables take part.
"""

from functools import cached_property, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from poolsift.functions.columns import confidence, label_name, predicted_class, rounded, softmax, uncertainty

LABELS = ["de", "en", "es", "fr"]
MEMBERS = 3
SHARPNESS = 16.0
DIMENSIONS = 64

# Runs in both engines. Metrics are built from integers so that their text is the same.
RESULTS_SQL = """
with o as (
  select o_custkey run, year(o_orderdate) - 1994 it, count(*) n,
    sum(cast(round(o_totalprice * 100) as bigint)) cents,
    sum(case when o_orderstatus = 'F' then 1 else 0 end) nf,
    sum(case when o_orderstatus = 'O' then 1 else 0 end) no
  from {orders} group by 1, 2),
b as (
  select o.run, o.it, o.n, o.nf, o.no, cast(floor(o.cents / (5000 * o.n)) as bigint) a,
    case c.c_mktsegment when 'AUTOMOBILE' then 'uncertainty_sampling' when 'BUILDING' then 'diversity_sampling'
      when 'FURNITURE' then 'query_by_comitee' when 'MACHINERY' then 'committee_vote'
      else 'random_sampling' end as method,
    case c.c_mktsegment when 'AUTOMOBILE' then 400 when 'BUILDING' then 300
      when 'FURNITURE' then 200 when 'MACHINERY' then 100 else 0 end as bonus
  from o join {customer} c on o.run = c.c_custkey),
v as (
  select run, it, n, nf, no, method,
    least(9999, cast(floor(a * it / (it + 1)) as bigint) + bonus) f1,
    least(9999, cast(floor(a * (10 * it + 1) / (10 * (it + 1))) as bigint) + bonus) acc,
    cast(floor((10000 - a) / (it + 1)) as bigint) unc,
    cast(floor((10000 - a) / 2) as bigint) pool_unc,
    cast(floor(10000 * nf / n) as bigint) rf, cast(floor(10000 * no / n) as bigint) ro
  from b),
u as (
  select run, it, n, nf, no, method, f1, acc, unc, pool_unc, rf, ro from v
  union all
  select run, 0, 1, 0, 0, max(method), 0, 2000, 0, 5000, 0, 0 from v group by run),
w as (
  select u.*,
    concat('"accuracy": ', cast(cast(floor(acc / 10000) as bigint) as string), '.', lpad(cast(acc % 10000 as string), 4, '0')) t_acc,
    concat(', "macro_f1": 0.', lpad(cast(f1 as string), 4, '0')) t_f1,
    case when nf > 0 then concat(', "selected_samples_avg_uncertainty": 0.', lpad(cast(unc as string), 4, '0'),
      ', "recall_contract": ', cast(cast(floor(rf / 10000) as bigint) as string), '.', lpad(cast(rf % 10000 as string), 4, '0'))
      else ', "recall_contract": null' end t_f,
    case when no > 0 then concat(', "avg_uncertainty_pool": 0.', lpad(cast(pool_unc as string), 4, '0'),
      ', "recall_full-time": 0.5, "recall_volunteer": ', cast(cast(floor(ro / 10000) as bigint) as string), '.', lpad(cast(ro % 10000 as string), 4, '0'))
      else '' end t_o
  from u)
select run * 10 + it as id,
  case when method = 'committee_vote' then concat('exp-', cast(run as string)) else cast(run as string) end as test_id,
  cast(it as int) as iteration_no,
  case when it = 0 then 'base (v1)' when method = 'committee_vote' then '' else concat('textmodel (run ', cast(run as string), ')') end as model_name,
  cast(2000 * it as bigint) as train_data_size,
  case when it = 0 then 'BASE' else method end as method,
  cast(14000 as bigint) as data_size,
  case when it > 0 and method <> 'committee_vote' then cast(2000 as bigint) end as n,
  cast(null as double) as t,
  cast(null as double) as i,
  case when it = 0 then concat('{{', t_acc, '}}')
    when n > 1 and nf + no = 0 then 'nan'
    else concat('{{', t_acc, t_f1, t_f, t_o, '}}') end as metrics,
  concat('{{"N": 2000, "method": "', method, '"}}') as params,
  'batch' as run_by,
  case when it = 0 then 'base_classifier' when it = 7 then 'max_iterations_reached (7)' else 'continue' end as notes
from w
"""


class Tables:
    """Lazy views over the tables of one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def postings(self) -> DataFrame:
        return self.raw("documents").select(
            F.col("doc_id").cast("string").alias("job_id"),
            F.col("text").alias("description"),
            F.col("lang").alias("formatted_work_type"),
            F.col("source").alias("company_name"),
        )

    @cached_property
    def rows(self) -> DataFrame:
        """Labelled texts: ``id, description, label, source``."""
        return self.raw("documents").select(
            F.col("doc_id").alias("id"), F.col("text").alias("description"), F.col("lang").alias("label"), "source"
        )

    @cached_property
    def embeddings(self) -> DataFrame:
        return self.raw("embeddings").select(F.col("vec_id").alias("id"), "embedding", F.col("label").alias("cluster"))

    @cached_property
    def scores(self) -> DataFrame:
        """Committee output: ``id, member, probs``."""
        members = self.embeddings.select("id", "embedding", F.explode(F.array(*[F.lit(m) for m in range(MEMBERS)])).alias("member"))
        # four sums per member: every twelfth of the 64 dimensions, from a start that the member gives
        step = MEMBERS * len(LABELS)
        logits = []
        for j in range(len(LABELS)):
            dims = [F.get("embedding", F.col("member") * len(LABELS) + (step * k + j)).cast("double") for k in range(-(-DIMENSIONS // step))]
            logits.append(reduce(lambda a, b: a + b, [F.coalesce(d, F.lit(0.0)) for d in dims]) * SHARPNESS)
        logits = F.array(*logits)
        return members.select("id", "member", softmax(logits).alias("probs"))

    @cached_property
    def pool(self) -> DataFrame:
        known = self.raw("labels").select(F.col("doc_id").alias("id"), F.lit(True).alias("_known"))
        first = self.scores.filter(F.col("member") == 0).select(
            "id",
            predicted_class("probs").cast("string").alias("model_prediction"),
            rounded(uncertainty("probs")).alias("uncertainty_score"),
        )
        return (
            self.rows.join(known, "id", "left")
            .join(first, "id", "left")
            .select(
                "id",
                "description",
                F.col("_known").isNotNull().alias("is_labelled"),
                "label",
                "model_prediction",
                "uncertainty_score",
            )
        )

    @cached_property
    def predictions(self) -> DataFrame:
        """``id, member, label, description, probs, predicted_class, predicted_label, confidence``."""
        return self.scores.join(self.rows.select("id", "label", "description"), "id").select(
            "*",
            predicted_class("probs").alias("predicted_class"),
            label_name(predicted_class("probs"), LABELS).alias("predicted_label"),
            confidence("probs").alias("confidence"),
        )

    @cached_property
    def one_model(self) -> DataFrame:
        return self.predictions.filter(F.col("member") == 0)

    @cached_property
    def results(self) -> DataFrame:
        return self.spark.sql(RESULTS_SQL, orders=self.raw("orders"), customer=self.raw("customer"))
