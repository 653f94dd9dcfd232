"""Times headline queries and prints one JSON line.

BENCH_SF_DIR and BENCH_CPUS choose the data and the cores. Every query is run once to warm up and
three times for the clock; the median counts. Results are consumed whole without being kept, and
intermediate files go to a folder of the run that is removed at the end.
"""

import json
import os
import sys
import tempfile
import time
from statistics import median

from poolsift.plans.registry import QUERIES
from poolsift.session import clear, local_session

HEADLINE = [
    # selection over the pool
    "uncertainty_sampling",
    "committee_js",
    "committee_vote",
    "random_sampling",
    "nearest_to_centroid",
    "centroid_predict",
    # labelling state
    "split_test",
    "save_predictions",
    "apply_labels",
    "init_labelled",
    # balancing and folds
    "balance_min_class",
    "balance_fixed",
    "balance_intelligent",
    "stratified_subsample",
    "stratified_kfold",
    # evaluation
    "class_report",
    "cross_validate",
    "compare_models",
    "error_examples",
    # results log
    "split_runs",
    "metric_series",
    "learning_curve",
    "data_savings",
    "paired_t_test",
    "anova_methods",
    "curve_auc",
    "objectives",
    "overall_winner",
    "stop_plateau",
    "iteration_report",
    # training and the whole loop
    "predict_many",
    "active_learning_loop",
]
#: Timed runs after the one that warms up; their median counts. The loop runs for long and only once.
RUNS = 3
ONCE = {"active_learning_loop"}


def consume(df):
    df.write.format("noop").mode("overwrite").save()


def main():
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    seconds = {}
    with tempfile.TemporaryDirectory(prefix="poolsift-bench-") as scratch:
        spark = local_session(cpus, checkpoint_dir=scratch)
        for name in names:
            runs = []
            for _ in range(1 if name in ONCE else 1 + RUNS):
                start = time.perf_counter()
                consume(QUERIES[name](spark, folder))
                runs.append(time.perf_counter() - start)
            seconds[name] = round(median(runs[1:] or runs), 3)
            clear(spark)
    line = {
        "metric": "headline queries, median of three runs, total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
        "cpus": cpus,
    }
    print(json.dumps(line))


if __name__ == "__main__":
    main()
