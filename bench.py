"""Headline queries on local[$BENCH_CPUS] over $BENCH_SF_DIR; prints one JSON line."""

import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from isoplane import registry  # noqa: E402
from isoplane.operators.design import lhs_design  # noqa: E402
from isoplane.plans import models, scoring  # noqa: E402
from isoplane.registry.models import M32, PAIR, STD_SPEC, TARGET  # noqa: E402
from isoplane.registry.shared import table  # noqa: E402
from isoplane.spec import AnalysisSpec  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
DESIGN_ROWS = 1_000_000

HEADLINE = [
    "scan_lineitem", "derive_columns", "derive_with_aggregates", "scaler_transform", "one_hot",
    "replicate_groups", "replicate_outlier_trim", "replicate_outlier_flags", "column_medians", "histogram_30",
    "parameter_correlation", "score_sorted", "condition_collapse", "kernel_centre", "kernel_cross", "gp_search",
    "gp_predict_std", "gp_metrics", "both_models", "gp_per_block", "curve_1d", "curve_tuned", "surface_2d", "lhs_design", "score_design",
]


def inducing_550(spark, sf_dir):
    """Inducing-point fit over the 4,944 settings of three inputs."""
    spec = AnalysisSpec(("l_quantity", *PAIR), TARGET, mode="mean")
    model = models.fit_model(table(spark, sf_dir, "lineitem"), spec, M32, tune=False, method="sparse", inducing=550)
    return models.predict_rows(model, model.conditions)


def design_million(spark, sf_dir):
    """A million settings, drawn only."""
    return lhs_design(spark, DESIGN_ROWS, {f"p{i}": (0.0, 1.0) for i in range(6)})


def scored_million(spark, sf_dir):
    """A million settings drawn and scored by the replicate model."""
    model = models.fit_model(table(spark, sf_dir, "lineitem"), STD_SPEC, M32, tune=False)
    return scoring.score_design(model, DESIGN_ROWS, {"l_discount": (0.0, 0.1), "l_tax": (0.0, 0.08)})


def run(frame):
    """Compute every row and column without collecting them."""
    frame.write.format("noop").mode("overwrite").save()


def main():
    spark = (SparkSession.builder.master(f"local[{CPUS}]").appName("isoplane-bench")
             .config("spark.sql.shuffle.partitions", CPUS).config("spark.driver.memory", "16g")
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    queries, _ = registry.load()
    todo = {name: queries[name] for name in HEADLINE}
    todo |= {"gp_sparse_550": inducing_550, "lhs_design_1m": design_million, "score_design_1m": scored_million}
    run(queries["gp_predict_std"](spark, SF_DIR))  # start the JVM and the Python workers
    times = {}
    for name, query in todo.items():
        start = time.perf_counter()
        run(query(spark, SF_DIR))
        times[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(SF_DIR.rstrip("/")), "cpus": int(CPUS)}))


if __name__ == "__main__":
    main()
