"""Running recipes: every size, dimension and parameter set of each, timed, as result rows; and the command line."""

from __future__ import annotations

import argparse
import statistics
import sys
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnspark.operators.agreement import adjusted_rand_index, resolve_eps
from cairnspark.operators.density import dbscan
from cairnspark.operators.hierarchy import hdbscan
from cairnspark.operators.kmeans import kmeans
from cairnspark.sources import results as R
from cairnspark.sources.points import make_data, read_csv, write_labels

#: Fits: (cloud, dimension, parameters) -> (id, label).
FITS: dict[str, Callable[[DataFrame, int, dict], DataFrame]] = {
    "dbscan": lambda x, d, p: dbscan(x, resolve_eps(p.get("eps_policy", "knee"), p.get("eps", 0.5), x, d, p.get("min_samples", 5)), p.get("min_samples", 5)).labels,
    "hdbscan": lambda x, d, p: hdbscan(x, p.get("min_cluster_size", 5), method=p.get("method", "eom")).labels,
    "kmeans": lambda x, d, p: kmeans(x, p.get("k", 16), n_init=p.get("n_init", 5), seed=p.get("seed", 0)).labels,
}


def recipes() -> dict[str, R.Recipe]:
    return {
        "dbscan": R.Recipe("dbscan", [10_000, 50_000, 100_000], [2, 8, 32, 64, 128], {"min_samples": [5]}, 3, 0.98),
        "hdbscan": R.Recipe("hdbscan", [5_000, 25_000, 100_000], [2, 8, 32, 64, 128], {"min_cluster_size": [5]}, 3, 0.98),
        "kmeans": R.Recipe("kmeans", [5_000, 10_000, 50_000, 100_000, 250_000], [2, 8, 32, 128, 256, 512, 1024], {"k": [16], "n_init": [5]}, 3, 0.98),
    }


def heap_peak_mb(spark: SparkSession) -> float:
    """The peak use of the driver's JVM so far; with executors of their own, their task metrics have theirs."""
    pools = spark.sparkContext._jvm.java.lang.management.ManagementFactory.getMemoryPoolMXBeans()
    return sum(pools.get(k).getPeakUsage().getUsed() for k in range(pools.size())) / 1e6


def run_suite(spark: SparkSession, chosen: list[R.Recipe], sizes: list[int] | None = None, dims: list[int] | None = None) -> list[dict]:
    """A result row per cell.  There is no second engine here: labels are held against the generator's truth, and the columns of the other side are null."""
    out = []
    for recipe in chosen:
        for d in dims or recipe.dims:
            for n in sizes or recipe.sizes:
                data = make_data(spark, n, d).persist()
                cloud, truth = data.select("id", "features"), data.select("id", "label")
                for params in R.expand_grid(recipe):
                    times = []
                    for _ in range(recipe.n_runs):
                        began = time.perf_counter()
                        labels = FITS[recipe.name](cloud, d, params)
                        labels = labels.select("id", "label").persist()
                        noise = labels.agg(F.avg((F.col("label") == -1).cast("double"))).first()[0]
                        times.append(1000 * (time.perf_counter() - began))
                    peak = heap_peak_mb(spark)
                    ari, median = adjusted_rand_index(truth, labels).first().ari, statistics.median(times)
                    out.append({"recipe_name": recipe.name, "size": n, "dims": d, "params": {k: str(v) for k, v in params.items()}, "ours_median_ms": median, "theirs_median_ms": None, "ours_peak_mb": peak, "theirs_peak_mb": None, "ari": ari, "ours_noise_frac": noise, "theirs_noise_frac": None, "speedup": None, "timestamp": R.capture_metadata().timestamp, "effective_params": {}})
                data.unpersist()
    return out


def main(argv: list[str] | None = None) -> int:
    """``fit csv n d eps min_pts out`` writes a label a line; ``bench ALGO --out FILE`` runs a recipe.  0: well; 1: unknown; 2: a gate failed."""
    parser = argparse.ArgumentParser(prog="cairnspark")
    sub = parser.add_subparsers(dest="command", required=True)
    one = sub.add_parser("fit")
    for name, kind in (("csv", str), ("n", int), ("d", int), ("eps", float), ("min_pts", int), ("out", str)):
        one.add_argument(name, type=kind)
    many = sub.add_parser("bench")
    many.add_argument("algo")
    many.add_argument("--sizes", type=int, nargs="*")
    many.add_argument("--dims", type=int, nargs="*")
    many.add_argument("--out", required=True)
    try:
        args = parser.parse_args(argv)
    except SystemExit as e:
        return 0 if e.code in (0, None) else 1
    spark = SparkSession.builder.getOrCreate()
    if args.command == "fit":
        write_labels(dbscan(read_csv(spark, args.csv, args.d, args.n), args.eps, args.min_pts).labels, args.out)
        return 0
    if args.algo not in recipes():
        print(f"unknown: {args.algo}", file=sys.stderr)
        return 1
    recipe = recipes()[args.algo]
    rows = run_suite(spark, [recipe], args.sizes, args.dims)
    R.save_results(args.out, R.capture_metadata(), rows)
    failed = R.gates(R.results_frame(spark, rows), spark.createDataFrame([(recipe.name, recipe.threshold)], "recipe_name string, threshold double")).where(F.size("reasons") > 0)
    return 2 if failed.take(1) else 0


if __name__ == "__main__":
    sys.exit(main())
