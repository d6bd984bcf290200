"""Benchmark results: records, canonical JSON, label sidecars, file names, and what is derived from them."""

from __future__ import annotations

import hashlib
import itertools
import json
import math
import os
import platform
import subprocess
from collections.abc import Iterable
from dataclasses import asdict, dataclass, field
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RESULT = (
    "recipe_name string, size int, dims int, params map<string,string>, ours_median_ms double, theirs_median_ms double, ours_peak_mb double, "
    "theirs_peak_mb double, ari double, ours_noise_frac double, theirs_noise_frac double, speedup double, timestamp string, effective_params map<string,string>"
)
OTHER = ("theirs_median_ms", "theirs_peak_mb", "theirs_noise_frac", "speedup")
NUMBERS = ("ours_median_ms", "theirs_median_ms", "ours_peak_mb", "theirs_peak_mb", "ari", "ours_noise_frac", "theirs_noise_frac", "speedup")


@dataclass
class Metadata:
    timestamp: str = "unknown"
    git_sha: str = "unknown"
    machine: str = "unknown"
    encoding_version: int = 1


def capture_metadata(root: str = ".") -> Metadata:
    done = subprocess.run(["git", "-C", root, "rev-parse", "HEAD"], capture_output=True, text=True)
    return Metadata(datetime.now(UTC).isoformat(timespec="seconds"), done.stdout.strip() or "unknown", f"{platform.system()} {platform.machine()} {os.cpu_count()} cpus")


def canonical_dumps(value) -> str:
    """Sorted keys, ASCII, no NaN or infinity."""
    return json.dumps(value, sort_keys=True, ensure_ascii=True, allow_nan=False, separators=(",", ":"))


def canonical_payload(results: Iterable[dict]) -> str:
    """The same text for the same results; a value that isn't finite raises, naming its row and field."""
    rows = list(results)
    for k, row in enumerate(rows):
        for name, value in row.items():
            if isinstance(value, float) and not math.isfinite(value):
                raise ValueError(f"row {k}: {name} is {value}")
    return canonical_dumps(rows)


def payload_hash6(results: Iterable[dict]) -> str:
    return hashlib.sha256(canonical_payload(results).encode()).hexdigest()[:6]


def seed_of(hash6: str) -> int:
    """The low 32 bits of the SHA-256 of a hash's text."""
    return int(hashlib.sha256(hash6.encode()).hexdigest()[-8:], 16)


def save_results(path: str, meta: Metadata, results: Iterable[dict]) -> None:
    """One canonical JSON file, of {meta, results}: the results are few."""
    text = json.dumps({"meta": asdict(meta), "results": list(results)}, sort_keys=True, indent=2, ensure_ascii=True, allow_nan=False)
    with open(path, "w", encoding="ascii") as out:
        out.write(text + "\n")


def load_results(path: str) -> tuple[Metadata, list[dict]]:
    """From {meta, results}, or a bare list (its metadata unknown); other shapes raise."""
    with open(path, encoding="ascii") as source:
        value = json.load(source)
    if isinstance(value, list):
        return Metadata(), value
    if isinstance(value, dict) and set(value) == {"meta", "results"} and isinstance(value["results"], list):
        return Metadata(**value["meta"]), value["results"]
    raise ValueError(f"{path} has no results")


def results_frame(spark: SparkSession, results: Iterable[dict]) -> DataFrame:
    return spark.createDataFrame([tuple(r.get(n.split()[0]) for n in RESULT.split(", ")) for r in results], RESULT)


def save_labels(cells: DataFrame, path: str, hash6: str, recipe_name: str, versions: dict[str, str] | None = None) -> None:
    """Label cells (cell_key, id, truth, ours, theirs, x, y) as Parquet by cell, with a row of metadata; the write commits as a whole."""
    cells.write.mode("overwrite").partitionBy("cell_key").parquet(f"{path}/cells")
    meta = cells.sparkSession.createDataFrame([(hash6, recipe_name, canonical_dumps(versions or {}))], "hash6 string, recipe_name string, versions string")
    meta.coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")


def load_labels(spark: SparkSession, path: str, expected_hash6: str, expected_recipe_name: str, versions: dict[str, str] | None = None) -> tuple[str, DataFrame | None]:
    """``OK``, ``WARN`` (other versions) or ``ERROR`` (missing, unreadable or of another identity), and the cells unless in error."""
    from pyspark.errors import PySparkException

    try:
        meta = spark.read.parquet(f"{path}/meta").first()
        cells = spark.read.parquet(f"{path}/cells")
    except PySparkException:
        return "ERROR", None
    if meta is None or meta.hash6 != expected_hash6 or meta.recipe_name != expected_recipe_name:
        return "ERROR", None
    return ("OK" if meta.versions == canonical_dumps(versions or {}) else "WARN"), cells


def chart_filename(algo: str, params: dict, hash6: str, suffix: str = "") -> str:
    return "_".join(x for x in (algo, slug_from_params(params), suffix, hash6) if x) + ".png"


def slug_from_params(params: dict) -> str:
    """k=v sorted and joined by +; characters that a file name can't have are escaped."""
    clean = lambda x: "".join(c if c.isalnum() or c in ".-" else f"%{ord(c):02x}" for c in str(x))
    return "+".join(f"{clean(k)}={clean(params[k])}" for k in sorted(params))


def slug(params: Column) -> Column:
    """The slug of a map column with plain keys and values."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(params)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "+")


def partition_key(row: dict) -> tuple:
    """(recipe, sorted parameters other than n_jobs); a parameter that is no scalar raises."""
    own = {k: v for k, v in row["params"].items() if k != "n_jobs"}
    for k, v in own.items():
        if not isinstance(v, str | int | float | bool | None):
            raise TypeError(f"parameter {k} is no scalar")
    return row["recipe_name"], tuple(sorted(own.items()))


def group_key(params: Column) -> Column:
    return slug(F.map_filter(params, lambda k, v: k != "n_jobs"))


def partition(results: DataFrame) -> DataFrame:
    """``results`` with ``partition``; a repeated (recipe, size, dims, params) raises."""
    keyed = results.withColumn("partition", F.concat_ws("|", "recipe_name", group_key(F.col("params"))))
    again = keyed.groupBy("recipe_name", "size", "dims", slug(F.col("params")).alias("p")).count().where("count > 1").take(1)
    if again:
        raise ValueError(f"repeated result: {again[0]}")
    return keyed


def safe_ratio(numerator: Column, denominator: Column) -> Column:
    """NaN unless both are finite and the denominator is positive."""
    infinite = lambda c: F.isnan(c) | (F.abs(c) == float("inf")) | c.isNull()
    return F.when(infinite(numerator) | infinite(denominator) | (denominator <= 0), F.lit(float("nan"))).otherwise(numerator / denominator)


def gates(results: DataFrame, thresholds: DataFrame) -> DataFrame:
    """``results`` with ``reasons``, the gates that a row fails; ``thresholds`` is (recipe_name, threshold), 0.85 where missing.  Numbers of the other side may be null, where there is none."""
    joined = results.join(F.broadcast(thresholds), "recipe_name", "left").withColumn("threshold", F.coalesce("threshold", F.lit(0.85)))
    infinite = [F.when(F.isnan(n) | (F.abs(n) == float("inf")) | (F.col(n).isNull() & F.lit(n not in OTHER)), F.lit(f"{n} not finite")) for n in NUMBERS]
    peaks = [F.when(F.col(n) <= 0, F.lit(f"{n} not positive")) for n in ("ours_peak_mb", "theirs_peak_mb")]
    low = F.when((F.col("ari") < F.col("threshold")) | F.isnan("ari"), F.lit("ari below threshold"))
    return joined.withColumn("reasons", F.array_compact(F.array(low, *peaks, *infinite)))


def representative_dims(dims: Iterable[int]) -> list[int]:
    """The lowest, the middle and the highest."""
    own = sorted(set(dims))
    return own if len(own) <= 3 else [own[0], own[len(own) // 2], own[-1]]


def cell_key(size: int, dims: int, n_jobs: int | None = None) -> str:
    return f"n={size}__d={dims}" + (f"__jobs={n_jobs}" if n_jobs is not None else "")


def cell_key_column() -> Column:
    jobs = F.col("params")["n_jobs"]
    return F.concat(F.lit("n="), F.col("size").cast("string"), F.lit("__d="), F.col("dims").cast("string"), F.when(jobs.isNotNull(), F.concat(F.lit("__jobs="), jobs)).otherwise(F.lit("")))


def pick_cells(results: DataFrame, size: int | None = None, dims: int | None = None, n_jobs: str | None = None, all_dims: bool = False) -> DataFrame:
    """One cell per dimension: the largest size, the first of equal ones by ``place``; without ``all_dims``, representative dimensions only."""
    rows = results
    for name, value in (("size", size), ("dims", dims)):
        if value is not None:
            rows = rows.where(F.col(name) == value)
    if n_jobs is not None:
        rows = rows.where(F.col("params")["n_jobs"] == str(n_jobs))
    if not all_dims and dims is None:
        rows = rows.where(F.col("dims").isin(representative_dims(r.dims for r in rows.select("dims").distinct().collect())))
    rank = F.row_number().over(Window.partitionBy("dims").orderBy(F.desc("size"), "place"))
    return rows.withColumn("_r", rank).where("_r = 1").drop("_r")


@dataclass
class Recipe:
    """A benchmark: data, parameter grid and quality threshold."""

    name: str
    sizes: list[int]
    dims: list[int]
    grid: dict[str, list] = field(default_factory=dict)
    n_runs: int = 5
    threshold: float = 0.85


def expand_grid(recipe: Recipe) -> list[dict]:
    """The cross product of the parameters, keys sorted."""
    keys = sorted(recipe.grid)
    return [dict(zip(keys, values, strict=True)) for values in itertools.product(*(recipe.grid[k] for k in keys))]
