"""Mixing sources to target weights: hash-random keys, a range sort within each source, distributed prefix sums, exact cuts.

Every source gets a target of words.  Each of its documents is taken whole as often as the target holds the whole source
(epochs); what is left is cut from the documents in the order of a hash-random key: whole documents up to the budget, and
of the one that crosses it only its first words.  Keys are uniform, so ranges of keys are even even for a source that
holds a third of all rows: prefix sums run within about sqrt(n) ranges, and then over the totals of the ranges.

Defined results: a null text has no words and none are taken; a null source is a source of its own, the last; equal rows
are taken one after the other, so of equal rows some may be taken and others not; documents without words get 0; an empty table gives an empty result; a target is 0 where
the source has no words; extra columns are carried.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD, materialise, table

WEIGHTS = (1.0, 2.0, 3.0)
MOST_EPOCHS = 3


def targets_of(sizes: dict[str | None, int], weights: tuple[float, ...] = WEIGHTS, most: float = MOST_EPOCHS) -> dict[str | None, float]:
    """Targets in words: all words shared by weight, none above ``most`` times its source's, the excess shared again by weight."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, free, target = float(sum(sizes.values())), list(names), dict.fromkeys(names, 0.0)
    while free:
        unit = left / sum(weight[s] for s in free)
        full = [s for s in free if unit * weight[s] > most * sizes[s]]
        if not full:
            target.update({s: unit * weight[s] for s in free})
            break
        for s in full:
            target[s] = float(most * sizes[s])
            left -= target[s]
            free.remove(s)
    return target


def measured(docs: DataFrame, id_column: str = "doc_id", source_column: str = "source", text_column: str = "text") -> DataFrame:
    words = F.regexp_count(F.coalesce(F.col(text_column), F.lit("")), F.lit(WORD)).cast("long")
    return docs.select(F.col(id_column).alias("doc_id"), F.col(source_column).cast("string").alias("source"), words.alias("size"))


#: Keys are the first so many bits of SHA-256, a multiple of 4.
KEY_BITS = 60


def key_of(seed: int, doc_id: str = "doc_id", size: str = "size") -> Column:
    """A hash-random key, of equal rows equal; any engine with SHA-256 can make it."""
    text = F.concat_ws("/", F.lit(str(seed)), F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.col(size).cast("string"))
    return F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, KEY_BITS // 4), 16, 10).cast("long")


def plan(docs: DataFrame, seed: int = 17, **columns: str) -> DataFrame:
    """doc_id, source, size, key, source_size, target, epochs, part and taken: what the mix takes of each document, in words, repeats counted: ``epochs`` times all, and ``part``."""
    spark = docs.sparkSession
    rows = materialise(measured(docs, **columns).withColumn("key", key_of(seed)))
    per_source = rows.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()
    n = sum(r.n for r in per_source)
    sizes = {r.source: int(r["size"]) for r in per_source}
    target = targets_of(sizes)
    schema = T.StructType([T.StructField("has", T.BooleanType()), T.StructField("source", T.StringType()), T.StructField("source_size", T.LongType()), T.StructField("target", T.DoubleType()), T.StructField("epochs", T.LongType()), T.StructField("rest", T.LongType())])
    cuts = []
    for s, size in sizes.items():
        epochs = int(target[s] // size) if size else 0
        cuts.append((s is not None, s or "", size, target[s], epochs, min(size, math.floor(target[s] - epochs * size + 0.5))))
    cut = F.broadcast(spark.createDataFrame(cuts, schema))  # one row per source
    shift = KEY_BITS - max(1, math.ceil(math.log2(max(2.0, math.sqrt(max(n, 1))))))
    rows = rows.select("doc_id", F.col("source").isNotNull().alias("has"), F.coalesce("source", F.lit("")).alias("source"), "size", "key", F.shiftright("key", shift).alias("range"))
    group = ["has", "source"]
    ahead = Window.partitionBy(*group).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*group, "range").agg(F.sum("size").alias("t")).select(*group, "range", F.coalesce(F.sum("t").over(ahead), F.lit(0)).alias("base"))
    within = Window.partitionBy(*group, "range").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    before = rows.withColumn("inner", F.coalesce(F.sum("size").over(within), F.lit(0))).join(totals, [*group, "range"]).join(cut, group)
    part = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), F.col("rest") - F.col("base") - F.col("inner")))
    out = before.select("doc_id", F.when(F.col("has"), F.col("source")).alias("source"), "size", "key", "source_size", "target", "epochs", part.alias("part"))
    return out.withColumn("taken", F.col("epochs") * F.col("size") + F.col("part"))


def numbered(rows: DataFrame, group: str) -> DataFrame:
    """``rows`` with ``number``, from 1 in each ``group``: by the task that wrote them and within it, so that no task gathers a group."""
    rows = materialise(rows.withColumn("task", F.spark_partition_id()))
    ahead = Window.partitionBy(group).orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(group, "task").count().select(group, "task", F.coalesce(F.sum("count").over(ahead), F.lit(0)).alias("base"))
    inner = F.row_number().over(Window.partitionBy(group, "task").orderBy(F.lit(0)))
    return rows.withColumn("inner", inner).join(F.broadcast(totals), [group, "task"]).withColumn("number", F.col("base") + F.col("inner")).drop("base", "inner", "task")


def mix(docs: DataFrame, seed: int = 17) -> DataFrame:
    """The mixed documents, with the columns of ``docs``: one row for every whole copy taken, and one with the first words where a cut runs through the document.

    ``docs`` needs doc_id, text and source; other columns are carried, whatever their names, and n_chars, where present,
    follows the text.  The plan comes down to a row per source: the key before which documents are taken whole, and of the
    rows with this key, of which there are several only if they agree in doc_id and size, how many are whole and the words
    taken of one more.  So texts neither shuffle nor join with anything larger, but for the rows with such a key.
    """
    by_key = plan(docs, seed).where("part > 0").groupBy("source", "key").agg(F.sum((F.col("part") == F.col("size")).cast("long")).alias("whole"), F.max(F.when(F.col("part") < F.col("size"), F.col("part"))).alias("rest"))
    ends = by_key.groupBy("source").agg(F.max(F.struct("key", "whole", "rest")).alias("end"))
    epochs = plan(docs, seed).groupBy("source").agg(F.max("epochs").alias("epochs"))
    ends = epochs.join(ends.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left").select(F.col("source").alias("of"), "epochs", "end.*")
    ends = F.broadcast(materialise(ends.withColumn("end", F.monotonically_increasing_id())))  # one row per source
    words = F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD)).cast("long")
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id"), F.col("source").cast("string").alias("from"), words.alias("size"))
    rows = rows.withColumn("at", key_of(seed)).where("size > 0").join(ends, F.col("from").eqNullSafe(F.col("of")))
    times = F.col("epochs").cast("int")
    plain = rows.where("at <> key OR key IS NULL").select("row", F.when(F.col("at") < F.col("key"), times + 1).otherwise(times).alias("times"), F.lit(None).cast("long").alias("cut"))
    border = numbered(rows.where("at = key").select("row", "epochs", "whole", "rest", "end"), "end")
    border = border.select("row", F.when(F.col("number") <= F.col("whole"), times + 1).otherwise(times).alias("times"), F.when(F.col("number") == F.col("whole") + 1, F.col("rest")).alias("cut"))
    every = plain.unionByName(border)
    last = F.when(F.col("cut").isNotNull(), F.array("cut")).otherwise(F.array().cast("array<bigint>"))
    every = every.select("row", F.explode(F.concat(F.array_repeat(F.lit(None).cast("long"), F.col("times")), last)).alias("cut"))
    # the first words and the blanks before each
    head = F.array_join(F.slice(F.regexp_extract_all("row.text", F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0)), 1, F.col("cut").cast("int")), "")
    text = F.when(F.col("cut").isNull(), F.col("row.text")).otherwise(head)
    own = {"text": text, "n_chars": F.length(text).cast("long")}
    return every.select(*[own.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])


def op4_source_mixing(spark, sf_dir: str) -> DataFrame:
    return plan(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), k AS (
  SELECT *, ('0x' || substr(sha256('17/' || coalesce(doc_id::VARCHAR, '') || '/' || size::VARCHAR), 1, 15))::BIGINT AS key FROM d
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1.0::DOUBLE AS w FROM d GROUP BY source
), o AS (  -- the sources that fill up are the first by size a weight
  SELECT *, (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (ORDER BY source_size / w, w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
            / (sum(w) OVER (ORDER BY source_size / w, w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS unit,
         row_number() OVER (ORDER BY source_size / w, w, source NULLS LAST) AS r FROM s
), u AS (
  SELECT unit, r FROM o WHERE unit * w <= 3 * source_size ORDER BY r LIMIT 1
), t AS (
  SELECT source, source_size, CASE WHEN o.r < coalesce((SELECT r FROM u), 9e18) THEN 3.0::DOUBLE * source_size ELSE (SELECT unit FROM u) * w END AS target FROM o
), e AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM t
), p AS (
  SELECT k.doc_id, k.size, e.source_size, e.target, e.epochs,
         least(e.source_size, floor(e.target - e.epochs * e.source_size + 0.5)::BIGINT) AS rest,
         coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id, k.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source
)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, rest - before)))::BIGINT AS taken FROM p
"""
