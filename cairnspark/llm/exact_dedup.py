"""Exact dedup (native): two-pass Bloom filtering finds the possibly repeated hashes; only those rows shuffle.

Pass 1 is a filter with CELLS cells a row, in buckets.  Every task sends, for each bucket, one array of the cells that its
rows hit, and no rows; where a bucket's arrays meet, cells that two rows hit are told apart.  These cells, as bitmaps, are
the second filter, which pass 2 probes with every row: a row whose cell only it hits is certainly alone and passes straight
through; the rest are grouped by their SHA-256, so false positives cost a little shuffle and never a wrong row.  The
first filter grows with the rows and the second with the repeated cells; both keep their share of false positives, as the
second is cut into slices of FILTER_BITS that are broadcast one by one, each to the rows of its share of the hashes.
Texts shuffle nowhere: both passes read a digest table of (row, id, length, hash).

Cells of a bucket are first gathered task by task, so a text that a third of all rows have adds one cell a task.

Defined results: a null text counts as empty; all texts without a visible character are equal; a null id is an id like
any other, the smallest; of rows equal in text, length and id one is kept, the first in the table's order; an empty table
gives an empty result; columns other than id and text aren't read by :func:`decisions` and are carried by
:func:`keep_unique`.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_key, join_groups, materialise, table, text_key
from .groups import beside

BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
#: Cells for each row in the first filter, rows of a bucket at most, and buckets at least.
CELLS, BUCKET_ROWS, LEAST_BUCKETS = 64, 1 << 20, 64
#: Bits for each repeated cell in the second filter, bits of one slice at most (32 MiB), and bits of a bitmap.
BITS, FILTER_BITS, BITMAP = 16, 1 << 28, 32768


def without_blanks(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    for blank in BLANKS:
        text = F.replace(text, F.lit(blank), F.lit(""))
    return text


def digests(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: its id, its number ``row`` in the table's order, its length and the hash of its text."""
    text = F.coalesce(F.col(text_column), F.lit(""))
    hashed = F.unhex(F.sha2(without_blanks(F.col(text_column)).cast("binary"), 256))
    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), text_key(text_column).alias("text_key"), F.length(text).cast("long").alias("n_chars"), hashed.alias("h"))


def again(sorted_cells: Column) -> Column:
    """The values that a sorted array has more than once."""
    before = F.transform(sorted_cells, lambda _, i: F.get(sorted_cells, i - 1))
    return F.array_distinct(F.filter(F.zip_with(sorted_cells, before, lambda x, y: F.when(x == y, x)), lambda x: x.isNotNull()))


def repeated_cells(cells: DataFrame) -> DataFrame:
    """(bucket, cell) of every cell that several rows of ``cells`` (bucket, cell) have."""
    per_task = cells.groupBy("bucket", F.spark_partition_id().alias("task")).agg(F.sort_array(F.collect_list("cell")).alias("all"))
    per_task = materialise(per_task.select("bucket", F.array_distinct("all").alias("once"), again(F.col("all")).alias("twice")))
    per_bucket = per_task.groupBy("bucket").agg(F.sort_array(F.flatten(F.collect_list("once"))).alias("once"), F.flatten(F.collect_list("twice")).alias("twice"))
    return per_bucket.select("bucket", F.explode(F.array_union("twice", again(F.col("once")))).alias("cell"))


def possibly_repeated(digest: DataFrame, n: int) -> DataFrame:
    """``digest`` with a boolean ``maybe``: false only where no other row has this hash."""
    bits = max(LEAST_BUCKETS.bit_length() - 1, (n // BUCKET_ROWS).bit_length())
    width = CELLS * max(1, -(-n >> bits))
    hashed = F.xxhash64("h")
    rows = digest.withColumn("bucket", F.shiftrightunsigned(hashed, 64 - bits).cast("int")).withColumn("cell", F.pmod(hashed, F.lit(width).cast("long")).cast("int"))
    found = materialise(repeated_cells(rows.select("bucket", "cell")))
    repeated = max(1, found.count())
    parts = -(-repeated * BITS // FILTER_BITS)
    size = max(BITMAP, 1 << (repeated * BITS // parts - 1).bit_length())
    place = F.xxhash64(F.lit(1), F.col("bucket"), F.col("cell"))

    def placed(frame: DataFrame) -> DataFrame:
        at = F.pmod(place, F.lit(size).cast("long"))
        return frame.withColumns({"part": F.pmod(F.shiftright(place, 40), F.lit(parts).cast("long")).cast("int"), "map": (at / BITMAP).cast("int"), "bit": (at % BITMAP).cast("int")})

    bitmaps = materialise(placed(found).groupBy("part", "map").agg(F.bitmap_construct_agg("bit").alias("bits")))
    rows, out = placed(rows), []
    for k in range(parts):
        own = F.broadcast(bitmaps.where(F.col("part") == k).select("map", "bits"))  # FILTER_BITS at most
        out.append(rows.where(F.col("part") == k).join(own, "map", "left"))
    byte = F.conv(F.hex(F.substring(F.col("bits"), (F.col("bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    maybe = F.coalesce(F.getbit(byte, F.col("bit") % 8) == 1, F.lit(False))
    return reduce(DataFrame.unionByName, out).withColumn("maybe", maybe).select(*digest.columns, "maybe")


def decided(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The digest rows with keep_id, group_size and kept."""
    digest = materialise(digests(docs, id_column, text_column))
    n = digest.count()
    flagged = materialise(possibly_repeated(digest, n))
    alone = flagged.where("NOT maybe").select("doc_id", "text_key", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "h")
    rest = flagged.where("maybe").drop("maybe")
    best = F.min(F.struct((-F.col("n_chars")).alias("less"), F.col("doc_id"), F.col("row")))
    groups = materialise(rest.groupBy("h").agg(F.count("*").alias("group_size"), best.alias("best")))
    joined = join_groups(rest, groups, "h", "group_size", n)
    joined = joined.select("doc_id", "text_key", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("best.row")).alias("kept"), "h")
    return alone.unionByName(joined)


def decisions(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.  Of equal texts the longest original stays, then the smallest id."""
    return decided(docs, id_column, text_column).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("h")).alias("text_sha256"))


def keep_unique(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` with one row of each group of equal texts, that of :func:`decisions`; of rows equal in id and text, any."""
    own = F.struct(id_key().alias("id"), F.col("text_key").alias("text"))
    touched = decided(docs, id_column, text_column).where("group_size > 1").select(own.alias("own"), "kept").groupBy("own").agg(F.max("kept").alias("stays"), F.count("*").alias("rows"))
    touched = materialise(touched.where("NOT stays OR rows > 1"))
    every = docs.select(F.struct(*docs.columns).alias("row"), F.struct(id_key(id_column).alias("id"), text_key(text_column).alias("text")).alias("own"))
    marked = beside(every, touched, ["own"], "left")
    repeats = marked.where("stays").dropDuplicates(["own"])  # only rows that repeat in id and text
    return marked.where("stays IS NULL").select("row.*").unionByName(repeats.select("row.*"))


def op8_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return decisions(table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h
  FROM documents
)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY h) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept,
       h AS text_sha256
FROM d WINDOW w AS (PARTITION BY h ORDER BY n DESC, doc_id)
"""
