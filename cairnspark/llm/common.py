"""What the operators of this subpackage share: tables, scratch space, word hashing, joins with hot keys."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnspark.plans.scratch import brief_shuffles, materialise, only, passing, release

#: A word is a maximal run of characters other than the six ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(id_column: str, modulus: int) -> Column:
    """crc32 of the id written as text, modulo ``modulus``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")) % modulus


#: A key that holds at least this share of all rows is hot; there are at most 1 / HOT_SHARE such keys, so their table is safe to broadcast.
HOT_SHARE = 0.001


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, n: int, how: str = "inner") -> DataFrame:
    """Inner or left join of ``rows`` with ``groups`` (one row per ``key``, ``size`` rows of it in ``rows``, ``n`` rows in all).

    Hot keys, of which there are at most 1 / HOT_SHARE, are joined by broadcast, so no task gathers one key; the others by shuffle.
    """
    least = max(2.0, n * HOT_SHARE)
    hot = F.broadcast(groups.where(F.col(size) >= least))
    cold = groups.where(F.col(size) < least)
    return rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(cold, key, how))


#: Stands for a null id where ids are joined or ordered: the smallest.
FIRST = -(1 << 63)


def id_key(column: str = "doc_id") -> Column:
    return F.coalesce(F.col(column).cast("long"), F.lit(FIRST))


def text_key(column: str = "text") -> Column:
    """64 bits that tell rows of one id apart by their text."""
    return F.xxhash64(F.coalesce(F.col(column), F.lit("")))


def unused(name: str, names: list[str]) -> str:
    """``name`` with underscores behind it until it is none of ``names``, in any case."""
    taken = {x.lower() for x in names}
    while name.lower() in taken:
        name += "_"
    return name


def strings(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """One array of large strings, null as empty text."""
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return pc.fill_null(array.cast(pa.large_string()), "")


def slices(texts: pa.Array, most: int = 8 << 20):
    """Pairs (begin, end) of rows with at most ``most`` bytes of text together, or one row."""
    ends = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    begin = 0
    while begin < len(texts):
        end = max(begin + 1, int(np.searchsorted(ends, ends[begin] + most, side="right")) - 1)
        yield begin, min(end, len(texts))
        begin = end
    pa.default_memory_pool().release_unused()  # workers live on


def words_of(texts: pa.Array) -> tuple[np.ndarray, pa.DictionaryArray]:
    """Words of each text: offsets (len + 1) into the dictionary-coded words of all texts, in order."""
    parts = pc.ascii_split_whitespace(texts)
    flat, ends = parts.flatten(), np.asarray(parts.offsets, dtype=np.int64)
    ends = ends - ends[0]
    filled = np.asarray(pc.binary_length(flat)) > 0
    if not filled.all():
        ends = np.concatenate(([0], np.cumsum(filled)))[ends]
        flat = flat.filter(pa.array(filled))
    return ends, flat.dictionary_encode() if len(flat) else pa.array([], pa.large_string()).dictionary_encode()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def hash_words(words: pa.Array) -> np.ndarray:
    """64-bit hashes of distinct words, the same on every machine: sums of a mixed value for each byte at its place."""
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    raw = words.cast(pa.large_binary())
    ends = np.frombuffer(raw.buffers()[1], dtype=np.int64)[raw.offset : raw.offset + n + 1]
    data = np.frombuffer(raw.buffers()[2] or b"", dtype=np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    lengths = np.diff(ends)
    place = np.arange(len(data)) - np.repeat(ends[:-1], lengths)
    value = mix((place.astype(np.uint64) << np.uint64(8)) + data + np.uint64(0x9E3779B97F4A7C15))
    sums = np.zeros(n, dtype=np.uint64)
    filled = np.flatnonzero(lengths)
    if len(filled):
        sums[filled] = np.add.reduceat(value, ends[:-1][filled])
    return mix(sums + lengths.astype(np.uint64))
