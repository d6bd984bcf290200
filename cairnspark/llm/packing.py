"""Best-fit packing by length patterns: non-negative least squares fits how often each pattern of few lengths repeats.

1.  Every document becomes pieces of at most ``size`` tokens; their lengths make a histogram of at most ``size`` bins.
2.  Patterns are the multisets of up to DEPTH lengths that fill a sequence exactly.  Projected gradient steps on the
    sparse pattern matrix fit non-negative repeat counts to the histogram; counts are rounded down and trimmed so that no
    bin is overdrawn.
3.  What is left in the histogram, and nothing else, is packed by best fit in decreasing order of length, bin by bin:
    equal lengths move together, so the work depends on the number of bins and not on the number of documents.
4.  The plan is a list of runs ("ranks a.. of length l go to sequences s.., at offset o").  Every piece gets its rank among
    the pieces of its length by two-level prefix counts over hashed groups, and looks its run up.

The plan's size depends on ``size`` only.  Defined results: a null text is an empty document, one piece of the single id
0; rows with equal doc_id are packed each on its own; an empty table gives no pieces; extra columns aren't read.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, slices, strings, table

SIZE, END_ID, VOCABULARY, RANKS = 2048, 0, "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"
#: Entries of a worker's cache of words' ids; it is emptied when full.
MOST_CACHED = 400_000
PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long"


class Encoder:
    """Token ids of texts as little-endian bytes: those of ``tokenizers`` for the vocabulary ``json_path``.

    ``ranks_path`` holds the same vocabulary for a faster encoder.  It splits words by the same rule, but its tables of
    character classes may be of another Unicode version, so it takes only texts without characters after Latin
    Extended-B, whose classes never change.  In the others a text is cut before a single space between two other
    characters (the vocabulary never joins a blank to the character before it); each part is encoded once and kept.
    """

    other = regex.compile("[^\x00-\u024f]")
    between = regex.compile(r"(?<=\S) (?=\S)")

    def __init__(self, json_path: str, ranks_path: str | None):
        from tokenizers import Tokenizer

        self.tokenizer, self.fast, self.cache = Tokenizer.from_file(json_path), None, {}
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        if ranks_path:
            import public_tokenizers
            import tiktoken

            with open(ranks_path, "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> bytes:
        if not text:
            return b""
        if self.fast and not self.other.search(text):
            return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()
        first, *rest = self.between.split(text)
        parts = [first, *(" " + x for x in rest)]
        if len(self.cache) > MOST_CACHED:
            self.cache.clear()
        new = [x for x in set(parts) if x not in self.cache]
        if new:
            self.cache.update((x, np.array(e.ids, dtype="<u4").tobytes()) for x, e in zip(new, self.tokenizer.encode_batch_fast(new, add_special_tokens=False), strict=True))
        return b"".join(map(self.cache.__getitem__, parts))


@lru_cache(maxsize=2)
def encoder(json_path: str, ranks_path: str | None) -> Encoder:
    """One for each worker process."""
    return Encoder(json_path, ranks_path)


def pieces_of(batches: Iterator[pa.RecordBatch], paths: tuple[str, str | None], size: int) -> Iterator[pa.RecordBatch]:
    encode, end = encoder(*paths), np.array([END_ID], dtype="<u4").tobytes()
    for batch in batches:
        texts = strings(batch.column(1))
        for a, b in slices(texts):
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0)[a:b].to_pylist(), texts[a:b].to_pylist(), strict=True):
                ids = encode(text) + end
                n = len(ids) // 4
                first = n if n <= size else n % size or size
                begin = 0
                for k, stop in enumerate(range(first, n + 1, size)):
                    rows.append((doc, k, begin, stop - begin, zlib.crc32(ids[4 * begin : 4 * stop])))
                    begin = stop
            columns = list(zip(*rows, strict=True))
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])


def pieces(docs: DataFrame, paths: tuple[str, str | None] | None = None, size: int = SIZE) -> DataFrame:
    """``paths``: the vocabulary file, and the same vocabulary as ranks (None: without the faster encoder)."""
    if paths is None:
        import public_tokenizers

        paths = public_tokenizers.path(VOCABULARY), public_tokenizers.path(RANKS)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lambda it: pieces_of(it, paths, size), PIECES)


DEPTH, STEPS = 3, 300


def patterns(bins: np.ndarray, size: int, depth: int = DEPTH) -> np.ndarray:
    """All multisets of up to ``depth`` (at most 3) of the lengths ``bins`` that sum to ``size``; unused places are 0."""
    there = np.zeros(size + 1, dtype=bool)
    there[bins] = True
    out = [np.array([[size, 0, 0]])] if there[size] else []
    two = bins[(2 * bins >= size) & (bins < size)]
    two = two[there[size - two]]
    out.append(np.stack([two, size - two, np.zeros_like(two)], axis=1))
    if depth > 2:
        for first in bins[(3 * bins >= size) & (bins < size - 1)]:
            second = bins[(bins <= first) & (bins < size - first) & (2 * bins >= size - first)]
            second = second[there[size - first - second]]
            out.append(np.stack([np.full_like(second, first), second, size - first - second], axis=1))
    return np.concatenate(out)


def fit(histogram: np.ndarray, found: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """Non-negative repeat counts of patterns by accelerated projected gradient on the weighted least squares |A x - histogram|."""
    size = len(histogram) - 1
    weight = np.arange(size + 1) / size  # tokens, so long lengths count more
    weight[0] = 0
    goal = histogram * weight
    apply = lambda x: np.bincount(found.ravel(), np.repeat(x, found.shape[1]), size + 1) * weight
    back = lambda r: (r * weight)[found].sum(axis=1)
    norm, probe = 1.0, np.ones(len(found))
    for _ in range(12):  # the largest eigenvalue of A'A
        probe = back(apply(probe))
        norm = float(np.linalg.norm(probe)) or 1.0
        probe /= norm
    x = y = np.zeros(len(found))
    t = 1.0
    for _ in range(steps):
        new = np.maximum(0, y - back(apply(y) - goal) / (1.05 * norm))
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x


def plan_of(histogram: np.ndarray, size: int = SIZE, depth: int = DEPTH) -> tuple[np.ndarray, int]:
    """Runs (length, first rank, number, first sequence, offset), sorted by length and rank, and the number of sequences."""
    left = histogram.astype(np.int64).copy()
    left[0] = 0
    rank = np.zeros(size + 1, dtype=np.int64)
    runs: list[tuple[int, int, int, int, int]] = []
    sequences = 0

    def put(length: int, number: int, sequence: int, offset: int) -> None:
        runs.append((length, int(rank[length]), number, sequence, offset))
        rank[length] += number
        left[length] -= number

    bins = np.flatnonzero(left)
    if len(bins):
        found = patterns(bins, size, depth)
        counts = fit(left.astype(float), found) if len(found) else np.zeros(0)
        order = np.argsort(-counts, kind="stable")
        for k in order[counts[order] >= 0.5]:
            lengths = [int(v) for v in found[k] if v]
            often = min(int(round(counts[k])), *(int(left[v]) // lengths.count(v) for v in lengths))
            if often > 0:
                offset = 0
                for v in lengths:
                    put(v, often, sequences, offset)
                    offset += v
                sequences += often
    # best fit decreasing on the rest: open[r] has runs (first sequence, number) of sequences with room for r more tokens
    open_: dict[int, list[tuple[int, int]]] = {}
    for v in np.flatnonzero(left)[::-1].tolist():
        while left[v] > 0:
            room = min((r for r in open_ if r >= v), default=0)
            if room:
                first, number = open_[room].pop()
                if not open_[room]:
                    del open_[room]
                used = min(number, int(left[v]))
                if used < number:
                    open_.setdefault(room, []).append((first + used, number - used))
                put(v, used, first, size - room)
                rest = room - v
            else:
                each = size // v
                used = int(left[v]) // each
                if used:  # sequences of this length alone
                    first = sequences
                    for k in range(each):
                        put(v, used, first, k * v)
                    rest = size - each * v
                else:
                    first, used, rest = sequences, 1, size - v * int(left[v])
                    for k in range(int(left[v])):
                        put(v, 1, first, k * v)
                sequences += used
            if rest:
                open_.setdefault(rest, []).append((first, used))
    table_ = np.array(sorted(runs), dtype=np.int64).reshape(-1, 5)
    return table_, sequences


def place(rows: DataFrame, size: int = SIZE) -> DataFrame:
    """``rows`` (any columns, with ``length`` of 1 to ``size`` and the sort keys doc_id, piece) with sequence_id and offset."""
    spark = rows.sparkSession
    rows = materialise(rows)
    histogram = np.zeros(size + 1, dtype=np.int64)
    for r in rows.groupBy("length").count().collect():  # at most ``size`` rows
        histogram[r["length"]] = r["count"]
    runs, _ = plan_of(histogram, size)
    shared = spark.sparkContext.broadcast(runs)
    groups = 1 << max(0, (int(histogram.sum()) // 20_000).bit_length())
    salted = rows.select(F.struct(*rows.columns).alias("row"), "length", "doc_id", "piece", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(groups)).alias("group"))
    ahead = Window.partitionBy("length").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    base = salted.groupBy("length", "group").count().select("length", "group", F.coalesce(F.sum("count").over(ahead), F.lit(0)).alias("base"))
    ranked = salted.withColumn("inner", F.row_number().over(Window.partitionBy("length", "group").orderBy("doc_id", "piece")) - 1).join(base, ["length", "group"])
    ranked = ranked.select("row", F.col("length").cast("long").alias("length"), (F.col("base") + F.col("inner")).alias("rank"))

    @F.pandas_udf("sequence_id long, offset long")
    def look_up(length, rank):
        import pandas as pd

        plan = shared.value
        key = plan[:, 0] << 40 | plan[:, 1]  # ranks stay below 2**40
        at = np.searchsorted(key, length.to_numpy(np.int64) << 40 | rank.to_numpy(np.int64), side="right") - 1
        return pd.DataFrame({"sequence_id": plan[at, 3] + rank.to_numpy(np.int64) - plan[at, 1], "offset": plan[at, 4]})

    return ranked.select("row", look_up("length", "rank").alias("at")).select("row.*", "at.sequence_id", "at.offset")


def pack(docs: DataFrame, paths: tuple[str, str | None] | None = None, size: int = SIZE) -> DataFrame:
    return place(pieces(docs, paths, size), size).withColumn("length", F.col("length").cast("long"))


def op5_pattern_packing(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
