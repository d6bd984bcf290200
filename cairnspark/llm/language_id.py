"""Language ID: an interpolated Kneser-Ney character model per language, in sorted hash arrays shared by all languages.

A text is the sequence of its words that have a letter, in lower case, each with a blank before (context only) and after.
The model of order ORDER gives every language the log probability of those characters; the lowest cross-entropy per
character wins.  Learning uses a bounded sample of labelled documents (DOCS_A_LANGUAGE whole ones, chosen by a hash of id and
text); prediction reads every text whole and nothing but the text.

Rejection is calibrated on the sample: a fifth of it isn't learned from, and a document is rejected when its
cross-entropy is above CEILING times the largest that such a document of the same language has, with an allowance for
short texts (and when it has no letter).

Defined results: a null text or one without letters is ``und`` with score 0, rejected; with no labelled document at all,
every text is; ties go to the first language by code point; documents with a null lang aren't learned from, rows with a
null id are; rows equal in id and text are learned from once; an empty table gives an empty result; a null id is held out
or not as the empty text is; extra columns are carried by :func:`keep_identified`.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import crc_mod, id_key, mix, slices, strings, table, text_key, words_of

ORDER, DOCS_A_LANGUAGE, CEILING = 5, 400, 1.5
#: A text of so many characters may have twice the cross-entropy before it is rejected.
SHORT = 32
UNKNOWN = "und"
#: Probability of a character that no language has seen: one of so many.
ALPHABET = 1 << 16
MOST_CACHED = 400_000
RESULT = "doc_id long, lang_pred string, score double, cross_entropy double, rejected boolean"


def coded(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the words, each between blanks, and the place of each in its word."""
    text = " " + "  ".join(words) + " "
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 2
    begins = np.cumsum(lengths) - lengths
    return points, np.arange(len(points)) - np.repeat(begins, lengths)


def keys_of(points: np.ndarray, place: np.ndarray, order: int) -> list[np.ndarray]:
    """For n = 1 to ``order``, the hash of the n characters that end at each position (0 where the word has fewer before it)."""
    out = [mix(points.astype(np.uint64) + np.uint64(1))]
    for n in range(2, order + 1):
        before = np.concatenate((np.zeros(1, np.uint64), out[-1][:-1]))
        out.append(np.where(place >= n - 1, mix(before * np.uint64(0x9E3779B97F4A7C15) + points.astype(np.uint64) + np.uint64(n)), np.uint64(0)))
    return out


def counted(keys: np.ndarray, weight: np.ndarray, *more: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys, their summed weights, and one value of each further array."""
    unique, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
    return unique, np.bincount(inverse, weight, len(unique)), *(m[first] for m in more)


def learned(words: Counter[str], order: int) -> list[tuple[np.ndarray, ...]]:
    """For each n: sorted hashes of the n-grams seen, their probability, and the weight that they, as contexts, leave to shorter ones."""
    names = list(words)
    points, place = coded(names)
    often = np.repeat(np.fromiter(words.values(), dtype=float, count=len(names)), np.fromiter(map(len, names), dtype=np.int64, count=len(names)) + 2)
    keys = keys_of(points, place, order)
    tables: list[dict[str, np.ndarray]] = []
    for n in range(1, order + 1):
        at = place >= max(1, n - 1)  # the blank before a word is never predicted
        raw = at if n == order else at & (place == n - 1)
        key, count = keys[n - 1][raw], often[raw]
        context = np.concatenate((np.zeros(1, np.uint64), keys[n - 2][:-1]))[raw] if n > 1 else np.zeros(raw.sum(), np.uint64)
        if n < order:  # elsewhere a shorter n-gram counts once for each character seen before it
            longer = place >= n
            _, first = np.unique(keys[n][longer], return_index=True)
            where = np.flatnonzero(longer)[first]
            key = np.concatenate((key, keys[n - 1][where]))
            count = np.concatenate((count, np.ones(len(where))))
            context = np.concatenate((context, keys[n - 2][where - 1] if n > 1 else np.zeros(len(where), np.uint64)))
        key, count, context = counted(key, count, context)
        once, twice = (count == 1).sum(), (count == 2).sum()
        discount = once / (once + 2 * twice) if once and twice else 0.5
        held, total, kinds = (lambda c, i: (c, np.bincount(i, count), np.bincount(i)))(*np.unique(context, return_inverse=True))
        place_of = np.searchsorted(held, context)
        own = np.maximum(count - discount, 0) / total[place_of]
        left = discount * kinds / total
        if n == 1:
            probability = own + left[place_of] / ALPHABET
            floor = left[0] / ALPHABET if len(left) else 1 / ALPHABET
        else:  # the suffix of a seen n-gram is a seen (n-1)-gram
            lower = tables[-1]
            shorter = np.zeros(len(key), np.uint64)
            full = place >= n - 1
            _, first = np.unique(keys[n - 1][full], return_index=True)
            where = np.flatnonzero(full)[first]
            shorter[np.searchsorted(key, keys[n - 1][where][np.isin(keys[n - 1][where], key)])] = keys[n - 2][where][np.isin(keys[n - 1][where], key)]
            i = np.minimum(np.searchsorted(lower["key"], shorter), len(lower["key"]) - 1)
            probability = own + left[place_of] * np.where(lower["key"][i] == shorter, lower["probability"][i], floor)
        tables.append({"key": key, "probability": probability, "context": held, "left": left})
    return [(t["key"], t["probability"], t["context"], t["left"]) for t in tables] + [(np.array([floor]),)]


@dataclass
class Model:
    """``keys[n]``: sorted hashes of n-grams of any language; ``probability[n]``: a column per language, NaN where unseen; ``left[n]``: what the n-gram as a context leaves to shorter ones, 1 where unseen."""

    languages: list[str]
    keys: list[np.ndarray]
    probability: list[np.ndarray]
    left: list[np.ndarray]
    floor: np.ndarray
    ceiling: np.ndarray

    @classmethod
    def fit(cls, texts: dict[str, list[str]], order: int = ORDER) -> Model:
        languages = sorted(texts, key=lambda x: [ord(c) for c in x])
        parts, aside = [], []
        for name in languages:
            own = texts[name]
            later = own[::5] if len(own) >= 5 else own
            learn = [x for k, x in enumerate(own) if k % 5] if len(own) >= 5 else own
            words = Counter(w for x in learn for w in x.lower().split() if any(map(str.isalpha, w)))
            parts.append(learned(words or Counter({"a": 1}), order))
            aside.append(later)
        keys, probability, left = [], [], []
        for n in range(order):
            every = np.unique(np.concatenate([np.concatenate((p[n][0], p[n + 1][2] if n + 1 < order else p[n][0][:0])) for p in parts])) if parts else np.zeros(0, np.uint64)
            prob, rest = np.full((len(every), len(parts)), np.nan, np.float32), np.ones((len(every), len(parts)), np.float32)
            for j, p in enumerate(parts):
                prob[np.searchsorted(every, p[n][0]), j] = p[n][1]
                if n + 1 < order:
                    rest[np.searchsorted(every, p[n + 1][2]), j] = p[n + 1][3]
            keys.append(every)
            probability.append(prob)
            left.append(rest)
        out = cls(languages, keys, probability, left, np.array([p[order][0][0] for p in parts], dtype=np.float32), np.full(len(parts), np.inf))
        for j, later in enumerate(aside):
            bits, length, _ = out.measure(pa.array(later, pa.large_string()), {})
            own = (bits[:, j] / np.maximum(length, 1))[length > 0]
            if len(own):
                out.ceiling[j] = own.max() * CEILING
        return out

    def costs(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Bits of each character of the words, between blanks, in each language, and the places of the characters."""
        points, place = coded(words)
        keys = keys_of(points, place, len(self.keys))
        value = np.broadcast_to(self.floor, (len(points), len(self.languages))).copy()
        at = None
        for n, (known, probability, left) in enumerate(zip(self.keys, self.probability, self.left, strict=True)):
            if n and len(self.keys[n - 1]):
                before, hit = np.concatenate(([0], at[0][:-1])), np.concatenate(([False], at[1][:-1])) & (place >= max(n, 1))
                value[hit] *= self.left[n - 1][before[hit]]
            i = np.minimum(np.searchsorted(known, keys[n]), max(len(known) - 1, 0))
            hit = (known[i] == keys[n]) & (place >= n) if len(known) else np.zeros(len(points), bool)
            seen = probability[i[hit]]
            value[hit] = np.where(np.isnan(seen), value[hit], seen)
            at = (i, hit)
        cost = -np.log2(value)
        cost[place == 0] = 0
        return cost, place

    def bits(self, words: list[str]) -> np.ndarray:
        """Bits of each word in each language."""
        cost, place = self.costs(words)
        return np.add.reduceat(cost, np.flatnonzero(place == 0), axis=0)

    def measure(self, texts: pa.Array, cache: dict[str, int], rows: list | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each text: bits in each language, characters predicted, and whether it has a letter."""
        rows = [] if rows is None else rows
        ends, coded_words = words_of(texts)
        lowered = [w.lower() for w in coded_words.dictionary.to_pylist()]
        if len(cache) > MOST_CACHED:
            cache.clear()
            rows.clear()
        new = [w for w in dict.fromkeys(lowered) if w not in cache]
        if new:
            worth = np.fromiter((any(map(str.isalpha, w)) for w in new), bool, len(new))
            block = np.zeros((len(new), len(self.languages) + 1), np.float32)
            good = [w for w, k in zip(new, worth, strict=True) if k]
            for a in range(0, len(good), 50_000):
                block[np.flatnonzero(worth)[a : a + 50_000], :-1] = self.bits(good[a : a + 50_000])
            block[worth, -1] = [len(w) + 1 for w in good]
            begin = sum(map(len, rows))
            cache.update(zip(new, range(begin, begin + len(new)), strict=True))
            rows.append(block)
        if len(rows) > 1:
            rows[:] = [np.concatenate(rows)]
        every = np.asarray(coded_words.indices)
        row_of = np.fromiter(map(cache.__getitem__, lowered), np.int64, len(lowered))
        sums = np.zeros((len(texts), len(self.languages) + 1))
        filled = np.flatnonzero(np.diff(ends) > 0)
        if len(filled):
            per_word = rows[0][row_of]
            for j in range(per_word.shape[1]):
                sums[filled, j] = np.add.reduceat(per_word[:, j][every].astype(np.float64), ends[filled])
        return sums[:, :-1], sums[:, -1], sums[:, -1] > 0


def sample(docs: DataFrame, learnable, docs_a_language: int = DOCS_A_LANGUAGE) -> dict[str, list[str]]:
    """At most ``docs_a_language`` distinct whole texts of each language, those with the smallest hash of id and text."""
    own = F.xxhash64(F.lit(7), id_key(), text_key())
    rows = docs.where(learnable & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text", own.alias("key"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.approx_count_distinct("key").alias("n")).collect()}  # a row per language
    if not counts:
        return {}
    # first a share of each language that holds enough of its rows all but surely, so that no task sorts a whole language
    span = float(2**64)
    bound = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, 4.0 * docs_a_language / max(n, 1)) * span - span / 2)])
    few = rows.where(F.col("key").cast("double") <= bound[F.col("lang")]).select("lang", "key").distinct()
    ranked = few.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("key"))).where(F.col("k") <= docs_a_language).select("lang", "key")
    found: dict[str, list[tuple[int, str]]] = {}
    for r in rows.join(F.broadcast(ranked), ["lang", "key"]).dropDuplicates(["lang", "key"]).collect():  # at most docs_a_language for each language
        found.setdefault(r["lang"], []).append((r["key"], r["text"]))
    return {lang: [t for _, t in sorted(x)] for lang, x in found.items()}


def predicted(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    model, cache, rows = shared.value, {}, []
    for batch in batches:
        texts = strings(batch.column(1))
        for a, b in slices(texts):
            bits, length, lettered = model.measure(texts[a:b], cache, rows)
            lettered = lettered & (len(model.languages) > 0)
            rate = bits / np.maximum(length, 1)[:, None]
            best = rate.argmin(axis=1) if len(model.languages) else np.zeros(b - a, int)
            lowest = rate[np.arange(b - a), best] if len(model.languages) else np.zeros(b - a)
            score = np.where(lettered, np.minimum(1.0, 1 / np.exp2(-np.clip(bits - (lowest * np.maximum(length, 1))[:, None], 0, 1000)).sum(axis=1)) if len(model.languages) else 0, 0)
            names = [model.languages[k] if ok else UNKNOWN for k, ok in zip(best, lettered, strict=True)]
            # short texts vary more
            over = ~lettered | (lowest > model.ceiling[best] * (1 + SHORT / np.maximum(length, 1)) if len(model.languages) else True)
            yield pa.record_batch([batch.column(0)[a:b], pa.array(names, pa.string()), pa.array(score, pa.float64()), pa.array(np.where(lettered, lowest, 0.0), pa.float64()), pa.array(over, pa.bool_())], names=["doc_id", "lang_pred", "score", "cross_entropy", "rejected"])


def fit(docs: DataFrame, learnable=None) -> Model:
    return Model.fit(sample(docs, F.lit(True) if learnable is None else learnable))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, cross_entropy (bits a character), rejected: one row per document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lambda it: predicted(it, shared), RESULT)


def keep_identified(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` without the documents that :func:`predict` rejects; all columns are carried."""
    shared, text = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs(held: list) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not len(batch):
                    continue
                held.append(batch)
                yield pa.record_batch([pa.nulls(len(batch), pa.int64()), batch.column(text)], names=["doc_id", "text"])

        held: list[pa.RecordBatch] = []
        marks: list[np.ndarray] = []
        for out in predicted(pairs(held), shared):
            marks.append(~np.asarray(out.column(4)))
            if sum(map(len, marks)) == len(held[0]):
                yield held.pop(0).filter(pa.array(np.concatenate(marks)))
                marks.clear()

    return docs.mapInArrow(kept, docs.schema)


def op7_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = predict(docs, fit(docs, crc_mod("doc_id", 3) != 1))
    return out.select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")
