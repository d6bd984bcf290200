"""LM scoring: a trigram model in Elias-Fano tries, trained on all training documents and applied to every document.

Tokens are words, A-Z lower-cased, and an end after each text; the history of a text's first word is two ends.  The model
is p(w | u v) = a3 + b3 (a2 + b2 p1): a of the n-gram is its discounted share of its context's count, b what the context
leaves to the lower order, the mass of pruned n-grams included, and p1 the word's share of all training tokens and one.
N-grams are over all training words; those seen less than LEAST times are pruned, the same at every size.  Words that
aren't in the training documents are one event, which has the share that discounting single words frees, and that one
token.  The first FREQUENT words aren't discounted: by powers of two of their counts, then by hash.

How it scales: text is cut into chunks (one row each) of CHUNK bytes at most with a vocabulary of their own.  Words and
n-grams are counted chunk by chunk in numpy and meet, as sorted blobs, in ranges of their hash or key.  Ranges of words
return to every chunk the exact count and the number of its words.  Each range of n-grams becomes a trie in a mapped file
of the task's own, which is asked for all n-grams that the chunks have in that range, held-out ones too, and the answers
go back to the chunks.  So neither words nor tries are broadcast, and both grow with the corpus; the driver has some
numbers for each range.  Ranges of pairs cut contexts: a context's count is its word's, and what it leaves is summed over
the ranges.  Ranges of triples don't.

Defined results: a null text is the end alone; rows with equal doc_id are scored each on its own; a null id is trained on
or not as the empty text is; without training documents all tokens are unknown and share one event of probability 1; an
empty table gives an empty result; extra columns aren't read.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, hash_words, materialise, slices, strings, table, words_of
from .elias_fano import LEVELS, Trie, quantised

CHUNK, FREQUENT, LEAST, DISCOUNT = 8 << 20, 8190, 2, 0.75
END_HASH = np.int64(0x7EDC0FFEE0DDF00D)
#: Words of a range, about, and half the n-grams of one.
RANGE = 1_000_000
#: Words are numbered by classes of their counts (by powers of two), frequent ones first.
CLASSES = 64
LOW = (1 << 32) - 1
CHUNKS = "doc_ids array<bigint>, held binary, lengths binary, n long, tokens binary, words binary, counts binary"
BLOBS = "range int, chunk long, keys binary, counts binary"
WORDS = "range int, chunk long, n int, answer binary, classes binary, tokens long, twice long"
GRAMS = "range int, chunk long, n int, grams binary, edges array<bigint>"
ANSWERS = "range int, chunk long, n int, answer binary, contexts array<bigint>, kept array<double>"


def blob(x: np.ndarray, kind: str) -> bytes:
    return np.ascontiguousarray(x, dtype=kind).tobytes()


def numbers(value, kind: str) -> np.ndarray:
    return np.frombuffer(value.as_buffer(), dtype=kind)


def packed(columns: list[np.ndarray], kind: str = "<u4") -> bytes:
    """Columns of equal length, compressed byte plane by byte plane."""
    planes = [np.ascontiguousarray(c, dtype=kind).view(np.uint8).reshape(len(c), -1).T.tobytes() for c in columns]
    return pa.compress(b"".join(planes), codec="zstd", asbytes=True)


def unpacked(data: bytes, n: int, columns: int, kind: str = "<u4") -> list[np.ndarray]:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(data, decompressed_size=n * columns * size, codec="zstd", asbytes=True), np.uint8).reshape(columns, size, n)
    return [np.ascontiguousarray(x.T).view(kind).ravel() for x in planes]


def chunks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = strings(batch.column(1))
        for a, b in slices(texts, CHUNK):
            ends, coded = words_of(pc.ascii_lower(texts[a:b]))
            words = hash_words(coded.dictionary).view(np.int64)
            words, code = np.unique(np.append(words, END_HASH), return_inverse=True)
            lengths = np.diff(ends) + 1
            tokens = np.full(int(lengths.sum()), code[-1], dtype=np.uint32)
            last = np.zeros(len(tokens), dtype=bool)
            last[np.cumsum(lengths) - 1] = True
            tokens[~last] = code[:-1][np.asarray(coded.indices)]
            held = np.asarray(batch.column(2)[a:b]).astype(np.uint8)
            learned = tokens[np.repeat(held == 0, lengths)]
            counts = np.bincount(learned, minlength=len(words))
            yield pa.record_batch([pa.array([batch.column(0)[a:b].to_pylist()], pa.list_(pa.int64())), *(pa.array([x], pa.binary()) for x in (blob(held, "u1"), blob(lengths, "<i8"))), pa.array([len(tokens)], pa.int64()), *(pa.array([x], pa.binary()) for x in (packed([tokens]), blob(words, "<i8"), blob(counts, "<u4")))], names=["doc_ids", "held", "lengths", "n", "tokens", "words", "counts"])


def range_of(words: np.ndarray, bits: int) -> np.ndarray:
    return (words >> (64 - bits)) + (1 << (bits - 1)) if bits else np.zeros(len(words), np.int64)


def word_blobs(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for chunk, words, counts in zip(*(batch.column(k) for k in range(3)), strict=True):
            w, c = numbers(words, "<i8"), numbers(counts, "<u4")
            cut = np.searchsorted(range_of(w, bits), np.arange((1 << bits) + 1))
            parts = [(r, chunk.as_py(), blob(w[a:b], "<i8"), blob(c[a:b], "<u4")) for r, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if a < b]
            yield rows(parts, (pa.int32(), pa.int64(), pa.binary(), pa.binary()), ["range", "chunk", "keys", "counts"])


def rows(parts: list[tuple], types: tuple, names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*parts, strict=True)) if parts else [[]] * len(names)
    return pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)


def added(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key, count = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key, kind="stable")
    key, count = key[order], count[order].astype(np.int64)
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    return key[first], np.add.reduceat(count, first) if len(first) else count


def classes_of(totals: np.ndarray) -> np.ndarray:
    return np.maximum(np.frexp(totals.astype(np.float64))[1] - 1, 0)


def counted_words(group: pa.Table) -> pa.Table:
    """Of one range: a row with each chunk's counts over all chunks and numbers within their classes, and a summary row (chunk null)."""
    words = [numbers(v, "<i8") for v in group.column("keys")]
    every, total = added(words, [numbers(v, "<u4") for v in group.column("counts")])
    r, seen = group.column("range")[0].as_py(), np.flatnonzero(total > 0)
    kind = classes_of(total[seen])
    by, sizes = np.argsort(kind, kind="stable"), np.bincount(kind, minlength=CLASSES)
    number = np.zeros(len(every), dtype=np.int64)
    number[seen[by]] = np.arange(len(seen)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out = []
    for chunk, w in zip(group.column("chunk").to_pylist(), words, strict=True):
        at = np.searchsorted(every, w)
        out.append((r, chunk, len(w), packed([total[at] & LOW, total[at] >> 32, number[at]]), None, 0, 0))
    out.append((r, None, 0, None, blob(sizes, "<i8"), int(total.sum()), int((total == 2).sum())))
    return pa.Table.from_batches([rows(out, (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64()), ["range", "chunk", "n", "answer", "classes", "tokens", "twice"])])


@dataclass
class Unigrams:
    """Facts about words, some for each range of them."""

    base: dict[int, np.ndarray]  # of each range, the first id of each class
    n: int
    v: int
    discount: float

    @classmethod
    def of(cls, summary: list) -> Unigrams:
        summary = sorted(summary, key=lambda r: r.range)
        sizes = np.array([np.frombuffer(r.classes, "<i8") for r in summary]).reshape(-1, CLASSES)[:, ::-1]  # the most frequent class first
        first = (np.cumsum(sizes.T.ravel()) - sizes.T.ravel()).reshape(CLASSES, -1).T[:, ::-1]
        v = int(sizes.sum())
        if v >= LOW >> 1:
            raise ValueError(f"{v} distinct words; ids have 31 bits")
        once, twice = int(sizes[:, -1].sum()), sum(r.twice for r in summary)
        discount = once / (once + 2 * twice) if once and twice else 0.5
        return cls({r.range: x for r, x in zip(summary, first, strict=True)}, sum(r.tokens for r in summary), v, discount)

    def shares(self, counts: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """p1 of words."""
        free = self.discount * max(0, self.v - FREQUENT) + 1
        return np.where(counts > 0, counts - np.where(ids < FREQUENT, 0, self.discount), free) / (self.n + 1)

    def known(self, answers: list[dict]) -> tuple[np.ndarray, np.ndarray]:
        """Training counts and ids of a chunk's words; words without training counts share the id v."""
        counts, ids = [], []
        for r in sorted(answers, key=lambda r: r["range"]):
            low, high, number = (x.astype(np.int64) for x in unpacked(r["answer"], r["n"], 3))
            total = high << 32 | low
            counts.append(total)
            ids.append(np.where(total > 0, self.base[r["range"]][classes_of(total)] + number, self.v))
        return np.concatenate(counts), np.concatenate(ids)


@dataclass
class Grams:
    """Distinct n-grams of one order, ascending: the context (of triples, two words of 32 bits) and the word; which of them ends at each token."""

    context: np.ndarray
    word: np.ndarray
    at: np.ndarray

    def keys(self, order: int) -> np.ndarray:
        """What ranges are cut by: pairs themselves, contexts of triples."""
        return self.context << 32 | self.word if order == 2 else self.context


def grams(ids: np.ndarray, tokens: np.ndarray, lengths: np.ndarray) -> list[Grams]:
    """Pairs and triples of a chunk; before a text are ends, and the last token is one."""
    own, rank = np.unique(ids, return_inverse=True)
    t = rank[tokens]
    place = np.arange(len(t)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    one, two = np.full(len(t), t[-1]), np.full(len(t), t[-1])
    one[1:], two[2:] = t[:-1], t[:-2]
    one[place < 1] = t[-1]
    two[place < 2] = t[-1]
    pair, pair_at = np.unique(one << 32 | t, return_inverse=True)
    context, context_at = np.unique(two << 32 | one, return_inverse=True)
    triple, triple_at = np.unique(context_at << 32 | t, return_inverse=True)
    context = (own[context >> 32] << 32 | own[context & LOW])[triple >> 32]
    return [Grams(own[pair >> 32], own[pair & LOW], pair_at), Grams(context, own[triple & LOW], triple_at)]


def folded(x: np.ndarray, fresh: np.ndarray) -> np.ndarray:
    """Steps from each value to the next, values themselves where ``fresh``."""
    return np.where(fresh, x, np.diff(x, prepend=0))


def unfolded(steps: np.ndarray, fresh: np.ndarray) -> np.ndarray:
    total, start = np.cumsum(steps), np.flatnonzero(fresh)
    return total - np.repeat(total[start] - steps[start], np.diff(np.append(start, len(steps))))


def packed_grams(context: np.ndarray, word: np.ndarray, count: np.ndarray) -> bytes:
    head = np.arange(len(context)) < 1
    high = folded(context >> 32, head)
    low = folded(context & LOW, head | (high != 0))
    return packed([high, low, folded(word, head | (high != 0) | (low != 0)), count])


def unpacked_grams(data: bytes, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    high, low, word, count = (x.astype(np.int64) for x in unpacked(data, n, 4))
    head = np.arange(n) < 1
    context = unfolded(high, head) << 32 | unfolded(low, head | (high != 0))
    return context, unfolded(word, head | (high != 0) | (low != 0)), count


def gram_blobs(batches: Iterator[pa.RecordBatch], shared, cuts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Training counts of all pairs (ranges -1, -2, ...) and triples (ranges 0, 1, ...) of each chunk; with pairs, the first and last context and their counts."""
    for batch in batches:
        for chunk, held, lengths, n, tokens, answers in zip(*(batch.column(k) for k in range(6)), strict=True):
            counts, ids = shared.value.known(answers.as_py())
            lengths, tokens = numbers(lengths, "<i8"), unpacked(tokens.as_py(), n.as_py(), 1)[0]
            learned = np.repeat(numbers(held, "u1") == 0, lengths)
            there, first = np.unique(ids, return_index=True)
            parts = []
            for order, cut, g in zip((2, 3), cuts, grams(ids, tokens, lengths), strict=True):
                count = np.bincount(g.at[learned], minlength=len(g.word))
                at = np.concatenate(([0], np.searchsorted(g.keys(order), cut), [len(g.word)]))
                for r, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
                    if a < b:
                        ends = g.context[[a, b - 1]] if order == 2 else np.zeros(0, np.int64)
                        edges = np.concatenate((ends, counts[first[np.searchsorted(there, ends)]])).tolist()
                        parts.append((r if order == 3 else -1 - r, chunk.as_py(), b - a, packed_grams(g.context[a:b], g.word[a:b], count[a:b]), edges))
            yield rows(parts, (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int64())), ["range", "chunk", "n", "grams", "edges"])


def mapped(trie: Trie) -> Trie:
    """The trie from a file of this task's that has no name, mapped into memory."""
    file = tempfile.TemporaryFile()  # noqa: SIM115
    file.write(trie.dump())
    file.flush()
    return Trie.load(np.memmap(file, dtype=np.uint8, mode="r"))


def answered(group: pa.Table, universe: int) -> pa.Table:
    """Of one range: what its trie says of each chunk's n-grams, a row for each; of pairs, a row (chunk null) with what is kept of the first and last context here."""
    r, sizes = group.column("range")[0].as_py(), group.column("n").to_pylist()
    context, word, count = (np.concatenate(x) for x in zip(*(unpacked_grams(v.as_py(), n) for v, n in zip(group.column("grams"), sizes, strict=True)), strict=True))
    order = np.lexsort((word, context))
    context, word, count = context[order], word[order], count[order]
    new = np.append(True, (context[1:] != context[:-1]) | (word[1:] != word[:-1]))
    at = np.empty(len(order), dtype=np.int64)
    at[order] = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    context, word, count = context[first], word[first], np.add.reduceat(count, first)
    contexts, of = np.unique(context, return_inverse=True)
    total = np.bincount(of, count)
    edges = {c: k for e in group.column("edges").to_pylist() if e for c, k in zip(e[:2], e[2:], strict=True)}
    if edges:  # contexts that other ranges may have too
        total[0], total[-1] = edges[int(contexts[0])], edges[int(contexts[-1])]
    columns = [context, word] if r < 0 else [context >> 32, context & LOW, word]
    keep = np.flatnonzero(count >= LEAST)
    share = (count[keep] - DISCOUNT) / total[of[keep]]
    kept = np.bincount(of[keep], LEVELS[quantised(share)], len(contexts))
    there = np.bincount(of[keep], minlength=len(contexts)) > 0
    leaf, node = np.full((2, len(word)), -1)
    a, b = np.zeros(1, np.uint8), np.zeros(1, np.uint8)
    if len(keep):
        trie = mapped(Trie.of_words([x[keep] for x in columns], universe, share, 1 - kept[there]))
        leaf, node = trie.find(columns)
        a, b = trie.probability, trie.left
    seen, a, b = leaf >= 0, np.where(leaf >= 0, a[leaf], 0), np.where(node >= 0, b[node], 0)  # level 0 is all
    out, begin = [], 0
    for chunk, n in zip(group.column("chunk").to_pylist(), sizes, strict=True):
        own = at[begin : begin + n]
        out.append((r, chunk, n, packed([seen[own], a[own], b[own]], "u1"), None, None))
        begin += n
    if edges:
        ends = sorted({0, len(contexts) - 1})
        out.append((r, None, 0, None, contexts[ends].tolist(), kept[ends].tolist()))
    return pa.Table.from_batches([rows(out, (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.float64())), ["range", "chunk", "n", "answer", "contexts", "kept"])])


def left_of(summary: list) -> tuple[np.ndarray, np.ndarray]:
    """Contexts of pairs that several ranges have, ascending, and what they leave to single words."""
    kept: dict[int, list[float]] = {}
    for r in sorted(summary, key=lambda r: -r.range):
        for context, share in zip(r.contexts, r.kept, strict=True):
            kept.setdefault(context, []).append(share)
    several = sorted(c for c, x in kept.items() if len(x) > 1)
    return np.array(several, dtype=np.int64), LEVELS[quantised(np.array([1 - sum(kept[c]) for c in several]))]


def scored(batches: Iterator[pa.RecordBatch], shared, left: tuple[np.ndarray, np.ndarray]) -> Iterator[pa.RecordBatch]:
    u = shared.value
    for batch in batches:
        for docs, held, lengths, n, tokens, answers, found in zip(*(batch.column(k) for k in range(7)), strict=True):
            counts, ids = u.known(answers.as_py())
            lengths, tokens = numbers(lengths, "<i8"), unpacked(tokens.as_py(), n.as_py(), 1)[0]
            p = u.shares(counts, ids)[tokens]
            found = sorted(found.as_py(), key=lambda r: (r["range"] >= 0, abs(r["range"])))
            for order, g in zip((2, 3), grams(ids, tokens, lengths), strict=True):
                seen, a, b = (np.concatenate(x) for x in zip(*(unpacked(r["answer"], r["n"], 3, "u1") for r in found if (r["range"] < 0) == (order == 2)), strict=True))
                a, b = np.where(seen > 0, LEVELS[a], 0.0), LEVELS[b]
                if order == 2 and len(left[0]):
                    at = np.minimum(np.searchsorted(left[0], g.context), len(left[0]) - 1)
                    b = np.where(left[0][at] == g.context, left[1][at], b)
                p = a[g.at] + b[g.at] * p
            base = np.log10((counts + 0.5) / (u.n + 0.5 * (u.v + 1)))[tokens]
            begins = np.cumsum(lengths) - lengths
            known = np.add.reduceat((counts > 0)[tokens].astype(np.int64), begins)
            yield pa.record_batch([pa.array(docs.as_py(), pa.int64()), pa.array(numbers(held, "u1") == 1), pa.array(lengths), pa.array(known), pa.array(np.full(len(lengths), u.n)), pa.array(np.add.reduceat(base, begins)), pa.array(np.add.reduceat(np.log10(p), begins))], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])


def split_points(chunks: DataFrame, told: DataFrame, shared, n_entries: int) -> list[np.ndarray]:
    """Keys that cut pairs and triples, these at context borders, into ranges of about 2 RANGE entries: quantiles of the keys of a few chunks.  They shape tasks, not results."""
    ranges = max(1, n_entries // (2 * RANGE))
    if ranges == 1:
        return [np.zeros(0, np.int64), np.zeros(0, np.int64)]

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lengths, n, tokens, answers in zip(*(batch.column(k) for k in range(4)), strict=True):
                own = grams(shared.value.known(answers.as_py())[1], unpacked(tokens.as_py(), n.as_py(), 1)[0], numbers(lengths, "<i8"))
                yield rows([tuple(blob(g.keys(o)[::64], "<i8") for o, g in zip((2, 3), own, strict=True))], (pa.binary(), pa.binary()), ["pairs", "triples"])

    few = [r.chunk for r in chunks.select("chunk").orderBy(F.xxhash64("chunk")).limit(8).collect()]
    wanted = F.col("chunk").isin(few)
    found = chunks.where(wanted).join(told.where(wanted), "chunk").select("lengths", "n", "tokens", "answers").mapInArrow(sampled, "pairs binary, triples binary").collect()
    cuts = []
    for order in ("pairs", "triples"):
        keys = np.sort(np.concatenate([np.frombuffer(r[order], "<i8") for r in found]))
        cuts.append(np.unique(keys[np.linspace(0, len(keys) - 1, ranges + 1).astype(int)[1:-1]]))
    return cuts


def score(docs: DataFrame, held_out) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; learns from the documents where ``held_out`` is false."""
    spark = docs.sparkSession
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held_out.alias("held"))
    chunks = materialise(own.mapInArrow(chunks_of, CHUNKS).withColumn("chunk", F.monotonically_increasing_id()))
    size = chunks.agg(F.coalesce(F.sum(F.octet_length("words") / 8), F.lit(0)).cast("long").alias("words"), F.coalesce(F.sum("n"), F.lit(0)).alias("tokens")).first()
    bits = max(0, (size.words // RANGE).bit_length())
    counted = materialise(chunks.select("chunk", "words", "counts").mapInArrow(lambda it: word_blobs(it, bits), BLOBS).groupBy("range").applyInArrow(counted_words, WORDS))
    unigrams = Unigrams.of(counted.where("chunk IS NULL").select("range", "classes", "tokens", "twice").collect())  # a row for each range
    shared, universe = spark.sparkContext.broadcast(unigrams), unigrams.v + 1
    told = counted.where("chunk IS NOT NULL").groupBy("chunk").agg(F.collect_list(F.struct("range", "n", "answer")).alias("answers"))
    cuts = split_points(chunks, told, shared, size.tokens)
    numbered = chunks.select("chunk", "doc_ids", "held", "lengths", "n", "tokens").join(told, "chunk")
    blobs = numbered.select("chunk", "held", "lengths", "n", "tokens", "answers").mapInArrow(lambda it: gram_blobs(it, shared, cuts), GRAMS)
    found = materialise(blobs.groupBy("range").applyInArrow(lambda g: answered(g, universe), ANSWERS))
    left = left_of(found.where("chunk IS NULL").select("range", "contexts", "kept").collect())  # two contexts for each range
    by_chunk = found.where("chunk IS NOT NULL").groupBy("chunk").agg(F.collect_list(F.struct("range", "n", "answer")).alias("found"))
    joined = numbered.join(by_chunk, "chunk").select("doc_ids", "held", "lengths", "n", "tokens", "answers", "found")
    return joined.mapInArrow(lambda it: scored(it, shared, left), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op2_lm_score(spark, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), crc_mod("doc_id", 5) == 1)
