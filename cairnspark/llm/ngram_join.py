"""N-gram Jaccard join: documents whose sets of five-word shingles have a Jaccard coefficient of 0.8 or more.

Documents with the same set are one node.  A set's tokens are ordered by rarity, by exact counts
of all sets (tokens meet in ranges of their hash, and only those of several sets come back), and candidates come from its
prefix, the tokens of which no similar set can miss all.  Rare tokens are indexed singly.  Common ones are indexed in pairs: they fall
into subclasses by a hash, the prefix is extended until the tokens beyond the first of each subclass outnumber those that
a similar set may miss, and then two similar sets share two tokens of one subclass in their prefixes.  The number of
subclasses follows the set's size (one per SUBCLASS tokens, by size band), so the pairs are as many as the tokens; a set
also joins the family of the next band, where the larger sets are.  Sets below SMALL tokens index common tokens singly.

Candidates are verified pair by pair, as :mod:`links` says.

Defined results: a null text or one without words has an empty set and no links; fewer than five words are one shingle;
rows with equal doc_id are nodes by their own texts; a null id is the component_id only of its own row without links; an
empty table gives an empty result; extra columns aren't read, and :func:`keep_one` carries them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnspark.operators.components import ONE_TASK

from . import links
from .common import hash_words, id_key, materialise, mix, only, slices, strings, table, text_key, words_of
from .groups import beside, numbers

WORDS, SUBCLASS, SMALL = 5, 16, 16
ODD = np.uint64(0x9E3779B97F4A7C15)
#: From how many sets on a token is common, and how many bytes of text have about the tokens that a task counts.
COMMON, RANGE_BYTES = 512, 8 << 20
#: Bytes of text that a task reads at a time.
SLICE = 2 << 20


def shingle_sets(texts: pa.Array, words: int = WORDS) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    ends, coded = words_of(pc.ascii_lower(texts))
    word = hash_words(coded.dictionary)[np.asarray(coded.indices)] if len(coded) else np.zeros(0, np.uint64)
    run = np.zeros(max(0, len(word) - words + 1), dtype=np.uint64)
    for j in range(words):
        run = mix(run * ODD + word[j : j + len(run)] + np.uint64(j))
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        if b - a >= words:
            own = np.sort(run[a : b - words + 1])
            yield own[np.append(True, own[1:] != own[:-1])]
        elif b > a:
            h = np.array([b - a], dtype=np.uint64)
            for w in word[a:b]:
                h = mix(h * ODD + w)
            yield h
        else:
            yield np.zeros(0, np.uint64)


def node_of(tokens: np.ndarray) -> int:
    """The set's own 64-bit hash, signed."""
    return int(mix(np.array([mix(tokens).sum(dtype=np.uint64) + np.uint64(len(tokens))], dtype=np.uint64)).view(np.int64)[0])


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each row its id and text key, the size of its set and the set's hash (null for an empty set)."""
    for batch in batches:
        texts = strings(batch.column(2))
        for a, b in slices(texts, SLICE):
            sets = list(shingle_sets(texts[a:b]))
            yield pa.record_batch([batch.column(0)[a:b], batch.column(1)[a:b], pa.array([len(s) for s in sets], pa.int64()), pa.array([node_of(s) if len(s) else None for s in sets], pa.int64())], names=["doc_id", "text_key", "n", "sid"])


def tokens_of(batches: Iterator[pa.RecordBatch], ranges: int) -> Iterator[pa.RecordBatch]:
    """For each slice of texts, the tokens (48 bits of the hash) and the sets that have them, a row for each range of tokens.

    Sets that the task has seen, and those below four tokens, to which only an equal set is similar, send none.
    """
    seen: set[int] = set()
    for batch in batches:
        texts = strings(batch.column(0))
        for a, b in slices(texts, SLICE):
            own, tokens = [], []
            for s in shingle_sets(texts[a:b]):
                if len(s) >= 4 and (sid := node_of(s)) not in seen:
                    seen.add(sid)
                    tokens.append(s >> np.uint64(16))
                    own.append(np.full(len(s), sid))
            if len(seen) > 500_000:
                seen.clear()
            if not tokens:
                continue
            tokens, own = np.concatenate(tokens), np.concatenate(own)
            to = (tokens >> np.uint64(32)).astype(np.int64) * ranges >> 16
            order = np.argsort(to, kind="stable")
            to, tokens, own = to[order], tokens[order], own[order]
            there, begin = np.unique(to, return_index=True)
            parts = lambda x: pa.array([p.tobytes() for p in np.split(x, begin[1:])], pa.binary())  # noqa: B023, E731
            yield pa.record_batch([pa.array(there.astype(np.int32)), parts(tokens.astype(np.uint32)), parts((tokens >> np.uint64(32)).astype(np.uint16)), parts(own)], names=["range", "low", "high", "sid"])


def repeated_in(group: pa.Table, buckets: int) -> pa.Table:
    """Of one range, the tokens that several sets have, with how many (eight steps for each doubling), a row for each bucket of sets."""
    low, high, sid = (np.concatenate([numbers(v, kind) for v in group.column(c)]) for c, kind in (("low", "<u4"), ("high", "<u2"), ("sid", "<i8")))
    tokens = high.astype(np.uint64) << np.uint64(32) | low
    order = np.lexsort((sid, tokens))
    tokens, sid = tokens[order], sid[order]
    fresh = np.append(True, (tokens[1:] != tokens[:-1]) | (sid[1:] != sid[:-1]))  # tasks may have sent a set twice
    tokens, sid = tokens[fresh], sid[fresh]
    first = np.flatnonzero(np.append(True, tokens[1:] != tokens[:-1]))
    counts = np.diff(np.append(first, len(tokens)))
    often = np.repeat(counts, counts)
    keep = np.flatnonzero(often > 1)
    steps = np.minimum(255, np.ceil(8 * np.log2(often[keep]))).astype(np.uint8)
    to = sid[keep] & (buckets - 1)
    order = np.argsort(to, kind="stable")
    there, begin = np.unique(to[order], return_index=True)
    parts = lambda x: pa.array([p.tobytes() for p in np.split(x[order], begin[1:])] if len(x) else [], pa.binary())
    return pa.table({"bucket": pa.array(there, pa.int64()), "sid": parts(sid[keep]), "tokens": parts(tokens[keep]), "steps": parts(steps)})


def needed(n: int) -> int:
    """The least overlap that a set of n tokens has with any similar one."""
    return (4 * n + 4) // 5


def signatures(tokens: np.ndarray, often: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """Signatures of a set of n tokens.

    ``tokens``: those that occur in other sets too, by rarity; ``often``: of each.  The others come before them in the
    order, and share no signature with any set.
    """
    prefix = n - needed(n) + 1 - (n - len(tokens))
    if prefix <= 0:
        return
    rare = int(np.searchsorted(often, COMMON))
    yield tokens[: min(prefix, rare)]
    if rare >= prefix:
        return
    if n < SMALL * 5 // 4 + 1:
        yield mix(tokens[rare:prefix])
    if n < SMALL:
        return
    band = int(math.log(n) / math.log(1.25) + 1e-9)
    for family in (band, band + 1):
        classes = np.uint64(max(1, int(1.25**family / SUBCLASS)))
        subclass = mix(tokens[rare:] + np.uint64(family)) % classes
        by = np.argsort(subclass, kind="stable")
        first = np.ones(len(by), dtype=bool)
        first[1:] = subclass[by][1:] != subclass[by][:-1]
        beyond = np.ones(len(by), dtype=np.int64)
        beyond[by[first]] = 0  # the first token of each subclass, in order of rarity
        stop = int(np.searchsorted(np.cumsum(beyond), prefix - rare)) + 1
        for k in np.unique(subclass[:stop]):
            at = np.flatnonzero(subclass[:stop] == k) + rare
            if len(at) > 1:
                i, j = np.triu_indices(len(at), 1)
                a, b = np.minimum(tokens[at[i]], tokens[at[j]]), np.maximum(tokens[at[i]], tokens[at[j]])
                yield mix(mix(a * ODD + np.uint64(family)) + b)


def indexed_in(found: pa.Table, nodes: pa.Table) -> pa.Table:
    """Postings (signature, set, size) of a bucket of sets."""
    names = {"key": pa.int64(), "sid": pa.int64(), "n": pa.int64()}
    if not len(found) or not len(nodes):
        return pa.table({name: pa.array([], t) for name, t in names.items()})
    own, tokens, steps = (np.concatenate([numbers(v, kind) for v in found.column(c)]) for c, kind in (("sid", "<i8"), ("tokens", "<u8"), ("steps", "u1")))
    order = np.lexsort((tokens, steps, own))
    own, tokens, often = own[order], tokens[order], np.exp2(steps[order] / 8.0)
    known, size = nodes.column("sid").to_numpy(), nodes.column("n").to_numpy()
    by = np.argsort(known)
    there, begin = np.unique(own, return_index=True)
    sizes = size[by[np.searchsorted(known, there, sorter=by)]]
    key, sid, n = [np.zeros(0, np.uint64)], [], []
    for s, k, a, b in zip(there.tolist(), sizes.tolist(), begin.tolist(), np.append(begin[1:], len(own)).tolist(), strict=True):
        signature = list(signatures(tokens[a:b], often[a:b], k))
        key += signature
        number = sum(map(len, signature))
        sid.append(np.full(number, s))
        n.append(np.full(number, k))
    return pa.table({"key": np.concatenate(key).view(np.int64), "sid": np.concatenate(sid), "n": np.concatenate(n)})


def set_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The tokens of the wanted sets."""
    seen: set[int] = set()
    for batch in batches:
        texts = strings(batch.column(1))
        for a, b in slices(texts, SLICE):
            wanted, kept = batch.column(0)[a:b].to_pylist(), []
            for sid, own in zip(wanted, shingle_sets(texts[a:b]), strict=True):
                if len(own) and sid not in seen and node_of(own) == sid:
                    seen.add(sid)
                    kept.append((sid, own))
            ends = np.cumsum([0, *(len(s) for _, s in kept)]).astype(np.int32)
            tokens = np.concatenate([s for _, s in kept]).view(np.int64) if kept else np.zeros(0, np.int64)
            yield pa.record_batch([pa.array([s for s, _ in kept], pa.int64()), pa.ListArray.from_arrays(ends, tokens)], names=["sid", "tokens"])


def labelled(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, n, sid (null for an empty set), component_id and ``keep``, the smallest (id, text) of the component (null without one): one row per row."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first().bytes
    ranges = max(1, size // RANGE_BYTES)
    buckets = 1 << (ranges - 1).bit_length()
    rows = materialise(docs.select("doc_id", text_key().alias("text_key"), "text").mapInArrow(rows_of, "doc_id long, text_key long, n long, sid long"))
    nodes = materialise(links.nodes_of(rows))
    repeated = docs.select("text").mapInArrow(lambda it: tokens_of(it, ranges), "range int, low binary, high binary, sid binary").groupBy("range").applyInArrow(lambda g: repeated_in(g, buckets), "bucket long, sid binary, tokens binary, steps binary")
    sized = nodes.select(F.col("sid").bitwiseAND(F.lit(buckets - 1)).alias("bucket"), "sid", "n")
    postings = materialise(repeated.groupBy("bucket").cogroup(sized.groupBy("bucket")).applyInArrow(indexed_in, "key long, sid long, n long"))

    def sets_of(wanted: DataFrame) -> DataFrame:
        owned = materialise(wanted.join(nodes, "sid").select("sid", F.col("owner.id").alias("id_key"), F.col("owner.text").alias("text_key")))
        found = beside(docs.select(id_key().alias("id_key"), text_key().alias("text_key"), "text"), owned, ["id_key", "text_key"])
        return found.select("sid", "text").mapInArrow(set_rows, "sid long, tokens array<bigint>")

    return links.labelled(rows, nodes, links.links_of(postings, sets_of, ONE_TASK), ONE_TASK)


def components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id: one row per row of ``docs``."""
    return only(docs.sparkSession, lambda: labelled(docs)).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each component stays, that of the smallest id, of several such that of the smallest text hash, of equal ones any; rows with an empty set all stay."""
    own = F.struct(id_key().alias("id"), F.col("text_key").alias("text"))

    def marks() -> DataFrame:
        held = labelled(docs).where("keep IS NOT NULL").select(own.alias("own"), "keep").groupBy("own").agg(F.first("keep").alias("keep"), F.count("*").alias("rows"))
        return held.select((F.col("own") == F.col("keep")).alias("stays"), "rows", "own").where("NOT stays OR rows > 1")

    touched = only(docs.sparkSession, marks)
    every = docs.select(F.struct(*docs.columns).alias("row"), F.struct(id_key().alias("id"), text_key().alias("text")).alias("own"))
    marked = beside(every, touched, ["own"], "left")
    again = marked.where("stays").dropDuplicates(["own"])  # only rows that repeat in id and text
    return marked.where("stays IS NULL").select("row.*").unionByName(again.select("row.*"))


def op10_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return components(table(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
  FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(words) = 0 THEN []
    WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i+4], ' ')) END) AS shingles
  FROM w
), sets AS (
  SELECT doc_id, len(shingles) AS n, md5(array_to_string(list_sort(shingles), chr(10))) AS k, shingles FROM s
), reps AS (
  SELECT k, min(doc_id) AS rep, any_value(n) AS n, any_value(shingles) AS shingles FROM sets WHERE n > 0 GROUP BY k
), t AS (
  SELECT rep, n, unnest(shingles) AS t FROM reps
), links AS (
  SELECT a.rep AS a, b.rep AS b FROM t a JOIN t b ON a.t = b.t AND a.rep <> b.rep
  GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), reach AS (
  SELECT rep AS a, rep AS b FROM reps UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), least AS (
  SELECT a, min(b) AS c FROM reach GROUP BY a
)
SELECT sets.doc_id, sets.n AS n_shingles, coalesce(least.c, sets.doc_id) AS component_id
FROM sets LEFT JOIN reps ON sets.k = reps.k AND sets.n > 0 LEFT JOIN least ON least.a = reps.rep
"""
