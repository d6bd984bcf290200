"""Line dedup: an exact set-similarity join of lines; a line that is similar to an earlier one goes.

Lines (between line feeds) are sets of words, A-Z lower-cased.  Two lines match when the Jaccard coefficient of their sets
is 0.8 or more, and of two matching lines the later one, by doc_id and then line number, is removed.  Equal sets are one
node that stands where it first occurs.  For the others, the words of a set are ordered by rarity and its prefix is
indexed; two sets under one word are a candidate if their lengths allow it, if the positions of the word leave enough
words behind it, and if parities of the sets (64 bits, more for long ones) don't already differ in more bits than similar sets can.  Candidates
are joined into components, whose sets are compared exactly.  Filters of the lines wanted and of those that go travel to
the texts, which shuffle nowhere.

Defined results: a line without words never matches and stays; a null text stays null, without lines; a line's place is its
doc_id, null before all, its number, and then a hash of its text, so rows with equal doc_id are merged by line number, and
rows equal in id and text are one (equal lines of theirs at the same number all stay); text that loses no line is
untouched; an empty table gives an empty result; extra columns are carried by :func:`clean`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnspark.operators.components import connected_components

from . import rarity
from .common import hash_words, id_key, join_groups, materialise, mix, passing, slices, strings, table, text_key, unused, words_of
from .groups import BROADCAST_ROWS, Overlaps, beside, blocks, dealt, numbers, similar, spanning
from .places import cascade, filter_of, passes

#: Postings that a task compares, about; longer lists than LIST are dealt over pairs of blocks.
RANGE, LIST = 400_000, 8192
SLICES = "doc_ids array<bigint>, text_keys array<bigint>, lines binary, n binary, sid binary, tokens binary, postings long, cells binary"
#: Parities have more words of 64 bits the more tokens a set has, as the bits in which similar sets may differ grow with
#: their size; from how many tokens on, and how many words.  Wider ones fold into narrower ones.
TIERS = ((0, 1), (64, 2), (192, 8))
#: A token of a list: the list, the set, its size, the token's place in it, and the set's parity.
POSTINGS = {words: np.dtype([("key", "<u4"), ("n", "<u4"), ("place", "<u4"), ("sid", "<i8"), ("parity", "<u8", (words,))]) for _, words in TIERS}


def words_for(n: np.ndarray) -> np.ndarray:
    return np.array([w for _, w in TIERS])[np.searchsorted([begin for begin, _ in TIERS], n, side="right") - 1]


def folded(parity: np.ndarray, words: int) -> np.ndarray:
    """Parities of fewer words: a bit's word is its number modulo ``words``."""
    return np.stack([np.bitwise_xor.reduce(parity[:, k::words], axis=1) for k in range(words)], axis=1)


class Lines:
    """The lines of some texts: offsets of each text's lines, and the distinct words of each line as runs of hashes."""

    def __init__(self, texts: pa.Array):
        parts = pc.split_pattern(pc.ascii_lower(texts), "\n")
        self.ends = np.asarray(parts.offsets, dtype=np.int64)
        self.ends = self.ends - self.ends[0]
        ends, coded = words_of(parts.flatten())
        codes = np.asarray(coded.indices).astype(np.uint64) if len(coded) else np.zeros(0, np.uint64)
        packed = np.repeat(np.arange(len(ends) - 1, dtype=np.uint64) << np.uint64(32), np.diff(ends)) | codes
        packed.sort()
        packed = packed[np.append(True, packed[1:] != packed[:-1])] if len(packed) else packed
        word = hash_words(coded.dictionary) if len(coded) else np.zeros(0, np.uint64)
        self.words = word[(packed & np.uint64(0xFFFFFFFF)).astype(np.int64)]
        self.n = np.bincount((packed >> np.uint64(32)).astype(np.int64), minlength=len(ends) - 1)
        self.begins = np.cumsum(self.n) - self.n
        sums = np.zeros(len(self.n), dtype=np.uint64)
        filled = np.flatnonzero(self.n)
        if len(filled):
            sums[filled] = np.add.reduceat(self.words, self.begins[filled])
        self.sid = mix(sums + self.n.astype(np.uint64)).view(np.int64)

    def set_of(self, line: int) -> np.ndarray:
        return np.sort(self.words[self.begins[line] : self.begins[line] + self.n[line]])


def prefix_of(n: np.ndarray) -> np.ndarray:
    return n - (4 * n + 4) // 5 + 1


def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each slice of texts, with all its lines; tokens are kept by the upper halves of their hashes, which serves to find candidates."""
    counter, names = rarity.Counter(), ["doc_ids", "text_keys", "lines", "n", "sid", "tokens", "postings", "cells"]
    types = (*(pa.list_(pa.int64()),) * 2, *(pa.binary(),) * 4, pa.int64(), pa.binary())
    for batch in batches:
        texts = strings(batch.column(2))
        there = np.asarray(batch.column(2).is_valid())
        for a, b in slices(texts):
            lines = Lines(texts[a:b])
            counter.add(lines.words)
            row = (batch.column(0)[a:b].to_pylist(), batch.column(1)[a:b].to_pylist(), np.diff(lines.ends) * there[a:b], lines.n, lines.sid, lines.words >> np.uint64(32), int(prefix_of(lines.n[lines.n >= 4]).sum()), None)
            # a null text is one line without words here, and has none in ``lines``
            row = [np.ascontiguousarray(x, kind).tobytes() if kind else x for x, kind in zip(row, ("", "", "<i4", "<i4", "<i8", "<u4", "", ""), strict=True)]
            yield pa.record_batch([pa.array([x], t) for x, t in zip(row, types, strict=True)], names=names)
    yield pa.record_batch([pa.array([x], t) for x, t in zip([None] * 7 + [counter.value()], types, strict=True)], names=names)


def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, text_key, line and sid of every line; sid is null for a line without words."""
    for batch in batches:
        for docs, keys, lines, n, sid in zip(*(batch.column(k) for k in range(5)), strict=True):
            count, n, sid = numbers(lines, "<i4").astype(np.int64), numbers(n, "<i4"), numbers(sid, "<i8")
            held = np.maximum(count, 1)
            row = np.repeat(np.arange(len(held)), held)
            at = np.arange(len(row)) - np.repeat(np.cumsum(held) - held, held)
            real = np.repeat(count > 0, held)
            yield pa.record_batch([*(x.values.take(pa.array(row[real])) for x in (docs, keys)), pa.array(at[real], pa.int32()), pa.array(sid[real], mask=n[real] == 0)], names=["doc_id", "text_key", "line", "sid"])


def prefixes(n: np.ndarray, sid: np.ndarray, tokens: np.ndarray, cells: np.ndarray, seen: set) -> tuple | None:
    """Of the sets of four words or more that aren't in ``seen`` (smaller ones are similar only to equal ones): sizes, ids, parities, and their prefixes by rarity as (token, set, place)."""
    n = n.astype(np.int64)
    _, first = np.unique(sid, return_index=True)
    first = first[n[first] >= 4]
    first = np.sort(first[[s not in seen for s in sid[first].tolist()]]) if len(first) else first
    if not len(first):
        return None
    if len(seen) > 500_000:
        seen.clear()
    seen.update(sid[first].tolist())
    chosen = np.zeros(len(n), dtype=bool)
    chosen[first] = True
    tokens, n, sid = tokens[np.repeat(chosen, n)], n[first], sid[first]
    often = cells[tokens >> np.uint32(32 - rarity.CELL_BITS)].astype(np.int64)
    rank = (16 * np.log2(1.0 + often)).astype(np.uint64)  # below 2**10
    line = np.repeat(np.arange(len(n), dtype=np.uint64), n)
    if len(n) < 1 << 22:
        tokens = np.sort(line << np.uint64(42) | rank << np.uint64(32) | tokens) & np.uint64(0xFFFFFFFF)
    else:
        tokens = tokens[np.lexsort((tokens, rank, line))].astype(np.uint64)
    begins = np.cumsum(n) - n
    bits = mix(tokens)
    one, word = np.uint64(1) << (bits & np.uint64(63)), bits >> np.uint64(6)
    parities = {}
    for words in POSTINGS:
        tier = words_for(n) == words
        if tier.any():
            mine = np.repeat(tier, n)
            at = np.cumsum(n[tier]) - n[tier]
            parities[words] = np.zeros((len(n), words), dtype=np.uint64)
            parities[words][tier] = np.stack([np.bitwise_xor.reduceat(np.where(word[mine] % np.uint64(words) == k, one[mine], np.uint64(0)), at) for k in range(words)], axis=1)
    own = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(tokens)) - begins[own]
    kept = np.flatnonzero(place < prefix_of(n)[own])
    return n, sid, parities, tokens[kept], own[kept], place[kept]


def prefix_cells(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    counter, seen = rarity.Counter(), set()
    for batch in batches:
        for n, sid, tokens in zip(*(batch.column(k) for k in range(3)), strict=True):
            found = prefixes(numbers(n, "<i4"), numbers(sid, "<i8"), numbers(tokens, "<u4"), shared.value, seen)
            if found:
                counter.add(found[3] << np.uint64(32))
    yield pa.record_batch([pa.array([counter.value()], pa.binary())], names=["cells"])


def indexed(batches: Iterator[pa.RecordBatch], shared, shared_splits, ranges: int) -> Iterator[pa.RecordBatch]:
    """Postings of the prefixes of distinct sets, a row for each range of lists."""
    cells, splits, seen = shared.value, shared_splits.value, set()
    for batch in batches:
        for n, sid, tokens in zip(*(batch.column(k) for k in range(3)), strict=True):
            found = prefixes(numbers(n, "<i4"), numbers(sid, "<i8"), numbers(tokens, "<u4"), cells, seen)
            if not found:
                continue
            n, sid, parities, tokens, own, place = found
            # a long list: pairs of blocks of its sets
            split = splits[(tokens >> np.uint64(32 - rarity.CELL_BITS)).astype(np.int64)].astype(np.int64)
            if split.max(initial=1) > 1:
                block = (mix(sid[own].view(np.uint64)) % split.astype(np.uint64)).astype(np.int64)
                many = np.repeat(np.arange(len(own)), split)
                other = np.arange(len(many)) - np.repeat(np.cumsum(split) - split, split)
                low_block, high_block = np.minimum(block[many], other), np.maximum(block[many], other)
                tokens, own, place = tokens[many], own[many], place[many]
                tokens = tokens + (low_block.astype(np.uint64) << np.uint64(32)) + (high_block.astype(np.uint64) << np.uint64(48))
            key = mix(tokens + np.uint64(1))
            to = (key & np.uint64(0xFFFFFFFF)).astype(np.int64) % ranges
            tier = words_for(n)[own]
            for words, parity in parities.items():
                mine = tier == words
                out = np.empty(int(mine.sum()), dtype=POSTINGS[words])
                for name, x in (("key", key[mine] >> np.uint64(32)), ("n", n[own[mine]]), ("place", place[mine]), ("sid", sid[own[mine]]), ("parity", parity[own[mine]])):
                    out[name] = x
                blobs = dealt(out, to[mine])
                yield blobs.append_column("words", pa.array(np.full(len(blobs), words, dtype=np.int32)))


def list_splits(parts: DataFrame, shared) -> np.ndarray:
    """Into how many blocks the lists of each cell's words are cut: about one for every LIST sets, by the lengths of the lists of a few slices.  It shapes tasks, not results."""
    few = [r["slice"] for r in parts.select("slice").orderBy(F.xxhash64("slice")).limit(8).collect()]
    counts = rarity.total(parts.where(F.col("slice").isin(few)).select("n", "sid", "tokens").mapInArrow(lambda it: prefix_cells(it, shared), "cells binary"))
    return np.minimum(1 + counts * (parts.count() / max(1, len(few))) // LIST, 65_535).astype(np.uint16)


def candidates_in(group: pa.Table) -> pa.Table:
    """Edges of a spanning forest of the candidates in some lists.

    By list and size, row r meets row r + k for k = 1, 2, ... while any two are of one list and of fitting length.
    """
    kinds = group.column("words").to_numpy()
    tiers = {words: np.concatenate([numbers(v, kind) for v in group.column("postings").filter(pa.array(kinds == words))] or [np.zeros(0, kind)]) for words, kind in POSTINGS.items()}
    key, n, place, sid = (np.concatenate([t[x] for t in tiers.values()]) for x in ("key", "n", "place", "sid"))
    order = np.argsort(key.astype(np.uint64) << np.uint64(32) | n)
    key, n, place, sid = (x[order] for x in (key, n.astype(np.int64), place.astype(np.int64), sid))
    # for each width, the parities of the sets that have it, and where each row's is
    widths, held = words_for(n), {}
    for words in POSTINGS:
        enough = widths >= words
        at = np.full(len(n), -1)
        at[enough] = np.arange(int(enough.sum()))
        every = [folded(t["parity"], words) if w >= words else np.zeros((len(t), words), np.uint64) for w, t in tiers.items()]
        held[words] = (at, np.concatenate(every)[order][enough])
    # the smaller of two sets shares a token in a shorter prefix: their overlap is at least 8/9 of its size
    short = place < n - (8 * n + 8) // 9 + 1
    at, src, dst, k = np.flatnonzero(short[:-1]), [], [], 1
    while len(at):
        other = at + k
        at = at[(key[at] == key[other]) & (5 * n[at] >= 4 * n[other])]
        other = at + k
        x, y = at, other
        for at_of, parity in held.values():  # narrow ones first
            if not len(parity):
                break
            i, j = at_of[x], at_of[y]
            differ = np.bitwise_count(parity[i] ^ parity[j]).sum(axis=1)
            good = (i < 0) | (j < 0) | (differ <= (n[x] + n[y]) // 9)  # tokens in which similar sets differ at most
            x, y = x[good], y[good]
        left = np.minimum(n[x] - place[x], n[y] - place[y]) + np.minimum(place[x], place[y])
        good = (sid[x] != sid[y]) & (9 * left >= 4 * (n[x] + n[y]))
        if good.any():
            src.append(sid[x[good]])
            dst.append(sid[y[good]])
            if sum(map(len, src)) > 1_000_000:
                a, b = spanning(np.concatenate(src), np.concatenate(dst))
                src, dst = [a], [b]
        k += 1
        at = at[at + k < len(key)]
    a, b = spanning(np.concatenate(src), np.concatenate(dst)) if src else (np.zeros(0, np.int64),) * 2
    return pa.table({"src": a, "dst": b})


def set_rows(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    """Sets of the lines whose places pass the filter ``shared``."""
    for batch in batches:
        texts, docs, keys = strings(batch.column(0)), *(batch.column(k).to_numpy() for k in (1, 2))
        text, line = numbered(texts)
        hit = passes([shared.value], docs[text], keys[text], line) > 0
        text, line = text[hit], line[hit]
        some, at = np.unique(text, return_inverse=True)
        texts = texts.take(pa.array(some))
        for a, b in slices(texts):
            lines, mine = Lines(texts[a:b]), (at >= a) & (at < b)
            place = lines.ends[at[mine] - a] + line[mine]
            columns = (lines.sid[place], docs[text[mine]], line[mine], keys[text[mine]], [lines.set_of(k).tobytes() for k in place])
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()), strict=True)], names=["sid", "doc_id", "line", "text_key", "tokens"])


def numbered(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The text and the number of every line."""
    n = pc.add(pc.count_substring(texts, "\n"), 1).to_numpy().astype(np.int64)
    text = np.repeat(np.arange(len(n)), n)
    return text, np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)


def repeated_in(group: pa.Table) -> pa.Table:
    """Where the sets of one group first occur that are similar to one that occurs earlier."""
    text, line, doc = (group.column(c).to_numpy() for c in ("text_key", "line", "doc_id"))
    _, first = np.unique(group.column("sid").to_numpy(), return_index=True)  # repeated rows may bring a set twice
    order = first[np.lexsort((text[first], line[first], doc[first]))]
    tokens = group.column("tokens").to_pylist()
    overlaps = Overlaps([np.frombuffer(tokens[k], dtype=np.uint64) for k in order])
    out = order[[k for k in range(1, len(order)) if similar(overlaps.n[k], overlaps.n[:k], overlaps.of(k)[:k]).any()]] if len(order) > 1 else order[:0]
    return group.select(["doc_id", "text_key", "line"]).take(pa.array(out))


def removed(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """doc_id (FIRST for a null), text_key and line (from 0) of every line, and of every line that goes."""
    spark = docs.sparkSession
    docs = docs.select(id_key().alias("doc_id"), text_key().alias("text_key"), "text")
    everything = materialise(docs.mapInArrow(measured, SLICES).withColumn("slice", F.monotonically_increasing_id()))
    parts = everything.where("cells IS NULL")
    shared = rarity.shared_cells(spark, rarity.total(everything.where("cells IS NOT NULL").select("cells")))
    every = materialise(parts.select("doc_ids", "text_keys", "lines", "n", "sid").mapInArrow(listed, "doc_id long, text_key long, line int, sid long"))
    rows = every.where("sid IS NOT NULL")
    ranges = max(1, (parts.agg(F.sum("postings")).first()[0] or 0) // RANGE)
    splits = spark.sparkContext.broadcast(list_splits(parts, shared))
    postings = parts.select("n", "sid", "tokens").mapInArrow(lambda it: indexed(it, shared, splits, ranges), "range int, postings binary, words int")
    edges = postings.groupBy("range").applyInArrow(candidates_in, "src long, dst long")
    members = materialise(connected_components(edges, one_task=0).select(F.col("id").alias("sid"), "component"))
    firsts = materialise(rows.groupBy("sid").agg(F.min(F.struct("doc_id", "line", "text_key")).alias("first"), F.count("*").alias("_size")))
    wanted = materialise(blocks(beside(firsts, members, ["sid"])).select("sid", "component", "first.*", "parts"))
    held = spark.sparkContext.broadcast(filter_of(wanted))
    found = docs.select("text", "doc_id", "text_key").mapInArrow(lambda it: set_rows(it, held), "sid long, doc_id long, line int, text_key long, tokens binary")
    sets = beside(found, wanted, ["sid", "doc_id", "line", "text_key"]).select("sid", "component", "doc_id", "line", "text_key", F.explode("parts").alias("part"), "tokens")
    similar_ = sets.groupBy("component", "part").applyInArrow(repeated_in, "doc_id long, text_key long, line int")
    again = materialise(firsts.where("_size > 1"))
    n, few = rows.count(), again.count() <= BROADCAST_ROWS
    equal = rows.join(F.broadcast(again), "sid") if few else join_groups(rows, again, "sid", "_size", n)
    return every, materialise(similar_.unionByName(equal.where(F.struct("doc_id", "line", "text_key") > F.col("first")).select("doc_id", "text_key", "line")))


def clean(docs: DataFrame) -> DataFrame:
    """``docs`` with the text that is left, and n_lines, n_removed and removed_lines (numbers from 0, ascending).

    ``docs`` needs doc_id and text; n_chars, where present, follows the text.  A column of ``docs`` that has the name of an
    added one keeps it, and the added one gets underscores behind its name.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(passing(spark, lambda: cascade(*removed(docs))))

    @F.arrow_udf("array<int>")
    def gone_of(ids: pa.Array, keys: pa.Array, counts: pa.Array) -> pa.Array:
        n = counts.to_numpy()
        doc = np.repeat(np.arange(len(n)), n)
        line = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
        gone = passes(shared.value, ids.to_numpy()[doc], keys.to_numpy()[doc], line) % 2 > 0
        ends = np.append(0, np.cumsum(np.bincount(doc[gone], minlength=len(n))))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(line[gone], pa.int32()))

    count = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split(F.col("text"), "\n", -1))).cast("long")
    rows = docs.select(F.struct(*docs.columns).alias("row"), id_key().alias("id"), text_key().alias("key"), count.alias("n"))
    joined = rows.select("row", "n", gone_of("id", "key", "n").alias("gone"), F.col("row").getField("text").alias("text"))
    kept = F.when(F.size("gone") == 0, F.col("text")).otherwise(F.array_join(F.filter(F.split(F.col("text"), "\n", -1), lambda x, i: ~F.array_contains("gone", i)), "\n"))
    own = {"text": kept, "n_chars": F.length(kept).cast("long")}
    added = {"n_lines": F.col("n").cast("int"), "n_removed": F.size("gone"), "removed_lines": F.col("gone")}
    return joined.select(*[own.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns], *[c.alias(unused(name, docs.columns)) for name, c in added.items()])


def op1_line_dedup(spark, sf_dir: str) -> DataFrame:
    out = clean(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "text", "n_lines", "n_removed", F.array_join(F.transform("removed_lines", lambda k: k.cast("string")), ",").alias("removed_lines"))


SQL = r"""
WITH d AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents
), l AS (
  SELECT doc_id, generate_subscripts(lines, 1) - 1 AS k, unnest(lines) AS line FROM d WHERE text IS NOT NULL
), w AS (
  SELECT doc_id, k, list_sort(list_distinct(list_filter(regexp_split_to_array(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> ''))) AS s
  FROM l
), sets AS (
  SELECT row_number() OVER () AS id, s, first FROM (SELECT s, min((doc_id, k)) AS first FROM w WHERE len(s) > 0 GROUP BY s)
), t AS (
  SELECT id, len(s) AS n, unnest(s) AS tok FROM sets
), p AS (
  SELECT id, n, tok FROM (SELECT id, n, tok, row_number() OVER (PARTITION BY id ORDER BY c, tok) AS r FROM (SELECT *, count(*) OVER (PARTITION BY tok) AS c FROM t)) WHERE r <= n - (4 * n + 4) // 5 + 1
), cand AS (
  SELECT DISTINCT a.id AS a, b.id AS b FROM p a JOIN p b ON a.tok = b.tok WHERE a.id <> b.id AND a.n <= b.n AND 5 * a.n >= 4 * b.n
), bad AS (
  SELECT DISTINCT CASE WHEN x.first < y.first THEN y.id ELSE x.id END AS id FROM cand JOIN sets x ON x.id = a JOIN sets y ON y.id = b
  WHERE 9 * len(list_intersect(x.s, y.s)) >= 4 * (len(x.s) + len(y.s))
), gone AS (
  SELECT w.doc_id, list(w.k ORDER BY w.k) AS ks FROM w JOIN sets ON w.s = sets.s LEFT JOIN bad ON bad.id = sets.id
  WHERE (w.doc_id, w.k) <> sets.first OR bad.id IS NOT NULL GROUP BY w.doc_id
)
SELECT d.doc_id,
       CASE WHEN ks IS NULL THEN text ELSE array_to_string(list_transform(list_filter(range(len(lines)), lambda k: NOT list_contains(ks, k)), lambda k: lines[k + 1]), chr(10)) END AS text,
       CASE WHEN text IS NULL THEN 0 ELSE len(lines) END::INTEGER AS n_lines,
       coalesce(len(ks), 0)::INTEGER AS n_removed,
       coalesce(array_to_string(ks, ','), '') AS removed_lines
FROM d LEFT JOIN gone ON d.doc_id = gone.doc_id
"""
