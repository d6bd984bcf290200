import glob
import itertools
import os
import random
import re
import string
import time
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from cairnspark.llm import common, exact_dedup, groups, line_dedup, links, ngram_join, places, rarity, spotsigs

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def sql(spark, frame, query):
    db = duckdb.connect()
    db.register("documents", frame.select("doc_id", "text").toArrow())
    return {r[0]: r[1:] for r in db.execute(query).fetchall()}


def test_exact_dedup_matches_sql(spark, small):
    want = sql(spark, small, exact_dedup.SQL)
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.decisions(small).collect()}
    assert got == want
    assert exact_dedup.keep_unique(small).count() == sum(v[2] for v in want.values())


def test_exact_dedup_edges(docs):
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.decisions(docs(["a b", "ab", None, "", "a  b"])).collect()}
    assert got == {0: (4, 3, False), 1: (4, 3, False), 4: (4, 3, True), 2: (2, 2, True), 3: (2, 2, False)}
    assert exact_dedup.decisions(docs([])).count() == 0
    again = exact_dedup.decisions(docs([(None, "x", None, None, None), (1, "x", None, None, None), (1, "x", None, None, None)])).collect()
    assert [(r.doc_id, r.kept) for r in sorted(again, key=lambda r: (r.doc_id is not None))] == [(None, True), (1, False), (1, False)]
    same = exact_dedup.decisions(docs([(7, "same text", None, None, None)] * 3 + [(8, "same  text", None, None, None)] * 2 + [(9, "alone", None, None, None)]))
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in same.collect()) == {(7, 8, 5, False): 3, (8, 8, 5, True): 1, (8, 8, 5, False): 1, (9, 9, 1, True): 1}
    kept = exact_dedup.keep_unique(docs([(7, "same text", None, None, None)] * 3 + [(7, "other", None, None, None), (None, "o t h e r", None, None, None), (None, "x", None, None, None)]))
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == {(7, "same text"): 1, (None, "o t h e r"): 1, (None, "x"): 1}


@pytest.mark.parametrize("filter_bits", [1 << 28, 1 << 12])
def test_few_rows_are_flagged_at_every_size(spark, monkeypatch, filter_bits):
    """A third of the rows are one text; of the others every tenth has a copy.  Only those and few more may shuffle, whatever the size."""
    monkeypatch.setattr(exact_dedup, "FILTER_BITS", filter_bits)
    for n in (300, 3_000, 30_000):
        text = F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 10 == 1, F.concat(F.lit("t"), (F.col("id") - 1).cast("string"))).otherwise(F.concat(F.lit("t"), F.col("id").cast("string")))
        digest = exact_dedup.digests(spark.range(0, n, 1, 7).select(F.col("id").alias("doc_id"), text.alias("text"))).cache()
        flags = exact_dedup.possibly_repeated(digest, n).groupBy("h").agg(F.count("*").alias("n"), F.min("maybe").alias("all"), F.max("maybe").alias("any")).collect()
        assert sum(r.n for r in flags) == n
        assert all(r["all"] for r in flags if r.n > 1)
        assert sum(r.n for r in flags if r["any"] and r.n == 1) <= 0.15 * n


def linked(a, b):
    both = len(a & b)
    return bool(a and b) and 100 * both >= 80 * (len(a) + len(b) - both)


def shingles(text):
    w = words(text)
    return frozenset([" ".join(w)] if 0 < len(w) < 5 else (" ".join(w[i : i + 5]) for i in range(len(w) - 4)))


def brute_components(rows):
    ids, sets = [r[0] for r in rows], [shingles(r[1]) for r in rows]
    root = list(range(len(rows)))
    find = lambda k: k if root[k] == k else find(root[k])
    for i in range(len(rows)):
        for j in range(i):
            if linked(sets[i], sets[j]):
                root[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for k, i in enumerate(ids):
        least[find(k)] = min(least.get(find(k), i), i)
    return {i: (len(sets[k]), least[find(k)]) for k, i in enumerate(ids)}


def families(seed, n, size=60, vocabulary=400):
    """Texts in families of edited copies, with a passage that many share."""
    rng = random.Random(seed)
    word = lambda: "w" + str(rng.randrange(vocabulary))
    passage, out = [word() for _ in range(40)], []
    while len(out) < n:
        base = [word() for _ in range(rng.randrange(2, size))] + (passage if rng.random() < 0.5 else [])
        for _ in range(rng.choice([1, 1, 2, 6])):
            own = list(base)
            for _ in range(rng.randrange(0, 3)):
                own[rng.randrange(len(own))] = word()
            out.append(" ".join(own[: len(own) - rng.randrange(0, 3)]) or "w1")
    return out[:n]


@pytest.mark.parametrize("common_from", [512, 2])
@pytest.mark.parametrize("long_list", [1024, 1])
def test_ngram_join_matches_brute_force(docs, monkeypatch, common_from, long_list):
    monkeypatch.setattr(ngram_join, "COMMON", common_from)
    monkeypatch.setattr(links, "LIST", long_list)
    monkeypatch.setattr(groups, "BROADCAST_ROWS", 500_000 if long_list > 1 else -1)
    texts = [*families(1, 120), None, "", " ", "A b c", "a B c", "a b c d", *families(2, 40, 12, 30)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.components(docs(texts)).collect()}
    assert got == brute_components(list(enumerate(texts)))


def test_shared_passages_are_pairs_and_no_group(docs, monkeypatch):
    """Documents made of shared passages, none similar: what is compared grows with the candidates, not with their components."""
    rng, asked = random.Random(4), []
    passages = [" ".join(f"p{k}x{j}" for j in range(60)) for k in range(600)]
    texts = [" ".join(passages[k] for k in rng.sample(range(600), 10)) for _ in range(600)]
    monkeypatch.setattr(links, "linked", lambda pairs, sets, real=links.linked: asked.append(pairs.count()) or real(pairs, sets))
    got = ngram_join.components(docs(texts)).collect()
    assert all(r.component_id == r.doc_id for r in got)
    owners = Counter(k for t in texts for k in {int(p[1:].split("x")[0]) for p in t.split()})
    assert 0 < sum(asked) < sum(m * (m - 1) // 2 for m in owners.values()) < 600 * 599 // 4


def test_near_copies_are_linked_without_all_pairs(docs, monkeypatch):
    rng, asked = random.Random(6), []
    base = [f"w{k}" for k in range(400)]
    texts = []
    for k in range(300):
        own = list(base)
        for at in rng.sample(range(400), 3):
            own[at] = f"v{k}x{at}"
        texts.append(" ".join(own))
    monkeypatch.setattr(links, "linked", lambda pairs, sets, real=links.linked: asked.append(pairs.count()) or real(pairs, sets))
    assert {r.component_id for r in ngram_join.components(docs(texts)).collect()} == {0}
    assert sum(asked) < 300 * 299 / 4


def test_pair_signatures_are_complete():
    """Any two similar sets share a signature, whatever is common."""
    rng = np.random.default_rng(0)
    for _ in range(300):
        n = int(rng.integers(4, 200))
        x = np.unique(rng.integers(0, 2**62, n).astype(np.uint64))
        n = len(x)
        y = np.unique(np.concatenate((x[: n - int(rng.integers(0, n // 5 + 1))], rng.integers(0, 2**62, int(rng.integers(0, n // 10 + 1))).astype(np.uint64))))
        if not linked(set(x.tolist()), set(y.tolist())):
            continue
        often = lambda t: np.where(t % np.uint64(3) == 0, 3.0, 900.0 + (t % np.uint64(50)).astype(float))
        found = []
        for t in (x, y):
            order = np.lexsort((t, often(t)))
            found.append({int(v) for s in ngram_join.signatures(t[order], often(t)[order], len(t)) for v in s})
        assert found[0] & found[1]


def test_keep_one(docs):
    texts = ["a b c d e f g", "A b c d e f g", "other words are here too now", "", None]
    assert sorted(r.doc_id for r in ngram_join.keep_one(docs(texts)).collect()) == [0, 2, 3, 4]
    assert ngram_join.components(docs([])).count() == 0 and ngram_join.keep_one(docs([])).count() == 0


def test_keep_one_decides_by_row(docs):
    """Repeated rows, null ids, and an id that a copy shares with a clean text."""
    row = lambda i, t: (i, t, "en", "a", len(t))
    copy, clean = "one two three four five six", "clean words that nothing else has here"
    kept = ngram_join.keep_one(docs([row(1, copy), row(1, copy), row(2, copy), row(2, clean), row(None, "q w e r t y u"), row(7, "Q w e r t y u"), row(None, "alone here with a null id"), row(3, ""), row(3, "")]))
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter({(1, copy): 1, (2, clean): 1, (None, "q w e r t y u"): 1, (None, "alone here with a null id"): 1, (3, ""): 2})


def test_ngram_join_on_edges(small):
    rows = [(r.doc_id, r.text) for r in small.select("doc_id", "text").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.components(small).collect()}
    assert got == brute_components(rows)


def brute_lines(rows):
    """removed line numbers of each document"""
    seen, index, out = [], {}, {}
    for i, text in sorted(rows, key=lambda r: r[0]):
        own = []
        for k, line in enumerate((text or "").split("\n") if text is not None else []):
            s = frozenset(words(line))
            if not s:
                continue
            counts = Counter(j for w in s for j in index.get(w, ()))
            if any(linked(s, seen[j]) for j in counts):
                own.append(k)
            for w in s:
                index.setdefault(w, []).append(len(seen))
            seen.append(s)
        out[i] = own
    return out


@pytest.mark.parametrize("long_list,tiers", [(8192, ((0, 1), (64, 2), (192, 8))), (3, ((0, 1), (8, 2), (11, 8)))])
def test_line_dedup_matches_brute_force(docs, monkeypatch, long_list, tiers):
    monkeypatch.setattr(line_dedup, "LIST", long_list)
    monkeypatch.setattr(line_dedup, "TIERS", tiers)
    if long_list == 3:  # nothing is broadcast
        monkeypatch.setattr(groups, "BROADCAST_ROWS", -1)
        monkeypatch.setattr(line_dedup, "BROADCAST_ROWS", -1)
    monkeypatch.setattr(groups, "MOST", 5)
    monkeypatch.setattr(groups, "BLOCK", 2)
    lines = [t for t in families(5, 260, 14, 60)]
    texts = ["\n".join(lines[k : k + 4]) for k in range(0, 260, 4)] + [None, "", "\n\n", "one\ntwo\none\n"]
    got = {r.doc_id: (r.removed_lines, r.n_removed, r.text) for r in line_dedup.clean(docs(texts)).collect()}
    want = brute_lines(list(enumerate(texts)))
    for i, text in enumerate(texts):
        left = None if text is None else "\n".join(x for k, x in enumerate(text.split("\n")) if k not in want[i])
        assert got[i] == (want[i], len(want[i]), left)


def test_line_dedup_edges(small, docs):
    want = brute_lines([(r.doc_id, r.text) for r in small.select("doc_id", "text").collect()])
    out = line_dedup.clean(small)
    assert {r.doc_id: r.removed_lines for r in out.collect()} == want
    assert set(small.columns) < set(out.columns)
    assert line_dedup.clean(docs([])).count() == 0


def test_line_dedup_shuffles_no_text(docs, monkeypatch):
    monkeypatch.setattr(groups, "BROADCAST_ROWS", -1)
    out = line_dedup.clean(docs(["a b c d\ne f g h", "e f g h\na b c d", "i j"]))
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    assert {r.doc_id: r.removed_lines for r in out.collect()} == {0: [], 1: [0, 1], 2: []}


def test_cascades_are_exact(spark):
    table = common.materialise(spark.range(1_200_000).select((F.col("id") % 1000).alias("doc_id"), (F.col("id") % 3).alias("text_key"), F.col("id").cast("int").alias("line")))
    filters = places.cascade(table, common.materialise(table.where("line % 3 = 1")))
    doc, line = np.arange(1_200_000) % 1000, np.arange(1_200_000)
    found = places.passes(filters, doc, line % 3, line)
    assert len(filters) > 1 and found.max() > 1 and ((found % 2 == 1) == (line % 3 == 1)).all()
    assert places.cascade(table, common.materialise(table.where("false"))) == []


def test_overlaps_and_spanning():
    sets = [np.array([1, 2, 3], np.uint64), np.array([3], np.uint64), np.array([], np.uint64), np.array([2, 3, 9], np.uint64)]
    found = groups.Overlaps(sets)
    assert [found.of(k).tolist() for k in range(4)] == [[3, 1, 0, 2], [1, 1, 0, 1], [0, 0, 0, 0], [2, 1, 0, 3]]
    a, b = groups.spanning(np.array([5, 7, 9, 5]), np.array([7, 9, 5, 11]))
    assert set(zip(a.tolist(), b.tolist(), strict=True)) == {(7, 5), (9, 5), (11, 5)}
    counter = rarity.Counter()
    counter.add(np.array([1 << 63, 1 << 63], dtype=np.uint64))
    assert np.frombuffer(counter.value(), "<u4").sum() == 2


def test_hash_words_are_distinct():
    import pyarrow as pa

    every = [a + b + c for a in "abé漢" for b in ["", *string.ascii_letters] for c in string.digits]
    assert len(set(common.hash_words(pa.array(every)).tolist())) == len(set(every))


def plain_signatures(text):
    """SpotSigs in plain Python: the signatures of a text as tuples of an anchor and its chain."""
    anchors = {w for ws in spotsigs.ANCHORS.values() for w in ws.split()}
    ws = [w for w in (x.strip(spotsigs.EDGE) for x in re.split(spotsigs.BLANK, (text or "").lower())) if w]
    found, since = set(), 0
    for i in range(-1, len(ws)):
        since = 0 if i < 0 or ws[i] in anchors else since + 1
        if since == 0 or since > spotsigs.GAP:
            chain = list(itertools.islice((ws[j] for j in range(i + 1, len(ws)) if ws[j] not in anchors), spotsigs.CHAIN))
            if len(chain) == spotsigs.CHAIN:
                found.add((ws[i] if i >= 0 else None, *chain))
    return found | ({(w,) for w in ws} if len(ws) < spotsigs.FEW else set())


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_spotsigs_contract(small, monkeypatch):
    monkeypatch.setattr(spotsigs, "table", lambda *_: small)
    rows = {r.doc_id: r for r in spotsigs.op3_spotsigs(small.sparkSession, "").collect()}
    import hashlib

    base = sorted((r.doc_id, r.text or "") for r in small.collect())
    sets = [plain_signatures(t) for _, t in base]
    numbers, likeness = {}, []
    for k, (i, text) in enumerate(base):
        after, cut = base[(k + 1) % len(base)][1], len(text) // 4
        changed = text[: len(text) - cut] + after[:cut]
        assert rows[i].n_chars == len(text)
        assert rows[i].edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        assert rows[i].near_edited == pytest.approx(jaccard(sets[k], plain_signatures(changed)))
        assert rows[i].near_next == pytest.approx(jaccard(sets[k], sets[(k + 1) % len(base)]))
        assert len(rows[i].fingerprint.split()) == len(sets[k])
        assert numbers.setdefault(rows[i].fingerprint, sets[k]) == sets[k]
        likeness.append((rows[i].near_edited, rows[i].near_next))
    assert np.median([a for a, _ in likeness]) > 0.5 and np.median([b for _, b in likeness]) < 0.05
    assert {i: r.group_id for i, r in rows.items()} == brute_groups([i for i, _ in base], sets)


def brute_groups(ids, sets):
    root = list(range(len(ids)))
    find = lambda k: k if root[k] == k else find(root[k])
    for i in range(len(ids)):
        for j in range(i):
            if linked(sets[i], sets[j]):
                root[max(find(i), find(j))] = min(find(i), find(j))
    return {i: ids[find(k)] for k, i in enumerate(ids)}  # ids ascend, so roots are the smallest


def test_spotsigs_on_edges(small, docs):
    for ranges in (1, 7):
        own = sorted(((r.doc_id, r.text or "") for r in small.select("doc_id", "text").collect()), key=lambda r: r[0])
        got = {r.doc_id: r.next_text for r in spotsigs.with_next(small, ranges).collect()}
        assert got == {own[k][0]: own[(k + 1) % len(own)][1] for k in range(len(own))}
    assert spotsigs.with_next(docs([])).count() == 0 and spotsigs.with_next(docs(["only"])).first().next_text == "only"
    prints = {r.doc_id: r.signatures for r in spotsigs.fingerprint(docs(["The cat sat on mats.", "the CAT sat on mats", None, "", "| | |", "the of"])).collect()}
    assert prints[0] == prints[1] and prints[0] and prints[2] == prints[3] == prints[4] == [] and prints[5]


@pytest.mark.parametrize("long_list", [1024, 2])
def test_spotsigs_groups_match_brute_force(docs, monkeypatch, long_list):
    monkeypatch.setattr(links, "LIST", long_list)
    monkeypatch.setattr(groups, "BROADCAST_ROWS", 500_000 if long_list > 2 else -1)
    texts = [t.replace("w1", "the").replace("w2", "of") for t in families(8, 90, 40, 200)] + [None, "", "the the", "one two"]
    got = {r.doc_id: r.group_id for r in spotsigs.groups_of(docs(texts)).collect()}
    assert got == brute_groups(list(range(len(texts))), [plain_signatures(t) for t in texts])


def test_sets_of_unlikely_pairs_stay(docs, monkeypatch):
    """Documents that share passages and aren't similar are pairs, but their sets move for none: sketches tell."""
    rng, asked, moved = random.Random(5), [], []
    passages = [" ".join(f"p{k}x{j}" for j in range(60)) for k in range(60)]
    texts = [" ".join(passages[k] for k in rng.sample(range(60), 10)) for _ in range(60)]
    monkeypatch.setattr(links, "linked", lambda pairs, sets, real=links.linked: asked.append(pairs.count()) or real(pairs, sets))
    monkeypatch.setattr(links, "met", lambda pairs, sets, columns, real=links.met: ("tokens" in columns and moved.append(pairs.count())) or real(pairs, sets, columns))
    assert all(r.component_id == r.doc_id for r in ngram_join.components(docs(texts)).collect())
    assert sum(asked) > 0 and moved and sum(moved) == 0


@pytest.mark.parametrize("short", [32, 2])
def test_spotsigs_postings_that_meet_none_stay(spark, monkeypatch, short):
    monkeypatch.setattr(spotsigs, "SHORT", short)
    own = lambda sid, n, *keys: (sid, n, [(0, k) for k in keys])
    late, first, mixed = ([k] + list(range(1000 * k, 1000 * k + 19)) for k in (1, 2, 3))
    rows = [own(1, 100, *late[1:], 1), own(2, 100, *range(50, 69), 1), own(3, 100, *first), own(4, 100, 2, 77), own(5, 100, *mixed), own(6, 101, 3, 78), own(7, 300, 3, 79), own(8, 90, 4), own(8, 90, 4)]
    held = spark.createDataFrame(rows, "sid long, n long, prefix array<struct<steps: int, s: long>>")
    got = {(r.key, r.sid) for r in spotsigs.meeting(held).collect()}
    # 1 is the last of twenty in both sets that have it; that of size 300 fits no other under 3; 4 is of copies of one set
    assert got - {(4, 8)} == {(2, 3), (2, 4), (3, 5), (3, 6)} | ({(3, 7)} if short == 2 else set())


def test_spotsigs_shuffle_files_go_with_their_step(small, monkeypatch):
    spark = small.sparkSession
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffles = lambda: {f.split("_")[1] for d in manager.localDirsString() for f in map(os.path.basename, glob.glob(f"{d}/*/shuffle_*"))}
    before, left = shuffles(), []

    def edited(*args, real=spotsigs.edited):
        until = time.time() + 20
        while len(shuffles() - before) > 3 and time.time() < until:  # they go in the background
            time.sleep(0.2)
        left.append(len(shuffles() - before))
        return real(*args)

    monkeypatch.setattr(spotsigs, "table", lambda *_: small)
    monkeypatch.setattr(spotsigs, "edited", edited)
    assert spotsigs.op3_spotsigs(spark, "").count() == small.count()
    assert left[0] <= 3
