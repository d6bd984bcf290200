import itertools
import math
import re
import string
import tracemalloc
import zlib
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cairnspark.llm import importance, language_id, lm_score, pii
from cairnspark.llm.elias_fano import LEVELS, EliasFano, Trie, quantised

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def rows_of(frame):
    return [(r.doc_id, r.text) for r in frame.select("doc_id", "text").collect()]


@pytest.mark.parametrize("n,u", [(1, 1), (5, 5), (700, 700), (900, 10**6), (50_000, 10**9)])
def test_elias_fano_round_trip(n, u):
    rng = np.random.default_rng(n)
    v = np.arange(n) if n == u else np.unique(rng.integers(0, u, n))
    e = EliasFano.of(v, u)
    assert (e.get(np.arange(len(v))) == v).all()
    q = np.unique(np.append(v, rng.integers(0, u, 500)))
    at = np.minimum(np.searchsorted(v, q), len(v) - 1)
    assert (e.find(q) == np.where(v[at] == q, at, -1)).all()


@pytest.mark.parametrize("order", [2, 3])
def test_trie_round_trip(order):
    rng, bits = np.random.default_rng(order), 7
    keys = np.unique(sum(rng.integers(0, 90, 4000) << (bits * k) for k in range(order)))
    contexts = np.unique(keys >> bits)
    p, left = rng.random(len(keys)), rng.random(len(contexts))
    trie = Trie.load(np.frombuffer(Trie.of(keys, order, bits, p, left).dump(), np.uint8))
    q = np.unique(np.append(keys, rng.integers(0, 1 << bits * order, 4000)))
    a, b = trie.look_up(q, bits)
    known, held = dict(zip(keys.tolist(), LEVELS[quantised(p)], strict=True)), dict(zip(contexts.tolist(), LEVELS[quantised(left)], strict=True))
    assert np.allclose(a, [known.get(k, 0) for k in q.tolist()]) and np.allclose(b, [held.get(k >> bits, 1) for k in q.tolist()])


def test_quantised_probabilities_never_grow():
    p = np.random.default_rng(0).random(1000)
    assert (LEVELS[quantised(p)] <= p * (1 + 1e-9)).all() and (LEVELS[quantised(p)] > 0.9 * p).all()


def test_lm_scores(spark, small, monkeypatch):
    monkeypatch.setattr(lm_score, "CHUNK", 40_000)
    monkeypatch.setattr(lm_score, "RANGE", 5_000)
    got = {r.doc_id: r for r in lm_score.score(small, lm_score.crc_mod("doc_id", 5) == 1).collect()}
    texts = {i: [*WORD.findall((t or "").translate(LOWER)), None] for i, t in rows_of(small)}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in texts}
    c = Counter(w for i, t in texts.items() if not held[i] for w in t)
    n, v = sum(c.values()), len(c)
    for i, t in texts.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(t), sum(c[w] > 0 for w in t), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t))
        assert r.score < 0
    # better than the base on what it hasn't seen, and the same whatever the chunks
    unseen = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in unseen) > 0.9 * sum(r.base_score for r in unseen)
    monkeypatch.setattr(lm_score, "CHUNK", 8 << 20)
    monkeypatch.setattr(lm_score, "RANGE", 1_000_000)
    again = {r.doc_id: r.score for r in lm_score.score(small, lm_score.crc_mod("doc_id", 5) == 1).collect()}
    assert all(again[i] == pytest.approx(r.score) for i, r in got.items())


def test_lm_matches_plain_interpolation(docs):
    """The trie's scores against the same model from dictionaries."""
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{min(int(x), 40)}" for x in rng.zipf(1.5, int(rng.integers(1, 60)))) for _ in range(60)]
    got = {r.doc_id: r.score for r in lm_score.score(docs(texts), F.lit(False)).collect()}
    t = [x.split() + [""] for x in texts]
    grams = lambda k: Counter(tuple((["", ""] + x)[i + 2 - (k - 1) : i + 3]) for x in t for i in range(len(x)))
    one, two, three = grams(1), grams(2), grams(3)
    n = sum(one.values())
    level = lambda p: float(LEVELS[quantised(np.array([p]))][0])

    def shares(table):
        total, kept, left = Counter(), {}, {}
        for g, k in table.items():
            total[g[:-1]] += k
        for g, k in table.items():
            if k >= 2:
                kept[g] = level((k - lm_score.DISCOUNT) / total[g[:-1]])
        for g, a in kept.items():
            left[g[:-1]] = left.get(g[:-1], 1) - a
        return kept, {g: level(b) for g, b in left.items()}

    (a2, b2), (a3, b3) = shares(two), shares(three)
    for i, x in enumerate(t):
        full, want = ["", "", *x], 0.0
        for j in range(2, len(full)):
            g = tuple(full[j - 2 : j + 1])
            p = one[(g[2],)] / (n + 1)
            p = a2.get(g[1:], 0) + b2.get(g[1:2], 1) * p
            want += math.log10(a3.get(g, 0) + b3.get(g[:2], 1) * p)
        assert got[i] == pytest.approx(want)


def test_lm_keeps_ngrams_whatever_the_size(docs, monkeypatch):
    """A phrase seen twice is worth its pairs and triples, however large the corpus beside it (a small cap stands for a large corpus)."""
    monkeypatch.setattr(lm_score, "MOST_NGRAMS", 50, raising=False)
    texts = ["red blue green"] * 2 + [f"x{k % 7} y{k % 5} z{k % 3}" for k in range(100)]
    got = {r.doc_id: r for r in lm_score.score(docs(texts), F.lit(False)).collect()}
    assert got[0].score > got[0].base_score + 5


def test_lm_has_ngrams_of_rare_words(docs, monkeypatch):
    """Words beyond any most frequent ones have pairs and triples of their own, and cuts within contexts change nothing."""
    filler = [" ".join(f"f{k * 50 + j}" for j in range(50)) for k in range(200)]
    texts = ["rare phrase here"] * 2 + filler * 3
    got = {r.doc_id: r for r in lm_score.score(docs(texts), F.lit(False)).collect()}
    assert got[0].score > got[0].base_score + 9
    monkeypatch.setattr(lm_score, "CHUNK", 10_000)
    monkeypatch.setattr(lm_score, "RANGE", 300)
    again = {r.doc_id: r.score for r in lm_score.score(docs(texts), F.lit(False)).collect()}
    assert all(again[i] == pytest.approx(r.score) for i, r in got.items())


def test_lm_edges(docs):
    assert lm_score.score(docs([]), F.lit(False)).count() == 0
    none = lm_score.score(docs(["a b", None]), F.lit(True)).collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens) for r in none] == [(3, 0, 0), (1, 0, 0)]


def test_language_id(small):
    spark = small.sparkSession
    got = {r.doc_id: r for r in language_id.predict(small, language_id.fit(small, language_id.crc_mod("doc_id", 3) != 1)).collect()}
    truth = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    unseen = [i for i in truth if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum(got[i].lang_pred == truth[i] for i in unseen) / len(unseen) > 0.9
    for i, text in rows_of(small):
        lettered = any(map(str.isalpha, text or ""))
        assert (got[i].lang_pred == "und") == (not lettered) and 0 <= got[i].score <= 1
        assert lettered or got[i].rejected


def test_language_id_edges(docs):
    model = language_id.fit(docs([]))
    assert model.languages == [] and [r.lang_pred for r in language_id.predict(docs(["abc"]), model).collect()] == ["und"]
    mixed = docs([(k, f"word{k} the and of", "en", None, None) for k in range(12)] + [(k + 20, f"wort{k} der und von", "de", None, None) for k in range(12)])
    model = language_id.fit(mixed)
    found = {r.doc_id: r.lang_pred for r in language_id.predict(docs(["the and the of and", "der und und von der", "12 34", None]), model).collect()}
    assert found == {0: "en", 1: "de", 2: "und", 3: "und"}
    kept = language_id.keep_identified(mixed.unionByName(docs([(99, "12", None, None, None)])), model)
    assert kept.columns == mixed.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in mixed.collect()}


def test_character_model_is_a_distribution():
    """Probabilities of the known characters after a context sum to no more than 1, and leave little to unknown ones."""
    text = "the then there and other than that this"
    model = language_id.Model.fit({"en": [text] * 3})
    for head in ("", "t", "th", "the", "zzz"):
        total = sum(2 ** -model.costs([head + c])[0][len(head) + 1, 0] for c in sorted(set(text)))
        assert 0.6 < total <= 1.0001


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text):
    """The patterns as they are written, with their checks."""
    out = {}
    for kind, pattern in BASE.items():
        out[kind] = []
        for m in re.finditer(pattern, text):
            digits = re.sub(r"[^0-9]", "", m.group())
            if kind == "ip" and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if kind == "card" and not (13 <= len(digits) <= 19 and sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(digits))) % 10 == 0):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out[kind].append(m.span())
    return out


def test_pattern_spans_match_plain_patterns(small):
    rng = np.random.default_rng(1)
    drawn = ["".join(rng.choice(list("ab1@.+- ()20%_\né"), int(rng.integers(1, 40)))) for _ in range(4000)]
    drawn += ["4111 1111 1111 1111", "a@b.c_d@e.f", "1.2.3.4.5.6.7.8", "+1 (784) 555-8120.", "x@y", "@@a@b.c", "999.1.1.1", "4111-1111-1111-1112"]
    for text in [*drawn, *(t or "" for _, t in rows_of(small))]:
        assert pii.base_spans(text) == plain_spans(text), text[:80]


def test_pattern_spans_take_linear_time():
    for text in ("a" * 200_000, "1" * 5_000 + "." * 3, "a" * 100_000 + "@", "1.2.3." * 30_000, "+" * 100_000, "+1" + " " * 100_000):
        pii.base_spans(text)


def test_field_finds_what_patterns_miss():
    tagger = pii.Tagger(pii.trained())
    held = pii.labelled_table(80, seed=77)
    right = every = 0
    for line in held:
        tags = tagger.field.decode(np.array([tagger.class_of(w) for w, _ in line]), np.array([0, len(line)]), np.array(tagger.tables))
        right += sum(pii.TAGS[t] == g for t, (_, g) in zip(tags, line, strict=True))
        every += len(line)
    assert right / every > 0.98
    texts = pa.array(["see token = \"3f76bb46f51625a07193ae74d1cc485f188b9b5d\" now", "clean words at home, dot by dot\nLicensed under Version 2.0.", ""], pa.large_string())
    assert tagger.spans(texts) == {0: [("secret", 13, 53)]}


def test_viterbi_matches_all_paths():
    field = pii.trained()
    tagger = pii.Tagger(field)
    words = ["call", "+12", "(555)", "x"]
    classes = np.array([tagger.class_of(w) for w in words])
    tables, edge = np.array(tagger.tables), field.weights[:, field.index["edge"]]

    def score(path):
        total = field.first[path[0]]
        for t, tag in enumerate(path):
            total += tables[classes[t], 0, tag]
            total += tables[classes[t - 1], 1, tag] if t else edge[1, tag]
            total += tables[classes[t + 1], 2, tag] if t + 1 < len(path) else edge[2, tag]
            total += field.pairs[path[t - 1], tag] if t else 0
        return total

    best = max(itertools.product(range(len(pii.TAGS)), repeat=4), key=score)
    found = field.decode(np.concatenate((classes, classes[:1])), np.array([0, 0, 4, 5]), tables)
    assert tuple(found[:4]) == best


def test_pii_rows(small, docs):
    got = {r.doc_id: r for r in pii.find(small).collect()}
    for i, text in rows_of(small):
        want = plain_spans(text or "")
        assert tuple(got[i][f"n_{k}"] for k in BASE) == tuple(len(want[k]) for k in BASE)
        assert {f"{k}:{a}:{b}" for k in BASE for a, b in want[k]} <= set(got[i].spans.split(",")) if any(want.values()) else True
    assert pii.find(docs([])).count() == 0 and pii.find(docs([None])).first().spans == ""


def test_importance_resampling(spark, small, docs):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    got = {r.doc_id: r for r in importance.resample(small, labels).collect()}
    n = len(got)
    good = {r.doc_id: r.quality == 1 and r.toxic == 0 for r in labels.collect()}
    assert sum(r.kept for r in got.values()) == round(n * sum(good.values()) / len(good))
    least = min(r.key for r in got.values() if r.kept)
    assert all(r.key <= least for r in got.values() if not r.kept)
    junk = [r.doc_id for r in labels.collect() if r.quality == 0]
    assert np.mean([got[i].kept for i, g in good.items() if g]) > 0.85 and np.mean([got[i].kept for i in junk]) < 0.4
    # weights against plain counting
    feature = lambda t: Counter(importance.hashed(pa.array([t or ""], pa.large_string()))[0].tolist())
    bags, target = {i: feature(t) for i, t in rows_of(small)}, {i for i, g in good.items() if g}
    raw, wanted = Counter(), Counter()
    for i, bag in bags.items():
        raw.update(bag)
        if i in target:
            wanted.update(bag)
    share, m = sum(wanted.values()) / sum(raw.values()), importance.PSEUDO
    for i in list(bags)[-40:]:
        want = sum(k * math.log((wanted[f] - k * (i in target) + m * share) / (raw[f] - k + m) / share) for f, k in bags[i].items())
        assert got[i].log_weight == pytest.approx(want, abs=1e-6) and got[i].n_features == sum(bags[i].values())
    assert importance.resample(docs([]), labels).count() == 0
    none = importance.resample(docs(["a", "b", None, ""]), labels.where("false"), share=0.5).collect()
    assert [r.log_weight for r in none] == [0.0] * 4 and sum(r.kept for r in none) == 2


def test_importance_resampling_holds_few_features():
    rng = np.random.default_rng(5)
    texts = [" ".join(map(str, rng.integers(0, 99_999, 400))) for _ in range(4000)]
    batch = pa.record_batch([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    target = SimpleNamespace(value=np.arange(0, 4000, 3))
    counts = np.frombuffer(next(importance.counts_in(iter([batch]), target)).column(0)[0].as_buffer(), "<i8").reshape(2, -1)
    tracemalloc.start()
    rows = [x.num_rows for x in importance.weights_in(iter([batch]), SimpleNamespace(value=counts), target)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(rows) == len(texts) and peak < 64 << 20


def test_top_k_by_value(spark, monkeypatch):
    monkeypatch.setattr(importance, "FEW", 20)
    rows = spark.range(2000).select((F.col("id") % 700).alias("doc_id"), (F.col("id") % 5).cast("double").alias("key"), F.col("id").alias("row"))
    want = {r.row for r in rows.orderBy(F.desc("key"), "doc_id", "row").limit(777).collect()}
    assert {r.row for r in importance.top_k(rows, 777).where("kept").collect()} == want
    assert importance.top_k(rows, 0).where("kept").count() == 0 and importance.top_k(rows, 5000).where("kept").count() == 2000
    values = spark.createDataFrame([(float(v),) for v in [1] * 500 + [2] * 500 + list(range(3, 40))], "v double")
    assert [importance.kth(values, "v", k) for k in (1, 500, 501, 1000, 1001, 1037)] == [1, 1, 2, 2, 3, 39]
