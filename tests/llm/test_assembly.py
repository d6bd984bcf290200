import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from cairnspark.llm import language_id, line_dedup, mixing, ngram_join, packing
from cairnspark.plans import scratch

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_targets_share_all_words():
    sizes = {"b": 100, "a": 1000, None: 5, "é": 0, "c": 300}
    got = mixing.targets_of(sizes)
    assert sum(got.values()) == pytest.approx(sum(sizes.values()))
    assert all(got[s] <= 3 * n + 1e-9 for s, n in sizes.items()) and got["é"] == 0 and got[None] == 15
    # weights a 1, b 2, c 3, é 1, null 2: b, é and null fill up, and the rest is shared 1 to 3
    assert got["b"] == 300 and got["c"] == pytest.approx(3 * got["a"])
    assert mixing.targets_of({}) == {}


def test_mix_is_exact(small):
    got = mixing.plan(small).collect()
    texts = {r.doc_id: r for r in small.collect()}
    by = defaultdict(list)
    for r in got:
        assert r["size"] == len(WORD.findall(texts[r.doc_id].text or "")) and r.source == texts[r.doc_id].source
        assert 0 <= r.taken <= 3 * r["size"]
        by[r.source].append(r)
    for rows in by.values():
        assert {r.source_size for r in rows} == {sum(r["size"] for r in rows)}
        assert abs(sum(r.taken for r in rows) - rows[0].target) <= 0.5
        # whole documents up to the cut, by key: at most one is cut
        assert sum(0 < r.part < r["size"] for r in rows) <= 1
        whole = [r for r in sorted(rows, key=lambda r: r.key) if r["size"]]
        assert all(a.part == a["size"] or not b.part for a, b in zip(whole, whole[1:], strict=False))
    assert sorted(map(str, got)) == sorted(map(str, mixing.plan(small.repartition(7)).collect()))


def test_mixed_documents_have_the_planned_words(small):
    planned = {r.doc_id: r.taken for r in mixing.plan(small).collect()}
    mixed = mixing.mix(small)
    assert mixed.columns == small.columns
    words, copies = Counter(), Counter()
    texts = {r.doc_id: r.text for r in small.collect()}
    for r in mixed.collect():
        words[r.doc_id] += len(WORD.findall(r.text))
        copies[r.doc_id] += 1
        assert (texts[r.doc_id] or "").startswith(r.text)
    assert {i: n for i, n in planned.items() if n} == dict(words)
    assert max(copies.values()) <= 3


def test_mix_edges(docs):
    assert mixing.plan(docs([])).count() == 0 and mixing.mix(docs([])).count() == 0
    none = mixing.plan(docs([(None, None, None, None, None), (1, "", None, None, 0), (1, "", None, None, 0)])).collect()
    assert [r.taken for r in none] == [0, 0, 0]
    assert sum(r.taken for r in mixing.plan(docs([(1, "a b c", None, "x", 5)] * 2)).collect()) == 6


@pytest.fixture(scope="module")
def encoder():
    return packing.encoder(public_tokenizers.path(packing.VOCABULARY), public_tokenizers.path(packing.RANKS))


def ids_of(encoder, text):
    return encoder.tokenizer.encode(text or "", add_special_tokens=False).ids + [packing.END_ID]


ODD = ["a   b \n c\n\n d \t e", " x", "x ", "\x1c a  \x85 b  c", "it's  'll ok", "a\x1c \x1cb", "<|endoftext|> hi", "　 　x", "é z   y", "— “q”  — a", "漢字 かな  語", "", "😀 😀  x", "a  b  c"]


def test_encoder_gives_the_tokenizers_ids(encoder, small):
    slow = packing.Encoder(public_tokenizers.path(packing.VOCABULARY), None)
    for text in [*ODD, *(r.text or "" for r in small.collect())]:
        want = ids_of(encoder, text)[:-1]
        assert np.frombuffer(encoder(text), "<u4").tolist() == np.frombuffer(slow(text), "<u4").tolist() == want, text[:60]
    rng = np.random.default_rng(0)
    for _ in range(300):
        text = "".join(rng.choice(list("ab \n\t'1.—　é"), 30))
        assert np.frombuffer(encoder(text), "<u4").tolist() == np.frombuffer(slow(text), "<u4").tolist() == ids_of(encoder, text)[:-1]


def check_packing(rows, size):
    by, total = defaultdict(list), 0
    for r in rows:
        assert 1 <= r.length <= size
        by[r.sequence_id].append((r.offset, r.length))
        total += r.length
    for places in by.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= size
    return len(by), -(-total // size)


def test_packing_round_trip(small, encoder):
    rows = packing.pack(small).collect()
    used, least = check_packing(rows, packing.SIZE)
    assert used <= least * 1.02 + 1
    pieces = defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
    for d in small.collect():
        ids, own = ids_of(encoder, d.text), sorted(pieces[d.doc_id], key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own))) and own[-1].start + own[-1].length == len(ids)
        assert all(r.length == packing.SIZE for r in own[1:])
        for r in own:
            part = np.array(ids[r.start : r.start + r.length], dtype="<u4")
            assert r.ids_crc32 == zlib.crc32(part.tobytes())


@pytest.mark.parametrize("seed", range(6))
def test_plans_are_tight_and_whole(seed):
    rng = np.random.default_rng(seed)
    lengths = np.minimum(64, np.maximum(1, rng.lognormal(2.5 + 0.3 * seed, 0.8, 4000).astype(int)))
    histogram = np.bincount(lengths, minlength=65)
    runs, n = packing.plan_of(histogram, 64)
    fill, seen = Counter(), Counter()
    for length, rank, number, sequence, offset in runs.tolist():
        assert rank == seen[length]
        seen[length] += number
        for k in range(number):
            fill[sequence + k] += length
            assert offset + length <= 64
    assert seen == Counter({k: v for k, v in enumerate(histogram.tolist()) if v}) and len(fill) == n and max(fill.values()) <= 64
    least = max(-(-int((histogram * np.arange(65)).sum()) // 64), int((lengths > 32).sum()))
    assert n <= 1.02 * least + 1


def test_patterns_fill_sequences():
    found = packing.patterns(np.array([1, 2, 3, 5, 8]), 8)
    assert {tuple(sorted(x)) for x in found.tolist()} == {(0, 0, 8), (0, 3, 5), (1, 2, 5), (2, 3, 3)}


def test_packing_edges(docs):
    assert packing.pack(docs([])).count() == 0
    rows = packing.pack(docs([None, "", (1, "x", None, None, None), (1, "x", None, None, None)])).collect()
    assert sorted((r.doc_id, r.length, r.start) for r in rows) == [(0, 1, 0), (1, 1, 0), (1, 2, 0), (1, 2, 0)]
    assert check_packing(rows, packing.SIZE) == (1, 1)


def test_pipeline_stages(spark, small):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "ngram_jaccard_join", "source_mixing", "pattern_packing"]
    docs = small.select("doc_id", "text", "lang", "source", "n_chars")
    columns, stages = docs.columns, dict(corpus_pipeline.STAGES)
    kept = stages["language_id"](spark, docs, "").persist()
    rejected = {r.doc_id for r in language_id.predict(docs, language_id.fit(docs)).where("rejected").collect()}
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in docs.collect()} - rejected and kept.columns == columns
    lined = stages["line_dedup"](spark, kept, "").persist()
    assert lined.columns == columns and lined.count() == kept.count()
    assert {r.doc_id: r.text for r in lined.collect()} == {r.doc_id: r.text for r in line_dedup.clean(kept).collect()}
    once = stages["ngram_jaccard_join"](spark, lined, "").persist()
    want = {r.component_id for r in ngram_join.components(lined).collect()}
    assert {r.doc_id for r in once.collect()} == want and once.columns == columns
    mixed = stages["source_mixing"](spark, once, "").persist()
    planned = {r.doc_id: r.taken for r in mixing.plan(once).where("taken > 0").collect()}
    words = Counter()
    for r in mixed.collect():
        words[r.doc_id] += len(WORD.findall(r.text))
    assert dict(words) == planned and mixed.columns == columns
    packed = stages["pattern_packing"](spark, mixed, "").collect()
    used, least = check_packing(packed, packing.SIZE)
    assert used <= least * 1.03 + 1 and Counter(r.doc_id for r in packed if r.piece == 0) == Counter(r.doc_id for r in mixed.collect())


def test_pipeline_runs_whole(spark):
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 100


def test_pipeline_leaves_no_scratch_tables(spark, monkeypatch):
    monkeypatch.setattr(corpus_pipeline, "STAGES", [*corpus_pipeline.STAGES[1:2], corpus_pipeline.STAGES[3], ("nothing", lambda spark, docs, sf_dir: docs)])
    before = len(scratch._written)
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert len(scratch._written) == before + 2 and out.count() > 100  # the results of the two stages


def test_registered_queries():
    names = [k for k in __spark_entry__.queries() if re.match(r"op\d+_", k)]
    assert sorted(int(re.match(r"op(\d+)_", k)[1]) for k in names) == list(range(1, 11)) and "pipeline" in __spark_entry__.queries()


@pytest.mark.parametrize("name", ["op1_line_dedup", "op4_source_mixing", "op8_exact_dedup", "op10_ngram_jaccard_join"])
def test_query_matches_sql(spark, name):
    import duckdb

    db = duckdb.connect()
    db.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    ours = __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001").toPandas()
    theirs = db.execute(__spark_entry__.oracle_sql()[name]).df()
    columns = sorted(ours.columns)
    key = lambda f: sorted(map(repr, f[columns].astype(object).itertuples(index=False, name=None)))
    assert columns == sorted(theirs.columns) and key(ours) == key(theirs)
