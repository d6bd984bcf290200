"""Every operator and stage on one table of everything that is odd: nulls in any column, empty and very long texts, ties, repeated rows, extra columns named like internal ones."""

import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cairnspark.llm import exact_dedup, importance, language_id, line_dedup, lm_score, mixing, ngram_join, packing, pii, spotsigs

WORD = re.compile(r"[^\x20\x09-\x0D]+")
CLASHES = ["_id", "_size", "_source", "_key", "_cut", "_group", "_rank", "_at", "_k", "_1", "row", "own", "key", "end", "at", "size", "n_lines", "removed_lines", "rank", "number", "kept", "sid", "text_key", "keep", "stays", "range", "task"]
LONG = " ".join(f"long{k % 977} the" for k in range(450_000))  # one line of 5 MB
PLAIN = "the words of a plain text that every model can read and that is long enough to learn from"


@pytest.fixture(scope="module")
def hard(spark):
    rows = [(None, None, None, None, None), (None, PLAIN, "en", None, None), (None, PLAIN, "en", None, None), (1, "", "en", "a", 0), (2, None, "en", "a", 1), (3, " \n\t\n", None, "a", 4), (4, LONG, "en", "a", len(LONG)), (5, "x" * 1_000_000, "zz", "a", None)]
    rows += [(6, "same row of ten words here again and again and", "en", "rep", 46)] * 5 + [(7, "other text\n" + PLAIN, "en", "b", None), (7, "der die das und ein Text in einer Sprache", "de", "b", None), (8, "one two\nthree four five six\nthree four five six", "en", "b", None)]
    rows += [(9, "ein zwei drei vier fünf sechs sieben acht neun zehn elf", "de", "c", None), (9, "漢字 and — “quotes” \u0000 naïve", "xx", "é", None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return frame.withColumns({c: F.lit(f"own {c}") for c in CLASHES}).repartition(3).cache()


@pytest.fixture(scope="module")
def none(hard):
    return hard.where("doc_id = -5")


def words(text):
    return len(WORD.findall(text or ""))


def intact(out, docs):
    """Extra columns keep names and values."""
    assert out.columns[: len(docs.columns)] == docs.columns
    rows = out.select(*CLASHES).distinct().collect()
    assert all(r[c] == f"own {c}" for r in rows for c in CLASHES)
    return out.collect()


def test_line_dedup(hard, none):
    got = intact(line_dedup.clean(hard), hard)
    assert len(got) == hard.count() and line_dedup.clean(none).count() == 0
    assert {"n_lines_", "n_removed", "removed_lines_"} <= set(line_dedup.clean(hard).columns)
    eight = next(r for r in got if r.doc_id == 8)
    assert eight.text == "one two\nthree four five six" and eight.removed_lines_ == [2]
    assert all(r.text is None for r in got if r.doc_id == 2)


def test_lines_near_one_of_a_null_id(docs):
    first, later = "one two three four five six seven eight nine ten", "one two three four five six seven eight nine ten more"
    got = {r.doc_id: r.text for r in line_dedup.clean(docs([(None, first, None, None, None), (1, later, None, None, None)])).collect()}
    assert got == {None: first, 1: ""}


def test_lm_score(hard, none):
    got = lm_score.score(hard, F.coalesce(F.col("doc_id") % 5 == 1, F.lit(False))).collect()
    texts = Counter(words(r.text) + 1 for r in hard.select("text").collect())
    assert Counter(r.n_tokens for r in got) == texts and all(r.score < 0 for r in got)
    assert lm_score.score(none, F.lit(False)).count() == 0


def test_spotsigs(hard, none):
    got = spotsigs.fingerprint(hard).collect()
    by = defaultdict(set)
    for r in got:
        by[r.doc_id].add(tuple(r.signatures))
    assert by[6] and len(by[6]) == 1 and len(got) == hard.count() and spotsigs.fingerprint(none).count() == 0
    assert spotsigs.edited(hard).count() == hard.count() and spotsigs.edited(none).count() == 0


def test_mixing(hard, none):
    planned, mixed = mixing.plan(hard).collect(), intact(mixing.mix(hard), hard)
    for source in {r.source for r in planned}:
        own = [r for r in planned if r.source == source]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 0.5
        assert sum(words(r.text) for r in mixed if r.source == source) == sum(r.taken for r in own)
    assert mixing.mix(none).count() == 0


@pytest.mark.parametrize("n,other", [(5, 3), (4, 40), (1, 9)])
def test_mix_keeps_to_the_plan_with_repeated_rows(docs, n, other):
    rows = [(1, "ten words that are in a row of their own", "en", "a", 40)] * n + [(k + 2, "some words " * 5, "en", "b", 40) for k in range(other)]
    frame = docs(rows).repartition(3)
    planned, mixed = mixing.plan(frame).collect(), mixing.mix(frame).collect()
    for source in "ab":
        assert sum(words(r.text) for r in mixed if r.source == source) == sum(r.taken for r in planned if r.source == source)


def test_packing(hard, none):
    pieces = packing.pieces(hard).withColumns({c: F.lit(f"own {c}") for c in ("_group", "_rank", "row", "group", "base", "inner", "rank", "at")})
    placed = packing.place(pieces)
    assert placed.columns == [*pieces.columns, "sequence_id", "offset"]
    at = defaultdict(list)
    for r in placed.collect():
        at[r.sequence_id].append((r.offset, r.length))
        assert r._rank == "own _rank" and r.base == "own base"
    for x in at.values():
        ends = 0
        for offset, length in sorted(x):
            assert offset == ends
            ends += length
        assert ends <= packing.SIZE
    assert packing.pack(none).count() == 0


def test_importance(hard, none, spark):
    labels = spark.createDataFrame([(1, 1, 0), (4, 1, 0), (None, 1, 0), (7, 0, 1), (7, 1, None)], "doc_id long, quality int, toxic int")
    got = importance.resample(hard, labels, share=0.5)
    assert got.count() == hard.count() and got.where("kept").count() == round(0.5 * hard.count())
    assert importance.resample(none, labels).count() == 0


def test_language_id(hard, none, docs):
    model = language_id.fit(hard)
    assert model.languages == ["de", "en", "xx", "zz"]
    got = language_id.predict(hard, model).collect()
    assert len(got) == hard.count() and all(0 <= r.score <= 1 for r in got)
    kept = language_id.keep_identified(hard, model)
    assert {r.doc_id for r in intact(kept, hard)} >= {None, 4, 6} and kept.where("text IS NULL").count() == 0
    assert language_id.fit(none).languages == [] and language_id.keep_identified(none, model).count() == 0
    assert language_id.fit(docs([(None, PLAIN, "en", "a", None)] * 8)).languages == ["en"]
    assert language_id.fit(docs([(1, "die " * 20_000, "de", "a", None)])).languages == ["de"]


def test_empty_batches_are_passed_over(hard):
    """Partitions and batches without rows come before others."""
    model = language_id.fit(hard)
    spread = hard.select("doc_id", "text").repartition(40).union(hard.where("doc_id = 99").select("doc_id", "text"))
    assert language_id.keep_identified(spread, model).count() == language_id.keep_identified(hard, model).count()


def test_exact_dedup(hard, none):
    got = exact_dedup.decisions(hard).collect()
    rows = hard.select("doc_id", "text").collect()
    distinct = {re.sub(r"[\x20\x09-\x0D]", "", r.text or "") for r in rows}
    assert len(got) == len(rows) and sum(r.kept for r in got) == len(distinct) == len({r.text_sha256 for r in got})
    assert len(intact(exact_dedup.keep_unique(hard), hard)) == len(distinct)
    assert exact_dedup.keep_unique(none).count() == 0


def test_pii(hard, none):
    hard = hard.withColumn("text", F.substring("text", 1, 1_000_000))  # a line is decoded word after word
    assert pii.find(hard).count() == hard.count() and pii.find(none).count() == 0


def test_ngram_join(hard, none):
    got = ngram_join.components(hard).collect()
    assert len(got) == hard.count() and {r.component_id for r in got if r.doc_id == 6} == {6}
    assert {r.n_shingles for r in got if r.doc_id == 5} == {1}
    kept = intact(ngram_join.keep_one(hard), hard)
    assert Counter(r.doc_id for r in kept) == {None: 2, 1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 1, 7: 1, 8: 1, 9: 2}
    assert ngram_join.keep_one(none).count() == 0


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages(spark, hard, none, name, stage):
    out = stage(spark, hard, "")
    if name != corpus_pipeline.STAGES[-1][0]:
        intact(out, hard)
        assert out.columns == hard.columns
    assert out.count() and stage(spark, none, "").count() == 0
