"""Document fingerprints (native): SpotSigs.

A signature is an anchor (a very common word) with the chain of the CHAIN content words that follow it, other anchors
skipped.  The fingerprint of a text is its set of signatures; likeness is the Jaccard coefficient of two sets.  The start
of the text is an anchor, and so is every word with more than GAP words since the last one, so that tables and other
text without common words have signatures too; a text of fewer than FEW words also has each of them as a signature.  Only
a text without words has an empty fingerprint.

:func:`groups_of` joins documents whose fingerprints have a likeness of 0.8 or more.  Sets are partitioned by length: under a
signature a set meets those of fitting length only.  Of each set only the signatures that come first in an order by rarity
(by counts in hashed cells, which are the same everywhere and don't decide what is found) are searched, one more than a
similar set may miss; candidates are then compared, as :mod:`links` says.

Everything is DataFrame expressions.  Defined results: a null text is empty; two empty fingerprints have likeness 1;
equal texts have equal fingerprints; an empty one is grouped with nothing; a null id comes before all others and names a
group only without others; rows with equal ids are ordered by text; a table of one row is its own next; an empty table
gives an empty result; extra columns aren't read, but for those that :func:`with_next` is told to carry.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import groups, links
from .common import FIRST, brief_shuffles, id_key, materialise, only, table, text_key
from .groups import beside

#: Common words of English, German, French and Spanish.
ANCHORS = {
    "en": "a an and are as at be been but by can could do for from had has have he her his i if in is it its my no not of on one or our she so that the their them there they this to was we were what when which who will with would you your",
    "de": "als am an auch auf aus bei das dass dem den der des die du ein eine einem einen einer er es für hat ich ihr im in ist mit nach nicht noch nur oder sich sie sind so über um und von war was wie wir zu zum zur",
    "fr": "à au aux avec ce ces cette dans de des du elle en est et eu il ils je la le les leur lui ma mais me mes mon ne nous on ou par pas pour qu que qui sa se ses si son sont sur un une vous y",
    "es": "al como con de del desde donde el ella en entre era es esta este están fue ha hay la las le lo los más me mi muy no nos o para pero por que se ser si sin sobre son su sus también un una y ya",
}
CHAIN, GAP, FEW = 3, 4, 8
BLANK = r"[\x20\x09-\x0D]+"
#: Characters dropped at both ends of a word.
EDGE = ".,;:!?\"'()[]{}*#%$&|"


def signatures(text: Column, chain: int = CHAIN) -> Column:
    """The sorted distinct signatures of a text as 64-bit integers."""
    anchors = sorted({w for words in ANCHORS.values() for w in words.split()})
    words = F.filter(F.transform(F.split(F.lower(F.coalesce(text, F.lit(""))), BLANK), lambda w: F.btrim(w, F.lit(EDGE))), lambda w: w != "")
    # one struct of arrays, so that each array is built once for a text: nested transforms over a one-element array bind names
    bind = lambda value, use: F.transform(F.array(value), use)[0]

    def of(words: Column) -> Column:
        content = F.filter(words, lambda w: ~w.isin(*anchors))
        places = F.concat(F.array(F.lit(-1)), F.filter(F.transform(words, lambda w, i: F.when(w.isin(*anchors), i)), lambda i: i.isNotNull()))

        def chains(content: Column, places: Column) -> Column:
            n, last = F.size(words), F.size(content) - chain

            def starts(place: Column, j: Column) -> Column:
                begin, end = place + 1 + GAP, F.coalesce(F.get(places, j + 1), n) - 1
                here = F.concat(F.array(place), F.when(begin <= end, F.sequence(begin, end)).otherwise(F.array().cast("array<int>")))
                # a word at place i with j anchors up to it has its chain begin at content word i - j + 1
                return F.transform(F.filter(here, lambda i: i - j + 1 <= last), lambda i: F.xxhash64(F.get(words, i), *[F.get(content, i - j + 1 + q) for q in range(chain)]))

            return F.flatten(F.transform(places, starts))

        found = bind(content, lambda c: bind(places, lambda p: chains(c, p)))
        return F.concat(found, F.when((F.size(words) < FEW), F.transform(words, lambda w: F.xxhash64(w))).otherwise(F.array().cast("array<bigint>")))

    return F.array_sort(F.array_distinct(bind(words, of)))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard coefficient of two arrays of distinct values, 1 if both are empty."""
    both = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - both
    return F.when(union == 0, F.lit(1.0)).otherwise(both.cast("double") / union)


def as_text(signature_set: Column) -> Column:
    return F.array_join(F.transform(signature_set, lambda h: F.lower(F.lpad(F.hex(h), 16, "0"))), " ")


#: Bytes of text that a range of ids has, about, and ranges that are told apart at a time.
RANGE_BYTES, STEP = 16 << 20, 64


def with_next(docs: DataFrame, ranges: int | None = None, carried: list[str] | None = None, derived: dict[str, Column] | None = None) -> DataFrame:
    """doc_id, text, next_text (the text of the following document in ascending doc_id, of the first one after the last), the columns ``carried``, and those ``derived`` from text, with those of the next as next_...

    Texts are dealt by ranges of ids, once; there are as many as the texts have multiples of RANGE_BYTES.  The first document
    of each range goes to the range before it too, as a ghost that only serves as the next of that range's last.
    """
    carried, derived = carried or [], derived or {}
    facts = docs.select(id_key().alias("k"), F.octet_length("text").alias("bytes")).agg(F.min("k").alias("low"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).first()
    low = FIRST if facts.low is None else facts.low
    ranges = ranges or max(8, facts.bytes // RANGE_BYTES)
    cuts = docs.select(id_key().alias("k")).agg(F.percentile_approx("k", [j / ranges for j in range(1, ranges)] or [0.5], max(10_000, 4 * ranges))).first()[0]
    begins = sorted({low, *(cuts or [])})  # each is the id of a document
    array = lambda values: F.array(*[F.lit(b).cast("long") for b in values])
    upto = lambda values: F.aggregate(values, F.lit(0), lambda n, b: n + (b <= F.col("k")).cast("int"))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), id_key().alias("k"), *carried)
    rows = rows.withColumn("coarse", (upto(array(begins[::STEP])) - 1) * STEP)
    rows = rows.withColumn("own", F.col("coarse") + upto(F.slice(array(begins), F.col("coarse") + 1, STEP)) - 1)
    ghost = F.struct(F.when(F.col("own") == 0, F.lit(len(begins) - 1)).otherwise(F.col("own") - 1).alias("range"), F.lit(1).alias("ghost"))
    self_ = F.struct(F.col("own").alias("range"), F.lit(0).alias("ghost"))
    first = F.element_at(array(begins), F.col("own") + 1) == F.col("k")
    dealt = rows.withColumn("at", F.explode(F.when(first, F.array(self_, ghost)).otherwise(F.array(self_)))).select("doc_id", "text", "k", *carried, "at.*")
    dealt = dealt.repartition(max(1, ranges), "range").withColumns(derived) if derived else dealt.repartition(max(1, ranges), "range")
    order = Window.partitionBy("range").orderBy("ghost", "k", "text")
    ahead = {f"next_{c}": F.lead(c).over(order) for c in ("text", *derived)}
    return dealt.select("*", *[c.alias(name) for name, c in ahead.items()]).where("ghost = 0").select("doc_id", "text", *carried, *derived, *ahead)


def edited(docs: DataFrame, carried: list[str] | None = None, derived: dict[str, Column] | None = None) -> DataFrame:
    """What :func:`with_next` gives, and edited: the last quarter of the code points replaced by as many of the next text."""
    n = F.length("text")
    cut = F.floor(n / 4).cast("int")
    text = F.concat(F.substring(F.col("text"), F.lit(1), n - cut), F.substring(F.col("next_text"), F.lit(1), cut))
    return with_next(docs, None, carried, derived).withColumn("edited", text)


def fingerprint(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id and ``signatures``: the fingerprint of each document as an array."""
    return docs.select(F.col(id_column).alias("doc_id"), signatures(F.col(text_column)).alias("signatures"))


#: Cells that signatures are counted in, and the length from which a set can be similar to another.
CELLS, LEAST = 1 << 16, 4
#: Postings of a signature up to which each is held against the others before any travels on.
SHORT = 32


def once(held: DataFrame, nodes: DataFrame) -> DataFrame:
    """``held`` without the copies of a set, as far as BROADCAST_ROWS repeated sets; beyond, the copies only make more postings."""
    repeated = materialise(nodes.where("copies > 1").select(F.col("sid").alias("same"), "owner"))
    if repeated.count() > groups.BROADCAST_ROWS:
        return held
    own = F.struct(id_key().alias("id"), F.col("text_key").alias("text"))
    return held.join(F.broadcast(repeated), (F.col("sid") == F.col("same")) & (F.col("owner") != own), "left_anti")


def meeting(held: DataFrame) -> DataFrame:
    """Postings (key, sid, n) of the signatures that may be the first that two similar sets share; ``held``: sid, n and the sorted ``prefix``.

    ``rest`` counts a set's signatures from this one on.  Two sets have nothing in common before the first that they share,
    so their overlap is the smaller rest at most, and similar ones have 9 * overlap >= 4 * (n + n).  Under a signature of up
    to SHORT postings those stay that pass with another; of one that has more, all stay.
    """
    ends = F.transform("prefix", lambda x, at: F.struct(x.s.alias("key"), (F.col("n") - at).alias("rest")))
    every = materialise(held.select(F.explode(ends).alias("x"), "sid", "n").select("x.key", "sid", "n", "x.rest"))
    lists = every.groupBy("key").agg(F.count("*").alias("all"), F.sum("n").alias("total"), F.min("rest").alias("least"))
    wanted = materialise(lists.where("all > 2 OR all = 2 AND 9 * least >= 4 * total").select("key", "all"))
    found = materialise(beside(every, wanted, ["key"]))
    short = found.where(f"all > 2 AND all <= {SHORT}").groupBy("key").agg(F.collect_list(F.struct("sid", "n", "rest")).alias("own"))
    passes = lambda x, y: (x.sid != y.sid) & (9 * F.least(x.rest, y.rest) >= 4 * (x.n + y.n))
    kept = short.select("key", F.explode(F.filter("own", lambda x: F.exists("own", lambda y: passes(x, y)))).alias("x"))
    return found.where(f"all = 2 OR all > {SHORT}").select("key", "sid", "n").unionByName(kept.select("key", "x.sid", "x.n"))


def groups_of(docs: DataFrame) -> DataFrame:
    """doc_id, text_key and group_id, the smallest doc_id that links of likeness 0.8 or more lead to: one row per row."""
    prints = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("text_key"), signatures(F.col("text")).alias("signatures"))
    prints = materialise(prints.withColumns({"n": F.size("signatures").cast("long"), "sid": F.when(F.size("signatures") > 0, F.xxhash64("signatures"))}))
    rows = prints.select("doc_id", "text_key", "n", "sid")
    nodes = materialise(links.nodes_of(rows))
    cell = lambda s: F.pmod(s, F.lit(CELLS).cast("long")).cast("int")
    counts = prints.select(F.explode("signatures").alias("s")).groupBy(cell(F.col("s")).alias("cell")).agg(F.count("*").alias("often"))
    every = prints.sparkSession.range(CELLS).select(F.col("id").cast("int").alias("cell")).join(counts, "cell", "left")
    steps = F.struct("cell", F.round(8 * F.log2(F.coalesce("often", F.lit(1)).cast("double"))).cast("int").alias("steps"))
    steps = every.agg(F.transform(F.array_sort(F.collect_list(steps)), lambda x: x.steps).alias("steps")).withColumn("one", F.lit(1))  # one row of CELLS numbers
    ranked = F.array_sort(F.transform("signatures", lambda s: F.struct(F.get("steps", cell(s)).alias("steps"), s.alias("s"))))
    prefix = F.slice(ranked, 1, (F.col("n") - F.ceil(F.col("n") * 4 / 5) + 1).cast("int"))
    held = prints.where(F.col("n") >= LEAST).withColumn("one", F.lit(1)).join(F.broadcast(materialise(steps)), "one")
    postings = only(prints.sparkSession, lambda: meeting(once(held.select("doc_id", "text_key", "sid", "n", prefix.alias("prefix")), nodes)))

    def sets_of(wanted: DataFrame) -> DataFrame:
        owned = materialise(wanted.join(nodes, "sid").select("sid", F.col("owner.id").alias("id_key"), F.col("owner.text").alias("text_key")))
        return beside(prints.select(id_key().alias("id_key"), "text_key", F.col("signatures").alias("tokens")), owned, ["id_key", "text_key"]).select("sid", "tokens")

    found = links.labelled(rows, nodes, links.links_of(postings, sets_of))
    return found.select("doc_id", "text_key", F.col("component_id").alias("group_id"))


def op3_spotsigs(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    with brief_shuffles(spark):
        several = only(spark, lambda: groups_of(docs).where("NOT doc_id <=> group_id").select(id_key().alias("id_key"), "text_key", "group_id").distinct())
    marked = beside(docs.withColumns({"id_key": id_key(), "text_key": text_key()}), several, ["id_key", "text_key"], "left")
    rows = edited(marked.select("doc_id", "text", F.coalesce("group_id", "doc_id").alias("group_id")), ["group_id"], {"a": signatures(F.col("text"))})
    rows = rows.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "a", signatures(F.col("edited")).alias("b"), F.col("next_a").alias("c"), "group_id")
    return rows.select("doc_id", "n_chars", "edited_sha256", as_text(F.col("a")).alias("fingerprint"), as_text(F.col("b")).alias("edited_fingerprint"), likeness(F.col("a"), F.col("b")).alias("near_edited"), likeness(F.col("a"), F.col("c")).alias("near_next"), "group_id")
