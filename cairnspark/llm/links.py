"""Links between sets that share signatures, verified pair by pair, and the components that they give.

Postings are (key, sid, n): a signature, a set that has it, and the set's size.  Two sets may be similar if they share a
signature and their sizes fit.  Candidates are verified by the exact size of their intersection, in three rounds.  The first
takes, under each signature, every set and the next by size: as many pairs as postings, whatever the lists' lengths.  Its
links give components.  The others look only at signatures whose sets aren't all of one component by then and that have pairs
not met yet, at pairs of different components, and at those only whose sketches allow it: parities of tokens in WIDTH words
of 64 bits, which can't differ in more bits than the sets differ in tokens.  No set travels for a pair whose sketches don't.  The second takes every set and the NEAR next, the third all pairs
that are left, each under the first of the signatures that it shares: of every set a posting carries the PRIOR signatures
before its own, and where two sets have one of them in common, the pair is met there.  Near copies are mostly one component before it; documents that share passages but aren't similar are pairs
that fail, and never a group.

Everything is DataFrame expressions, and lists longer than LIST are dealt over several tasks.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairnspark.operators.components import connected_components

from .common import id_key, join_groups, materialise
from .groups import beside

#: Sets of a list that one task holds, about.
LIST = 1024
#: Words of a sketch, and how many of the next sets by size a set meets in the second round.
WIDTH, NEAR = 16, 8
WORDS = [f"w{k}" for k in range(WIDTH)]
#: How many of a set's earlier signatures tell that a pair has been met; more signatures between two shared ones only repeat the pair.
PRIOR = 8


def listed(postings: DataFrame) -> DataFrame:
    """The distinct ``postings`` with ``all``, the number of sets under their signature, if several, and with the ``part`` of its ``parts`` that a set is dealt to by a hash."""
    lists = materialise(postings.groupBy("key").agg(F.count("*").alias("all")).where("all > 1").withColumn("parts", F.ceil(F.col("all") / LIST)))
    return materialise(join_groups(postings, lists, "key", "all", postings.count()).withColumn("part", F.pmod(F.xxhash64("sid"), "parts")))


def neighbours(rows: DataFrame) -> DataFrame:
    """Distinct pairs (src < dst) of sets next to each other by size under a signature, if their sizes fit; ``rows`` are :func:`listed`.

    A long list is in parts; the first set of each size in each part ties the parts together.
    """

    def adjacent(rows: DataFrame, *keys: str) -> DataFrame:
        order = Window.partitionBy(*keys).orderBy("n", "sid")
        both = rows.select(F.col("sid").alias("b"), "n", F.lag("sid").over(order).alias("a"), F.lag("n").over(order).alias("na"))
        return both.where("a <> b AND 5 * na >= 4 * n").select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"))

    ties = rows.where("parts > 1").groupBy("key", "part", "n").agg(F.min("sid").alias("sid"))
    return adjacent(rows, "key", "part").unionByName(adjacent(ties, "key")).distinct()


def sketches(sets: DataFrame) -> DataFrame:
    """(sid, tokens) with the size and w0, w1, ...: bit b of word k is the parity of the number of tokens with these remainders."""
    bit = lambda t: F.call_function("shiftleft", F.lit(1).cast("long"), t.bitwiseAND(F.lit(63)).cast("int"))
    word = lambda t: F.shiftright(t, 6).bitwiseAND(F.lit(WIDTH - 1))
    parity = lambda k: F.aggregate(F.filter("tokens", lambda t: word(t) == k), F.lit(0).cast("long"), lambda x, t: x.bitwiseXOR(bit(t)))
    return sets.select("sid", "tokens", F.size("tokens").alias("size"), *[parity(k).alias(w) for k, w in enumerate(WORDS)])


def unresolved(postings: DataFrame, labels: DataFrame, sets: DataFrame) -> DataFrame:
    """The postings of signatures whose sets are of several components (``labels``: sid, root), with root, sketch, ``prior`` (the set's last such signatures before this one), the list's largest component ``main`` and its ``parts``."""
    rows = materialise(postings.join(labels, "sid", "left").withColumn("root", F.coalesce("root", "sid")))
    per_root = rows.groupBy("key", "root").agg(F.count("*").alias("m"))
    lists = per_root.groupBy("key").agg(F.max(F.struct("m", "root")).alias("most"), F.sum("m").alias("all"), F.count("*").alias("roots")).where("roots > 1")
    lists = materialise(lists.select("key", F.col("most.root").alias("main"), "all", F.ceil((F.col("all") - F.col("most.m")) / LIST).alias("parts"), F.ceil(F.col("all") / LIST).alias("deals")))
    before = Window.partitionBy("sid").orderBy("key").rowsBetween(-PRIOR, -1)
    held = join_groups(rows, lists, "key", "all", rows.count()).withColumn("prior", F.collect_list("key").over(before))
    return materialise(held.join(sets.select("sid", *WORDS), "sid"))


def differing(a: Column, b: Column) -> Column:
    """In how many bits the sketches in the structs ``a`` and ``b`` differ."""
    return reduce(add, [F.bit_count(a[w].bitwiseXOR(b[w])) for w in WORDS])


def fits(a: Column, b: Column) -> Column:
    """Whether the sets in the structs ``a`` and ``b`` are of different components and may be similar: those that are differ in a ninth of their tokens at most."""
    return (a["root"] != b["root"]) & (5 * F.least(a["n"], b["n"]) >= 4 * F.greatest(a["n"], b["n"])) & (9 * differing(a, b) <= a["n"] + b["n"])


def pairs_of(rows: DataFrame) -> DataFrame:
    return rows.select(F.least("a.sid", "b.sid").alias("src"), F.greatest("a.sid", "b.sid").alias("dst")).distinct()


NODE = ["sid", "n", "root", *WORDS]


def nearby(rows: DataFrame) -> DataFrame:
    """Distinct pairs of the :func:`unresolved` postings ``rows``: each set and the NEAR next by size under its signature that fit."""
    dealt = rows.select("key", F.pmod(F.xxhash64("sid"), "deals").alias("part"), F.struct(*NODE).alias("a"))
    order = Window.partitionBy("key", "part").orderBy("a.n", "a.sid")
    others = dealt.select("a", F.array(*[F.lead("a", k).over(order) for k in range(1, NEAR + 1)]).alias("others"))
    return pairs_of(others.select("a", F.explode(F.filter("others", lambda b: b.isNotNull() & fits(F.col("a"), b))).alias("b")))


def crossing(rows: DataFrame) -> DataFrame:
    """Distinct pairs of the :func:`unresolved` postings ``rows`` that fit.

    Under each signature the sets outside its largest component meet all; where there are many, in several tasks.
    """
    few = rows.where("root <> main").select("key", F.pmod(F.xxhash64("sid"), "parts").alias("part"), F.struct(*NODE, "prior").alias("a"))
    every = rows.select("key", "main", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.struct(*NODE, "prior").alias("b"))
    first = ~F.arrays_overlap("a.prior", "b.prior")  # under the least signature of a pair, nothing before it is shared
    once = (F.col("b.root") == F.col("main")) | (F.col("a.sid") < F.col("b.sid"))  # of two small components each meets the other
    return pairs_of(few.join(every, ["key", "part"]).where(once & fits(F.col("a"), F.col("b")) & first))


def met(pairs: DataFrame, sets: DataFrame, columns: list[str]) -> DataFrame:
    """The materialised ``pairs`` (src, dst) with ``columns`` of both sets as the structs a and b; only sets that are in a pair travel."""
    of = lambda end, name: sets.select(F.col("sid").alias(end), F.struct(*columns).alias(name))
    ends = materialise(pairs.select("dst").distinct())
    return beside(of("src", "a"), pairs, ["src"]).join(beside(of("dst", "b"), ends, ["dst"]), "dst")


def linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The materialised ``pairs`` (src, dst) with a Jaccard coefficient of at least 0.8, in integers: 100 * both >= 80 * (n_a + n_b - both); sets travel if sketches allow that."""
    a, b = F.col("a"), F.col("b")
    likely = materialise(met(pairs, sets, ["size", *WORDS]).where(9 * differing(a, b) <= a["size"] + b["size"]).select("src", "dst"))
    both = F.size(F.array_intersect(a["tokens"], b["tokens"]))
    return met(likely, sets, ["tokens"]).where(9 * both >= 4 * (F.size(a["tokens"]) + F.size(b["tokens"]))).select("src", "dst")


def links_of(postings: DataFrame, sets_of: Callable[[DataFrame], DataFrame], one_task: int = 0) -> DataFrame | None:
    """Links (src, dst), enough of them to give the components; None without a candidate.  ``sets_of`` gives (sid, tokens array<bigint>) of the wanted (sid); ``one_task`` as in :func:`connected_components`, 0 for DataFrame expressions only."""
    shared = materialise(postings.groupBy("key").agg(F.min("sid").alias("low"), F.max("sid").alias("high")).where("low < high").select("key"))
    postings = listed(materialise(beside(postings, shared, ["key"]).distinct()))
    pairs = materialise(neighbours(postings))
    if pairs.isEmpty():
        return None
    wanted = materialise(pairs.select(F.col("src").alias("sid")).unionByName(pairs.select(F.col("dst").alias("sid"))).distinct())
    sets = materialise(sketches(sets_of(wanted)))
    if sets.count() > wanted.count():  # repeated rows were read by several tasks
        sets = materialise(sets.dropDuplicates(["sid"]))
    links = materialise(linked(pairs, sets))
    for more, done in ((nearby, 2), (crossing, max(2, min(NEAR + 1, LIST)))):  # all pairs under signatures of so many sets have been met
        labels = connected_components(links, one_task=one_task).select(F.col("id").alias("sid"), F.col("component").alias("root"))
        found = materialise(more(unresolved(postings.where(F.col("all") > done).select("key", "sid", "n"), labels, sets)).join(pairs, ["src", "dst"], "left_anti"))
        links = materialise(links.unionByName(linked(found, sets)))
        pairs = pairs.unionByName(found)
    return links


def nodes_of(rows: DataFrame) -> DataFrame:
    """One row per set of ``rows`` (doc_id, text_key, n, sid): sid, n, owner (smallest id and text), doc_id and copies."""
    owner = F.min(F.struct(id_key().alias("id"), F.col("text_key").alias("text"))).alias("owner")
    return rows.where("sid IS NOT NULL").groupBy("sid").agg(F.max("n").alias("n"), owner, F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


def labelled(rows: DataFrame, nodes: DataFrame, links: DataFrame | None, one_task: int = 0) -> DataFrame:
    """``rows`` with component_id, the smallest doc_id of the component, and ``keep``, its smallest (id, text), null in a component of one row."""
    rooted = nodes.withColumn("root", F.col("sid"))
    if links is not None:
        labels = connected_components(links, one_task=one_task).select(F.col("id").alias("sid"), F.col("component").alias("root"))
        rooted = nodes.join(labels, "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    rooted = materialise(rooted.select("sid", "owner", "doc_id", "copies", "root"))
    per_root = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.min("owner").alias("keep"), F.sum("copies").alias("rows"), F.count("*").alias("sets"))
    several = materialise(per_root.where("rows > 1").drop("rows"))
    known = materialise(join_groups(rooted.select("sid", "copies", "root"), several, "root", "sets", rooted.count()).select("sid", "copies", "component_id", "keep"))
    out = join_groups(rows, known, "sid", "copies", rows.count(), "left")
    return out.select(*rows.columns, F.coalesce("component_id", "doc_id").alias("component_id"), "keep")
