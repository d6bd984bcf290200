"""Registered queries over the driver's tables, with the SQL that gives the same rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnspark.frame import points
from cairnspark.functions import arrays, distance
from cairnspark.operators import agreement, density, hierarchy, kmeans, knn, mst, nearest, range_join, reductions, sampling
from cairnspark.sources import points as sources
from cairnspark.sources import results

QUERIES: dict = {}
SQL: dict[str, str] = {}

EMBEDDINGS = "e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS f, label FROM embeddings)"
D2 = "list_sum(list_transform(list_zip({0}, {1}), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"


def query(sql: str | None = None):
    def register(function):
        QUERIES[function.__name__] = function
        if sql:
            SQL[function.__name__] = sql
        return function

    return register


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cloud(spark: SparkSession, sf_dir: str, dims: int | None = None) -> DataFrame:
    return points(read(spark, sf_dir, "embeddings"), "vec_id", "embedding", dims)


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label")


def amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("x"))


def label_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = cloud(spark, sf_dir).join(labels(spark, sf_dir), "id")
    return nearest.group_means(labelled, 64)


MEANS = f"{EMBEDDINGS}, u AS (SELECT label, unnest(f) AS x, generate_subscripts(f, 1) AS j FROM e), m AS (SELECT label, list(a ORDER BY j) AS c FROM (SELECT label, j, avg(x) AS a FROM u GROUP BY label, j) GROUP BY label)"


def _consecutive(name: str, metric: str, sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        x = cloud(spark, sf_dir)
        a, b = x.select("id", F.col("features").alias("a")), x.select((F.col("id") - 1).alias("id"), F.col("features").alias("b"))
        return a.join(b, "id").select("id", F.round(distance.distance(metric, F.col("a"), F.col("b")), 6).alias("distance"))

    QUERIES[name] = run
    SQL[name] = f"WITH {EMBEDDINGS} SELECT a.id, round({sql}, 6) AS distance FROM e a JOIN e b ON b.id = a.id + 1"


_consecutive("dist_sq_euclidean", "sq_euclidean", D2.format("a.f", "b.f"))
_consecutive("dist_manhattan", "manhattan", "list_sum(list_transform(list_zip(a.f, b.f), lambda p: abs(p[1] - p[2])))")
_consecutive("dist_cosine", "cosine", "1 - list_sum(list_transform(list_zip(a.f, b.f), lambda p: p[1] * p[2])) / sqrt(list_sum(list_transform(a.f, lambda x: x * x)) * list_sum(list_transform(b.f, lambda x: x * x)))")


@query(f"WITH {EMBEDDINGS} SELECT id, round(list_sum(list_transform(f, lambda x: x * x)), 6) AS norm_sq FROM e")
def row_norms_sq(spark, sf_dir):
    return cloud(spark, sf_dir).select("id", F.round(distance.norm_sq(F.col("features")), 6).alias("norm_sq"))


BOXES = f"{EMBEDDINGS}, u AS (SELECT id, label, unnest(f) AS x, generate_subscripts(f, 1) AS j FROM e), b AS (SELECT label, j, min(x) AS lo, max(x) AS hi FROM u GROUP BY label, j)"


@query(f"WITH {BOXES} SELECT u.id, b.label AS box, round(sum(greatest(b.lo - u.x, u.x - b.hi, 0) ** 2), 6) AS gap, round(sum(greatest(abs(u.x - b.lo), abs(u.x - b.hi)) ** 2), 6) AS farthest FROM u JOIN b ON u.j = b.j GROUP BY u.id, b.label")
def point_box_distances(spark, sf_dir):
    x = cloud(spark, sf_dir)
    boxes = reductions.bounds(x.join(labels(spark, sf_dir), "id"), "label", 64)
    args = F.col("features"), F.col("low"), F.col("high")
    return x.crossJoin(F.broadcast(boxes)).select("id", F.col("label").alias("box"), F.round(distance.point_box_gap_sq(*args), 6).alias("gap"), F.round(distance.point_box_farthest_sq(*args), 6).alias("farthest"))


@query(f"WITH {BOXES} SELECT a.label AS box_a, b.label AS box_b, round(sum(greatest(a.lo - b.hi, b.lo - a.hi, 0) ** 2), 6) AS gap FROM b a JOIN b ON a.j = b.j GROUP BY a.label, b.label")
def box_box_gaps(spark, sf_dir):
    boxes = reductions.bounds(cloud(spark, sf_dir).join(labels(spark, sf_dir), "id"), "label", 64)
    a, b = (boxes.select(F.col("label").alias(f"box_{s}"), F.col("low").alias(f"l{s}"), F.col("high").alias(f"h{s}")) for s in "ab")
    return a.crossJoin(F.broadcast(b)).select("box_a", "box_b", F.round(distance.box_box_gap_sq(F.col("la"), F.col("ha"), F.col("lb"), F.col("hb")), 6).alias("gap"))


@query(f"WITH {MEANS} SELECT e.id AS i, m.label::BIGINT AS j, round({D2.format('e.f', 'm.c')}, 6) AS d2 FROM e CROSS JOIN m")
def pairwise_sq(spark, sf_dir):
    means = label_means(spark, sf_dir).select(F.col("label").cast("long").alias("id"), F.col("centroid").alias("features"))
    return reductions.pairwise(cloud(spark, sf_dir), means).select("i", "j", F.round("d2", 6).alias("d2"))


@query(f"WITH {EMBEDDINGS}, u AS (SELECT id, unnest(f) AS x, generate_subscripts(f, 1) - 1 AS j FROM e) SELECT a.j::BIGINT AS i, b.j::BIGINT AS j, round(2 * sum(a.x * b.x), 5) AS v FROM u a JOIN u b ON a.id = b.id GROUP BY a.j, b.j")
def gemm_cells(spark, sf_dir):
    cells = reductions.to_cells(cloud(spark, sf_dir))
    turned = cells.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")
    return reductions.gemm(turned, cells, alpha=2.0).select("i", "j", F.round("v", 5).alias("v"))


@query("SELECT c_custkey AS src, s_suppkey AS dst, round((c_acctbal - s_acctbal) ** 2, 4) AS d2 FROM customer JOIN supplier ON (c_acctbal - s_acctbal) * (c_acctbal - s_acctbal) <= 400.0")
def range_join_tables(spark, sf_dir):
    a = points(read(spark, sf_dir, "customer"), "c_custkey", ["c_acctbal"])
    b = points(read(spark, sf_dir, "supplier"), "s_suppkey", ["s_acctbal"])
    return range_join.range_join(a, b, 20.0).select("src", "dst", F.round("d2", 4).alias("d2"))


def _self_join(name: str, dims: int, eps: float) -> None:
    QUERIES[name] = lambda spark, sf_dir: range_join.range_self_join(cloud(spark, sf_dir, dims), eps).select("src", "dst", F.round("d2", 6).alias("d2"))
    SQL[name] = f"WITH {EMBEDDINGS}, p AS (SELECT id, f[1:{dims}] AS f FROM e), q AS (SELECT a.id AS src, b.id AS dst, {D2.format('a.f', 'b.f')} AS d2 FROM p a JOIN p b ON a.id <= b.id) SELECT src, dst, round(d2, 6) AS d2 FROM q WHERE d2 <= {eps * eps!r}"


_self_join("range_self_join_2d", 2, 0.015)
_self_join("range_self_join_64d", 64, 1.15)


@query(f"WITH {EMBEDDINGS}, q AS (SELECT f FROM e WHERE id = (SELECT min(id) FROM e)), r AS (SELECT e.id, {D2.format('e.f', 'q.f')} AS d2 FROM e, q) SELECT id, round(d2, 6) AS d2 FROM r WHERE d2 <= 1.3 * 1.3")
def radius_query(spark, sf_dir):
    x = cloud(spark, sf_dir)
    q = x.orderBy("id").first().features
    return range_join.radius_query(x, q, 1.3).select("id", F.round("d2", 6).alias("d2"))


PAIRS = f"{EMBEDDINGS}, d AS (SELECT a.id, b.id AS nbr, {D2.format('a.f', 'b.f')} AS d2 FROM e a JOIN e b ON a.id <> b.id)"


@query(f"WITH {PAIRS} SELECT id, rank, nbr, round(d2, 6) AS d2 FROM (SELECT id, nbr, d2, row_number() OVER (PARTITION BY id ORDER BY d2, nbr)::INTEGER AS rank FROM d) WHERE rank <= 5")
def knn_exact(spark, sf_dir):
    return knn.knn_join(cloud(spark, sf_dir), 5).select("id", "rank", "nbr", F.round("d2", 6).alias("d2"))


@query()
def knn_graph(spark, sf_dir):
    return knn.knn_graph(cloud(spark, sf_dir), 15).select("id", "rank", "nbr", "d2")


@query(f"WITH {MEANS}, d AS (SELECT e.id, m.label, {D2.format('e.f', 'm.c')} AS d2 FROM e CROSS JOIN m) SELECT id, label, round(d2, 6) AS d2 FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d2, label) AS r FROM d) WHERE r = 1")
def nearest_centroid(spark, sf_dir):
    means = label_means(spark, sf_dir).orderBy("label").collect()  # a row per label
    numbers = F.array(*[F.lit(r.label) for r in means])
    return nearest.assign(cloud(spark, sf_dir), np.array([r.centroid for r in means])).select("id", F.get(numbers, F.col("label")).alias("label"), F.round("d2", 6).alias("d2"))


def _dbscan_sql(dims: int, eps: float, min_pts: int) -> str:
    return f"""RECURSIVE {EMBEDDINGS}, p AS (SELECT id, f[1:{dims}] AS f FROM e),
n AS (SELECT a.id AS a, b.id AS b FROM p a CROSS JOIN p b WHERE {D2.format('a.f', 'b.f')} <= {eps * eps!r}),
g AS (SELECT a AS id, count(*) AS degree, count(*) >= {min_pts} AS is_core FROM n GROUP BY a),
c AS (SELECT id FROM g WHERE is_core),
k AS (SELECT a, b FROM n WHERE a IN (FROM c) AND b IN (FROM c)),
r AS (SELECT id AS a, id AS b FROM c UNION SELECT r.a, k.b FROM r JOIN k ON r.b = k.a),
t AS (SELECT a AS id, min(b) AS root FROM r GROUP BY a),
l AS (SELECT id, dense_rank() OVER (ORDER BY root) - 1 AS label FROM t),
o AS (SELECT n.a AS id, min(l.label) AS label FROM n JOIN l ON n.b = l.id WHERE n.a NOT IN (FROM c) GROUP BY n.a),
labels AS (SELECT p.id, coalesce(l.label, o.label, -1)::INTEGER AS label FROM p LEFT JOIN l ON p.id = l.id LEFT JOIN o ON p.id = o.id)"""


def _dbscan(name: str, dims: int, eps: float) -> None:
    QUERIES[name] = lambda spark, sf_dir: density.dbscan(cloud(spark, sf_dir, dims), eps, 5).labels
    SQL[name] = f"WITH {_dbscan_sql(dims, eps, 5)} SELECT id, label FROM labels"


_dbscan("dbscan_2d", 2, 0.015)
_dbscan("dbscan_8d", 8, 0.2)
_dbscan("dbscan_64d", 64, 1.15)


@query(f"WITH {_dbscan_sql(2, 0.015, 5)} SELECT id, degree, is_core FROM g")
def dbscan_core_flags(spark, sf_dir):
    return density.dbscan(cloud(spark, sf_dir, 2), 0.015, 5).points


@query(f"WITH {_dbscan_sql(4, 0.09, 5)} SELECT label, count(*) AS n FROM labels GROUP BY label")
def dbscan_cluster_sizes(spark, sf_dir):
    return density.dbscan(cloud(spark, sf_dir, 4), 0.09, 5).labels.groupBy("label").agg(F.count("*").alias("n"))


@query(f"WITH {_dbscan_sql(2, 0.015, 5)} SELECT round(avg(CASE WHEN label = -1 THEN 1.0 ELSE 0.0 END), 6) AS noise_fraction FROM labels")
def noise_fraction(spark, sf_dir):
    return agreement.noise_fraction(density.dbscan(cloud(spark, sf_dir, 2), 0.015, 5).labels).select(F.round("noise_fraction", 6).alias("noise_fraction"))


@query(f"WITH {MEANS}, s AS (SELECT label, count(*) AS n FROM e GROUP BY label) SELECT m.label, s.n, (generate_subscripts(m.c, 1) - 1)::INTEGER AS j, round(unnest(m.c), 6) AS mean FROM m JOIN s ON m.label = s.label")
def group_centroids(spark, sf_dir):
    sums = nearest.group_sums(cloud(spark, sf_dir).join(labels(spark, sf_dir), "id"), 64)
    return sums.select("label", "n", F.posexplode(F.transform("sums", lambda s: s / F.col("n"))).alias("j", "m")).select("label", "n", "j", F.round("m", 6).alias("mean"))


@query(f"WITH {EMBEDDINGS}, u AS (SELECT unnest(f) AS x, generate_subscripts(f, 1) - 1 AS j FROM e) SELECT j::INTEGER AS j, count(*) AS n, round(sum(x), 5) AS sum, round(sum(x * x), 5) AS sum_sq, round(var_pop(x), 7) AS variance FROM u GROUP BY j")
def column_variance(spark, sf_dir):
    rows = nearest.column_statistics(cloud(spark, sf_dir))
    return rows.select("j", "n", F.round("sum", 5).alias("sum"), F.round("sum_sq", 5).alias("sum_sq"), F.round("variance", 7).alias("variance"))


@query(f"WITH {MEANS}, d AS (SELECT e.id, min({D2.format('e.f', 'm.c')}) AS d2 FROM e CROSS JOIN m GROUP BY e.id) SELECT round(sum(d2), 4) AS inertia FROM d")
def inertia(spark, sf_dir):
    means = np.array([r.centroid for r in label_means(spark, sf_dir).orderBy("label").collect()])
    return nearest.min_distance(cloud(spark, sf_dir), means).agg(F.round(F.sum("d2"), 4).alias("inertia"))


@query(f"WITH {MEANS}, a AS (SELECT label, c FROM m), b AS (SELECT label + 1 AS label, c FROM m) SELECT a.label, round({D2.format('a.c', 'b.c')}, 6) AS shift FROM a JOIN b ON a.label = b.label")
def centroid_shift(spark, sf_dir):
    means = label_means(spark, sf_dir)
    return nearest.centroid_shift(means, means.select((F.col("label") + 1).alias("label"), "centroid")).select("label", F.round("shift", 6).alias("shift"))


@query("SELECT round(sum(c_acctbal), 2) AS sum FROM customer")
def sum_reduce(spark, sf_dir):
    return reductions.total(amounts(spark, sf_dir)).select(F.round("sum", 2).alias("sum"))


@query("SELECT arg_min(c_custkey, (c_acctbal, c_custkey)) AS id FROM customer")
def argmin_first(spark, sf_dir):
    return reductions.argmin(amounts(spark, sf_dir))


@query("SELECT arg_max(c_custkey, (c_acctbal, -c_custkey)) AS id FROM customer")
def argmax_first(spark, sf_dir):
    return reductions.argmax(amounts(spark, sf_dir))


@query("SELECT c_custkey AS id, c_acctbal AS x FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 10")
def top_k(spark, sf_dir):
    return reductions.top_k(amounts(spark, sf_dir), 10)


@query("SELECT id, grp, x, rank FROM (SELECT c_custkey AS id, c_nationkey AS grp, c_acctbal AS x, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey)::INTEGER AS rank FROM customer) WHERE rank <= 3")
def bottom_k_per_group(spark, sf_dir):
    rows = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("grp"), F.col("c_acctbal").alias("x"))
    return reductions.bottom_k_per_group(rows, "grp", 3)


@query("SELECT o_orderkey AS id, round(sum(o_totalprice) OVER (ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING), 2) AS prefix FROM orders")
def inclusive_scan(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("x"))
    return reductions.inclusive_scan(rows).select("id", F.round("prefix", 2).alias("prefix"))


DRAWS = (0.05, 0.25, 0.5, 0.75, 0.95)


@query("WITH p AS (SELECT o_orderkey AS id, sum(o_totalprice) OVER (ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS prefix, sum(o_totalprice) OVER () AS total FROM orders) SELECT u AS share, min(id) AS id FROM p JOIN (SELECT unnest([0.05, 0.25, 0.5, 0.75, 0.95])::DOUBLE AS u) ON prefix > u * total GROUP BY u")
def prefix_pick(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("w"))
    total = rows.agg(F.sum("w")).first()[0]
    found = sampling.prefix_pick(rows, [u * total for u in DRAWS])
    return spark.createDataFrame(list(zip(DRAWS, found, strict=True)), "share double, id long")


@query()
def weighted_reservoir(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("w"))
    return sampling.weighted_reservoir(rows, 100, 7).select("id", "w")


@query(f"WITH {EMBEDDINGS} SELECT id, (generate_subscripts(f, 1) - 1)::INTEGER AS j, round(unnest(f), 6) AS x FROM (SELECT id, list_transform(range(3, 60, 5), lambda i: f[i]) AS f FROM e WHERE id >= 10 AND id < 400 AND (id - 10) % 7 = 0)")
def slice_rows_columns(spark, sf_dir):
    view = arrays.slice_columns(arrays.slice_rows(cloud(spark, sf_dir), 10, 400, 7), 2, 59, 5)
    return view.select("id", F.posexplode("features").alias("j", "x")).select("id", "j", F.round("x", 6).alias("x"))


@query(f"WITH {EMBEDDINGS}, u AS (SELECT id, unnest(f) AS x, generate_subscripts(f, 1) - 1 AS j FROM e) SELECT j::BIGINT AS id, (row_number() OVER (PARTITION BY j ORDER BY id) - 1)::INTEGER AS j, round(x, 6) AS x FROM u")
def transpose(spark, sf_dir):
    return arrays.transpose(cloud(spark, sf_dir)).select("id", F.posexplode("features").alias("j", "x")).select("id", "j", F.round("x", 6).alias("x"))


@query(f"WITH {EMBEDDINGS} SELECT id, list_bool_and(list_transform(f, lambda x: abs(x - x::DECIMAL(9, 4)::DOUBLE) <= 1e-8 + 1e-3 * abs(x::DECIMAL(9, 4)::DOUBLE))) AS close FROM e")
def all_close(spark, sf_dir):
    rounded = F.transform("features", lambda x: F.round(x, 4))
    return cloud(spark, sf_dir).select("id", arrays.all_close(F.col("features"), rounded, rtol=1e-3).alias("close"))


def _lloyd_sql(dims: int, k: int, steps: int) -> str:
    parts = [EMBEDDINGS, f"p AS (SELECT id, f[1:{dims}] AS f FROM e)", f"c0 AS (SELECT (row_number() OVER (ORDER BY id) - 1)::INTEGER AS label, f FROM p ORDER BY id LIMIT {k})"]
    for s in range(steps + 1):
        parts.append(f"a{s} AS (SELECT id, label, d2 FROM (SELECT p.id, c.label, {D2.format('p.f', 'c.f')} AS d2, row_number() OVER (PARTITION BY p.id ORDER BY {D2.format('p.f', 'c.f')}, c.label) AS r FROM p CROSS JOIN c{s} c) WHERE r = 1)")
        if s < steps:
            means = ", ".join(f"avg(p.f[{j}])" for j in range(1, dims + 1))
            parts.append(f"c{s + 1} AS (SELECT a.label, [{means}] AS f FROM a{s} a JOIN p ON a.id = p.id GROUP BY a.label)")
    return f"WITH {', '.join(parts)} SELECT id, label, round(d2, 6) AS d2 FROM a{steps}"


@query(_lloyd_sql(8, 5, 4))
def kmeans_lloyd_fixed(spark, sf_dir):
    x = cloud(spark, sf_dir, 8)
    start = np.array([r.features for r in x.orderBy("id").limit(5).collect()])
    return kmeans.kmeans(x, 5, max_iter=4, tol=0.0, init=start).labels.select("id", "label", F.round("d2", 6).alias("d2"))


@query()
def kmeans_pp(spark, sf_dir):
    return kmeans.kmeans(cloud(spark, sf_dir), 8, seed=1, max_iter=20).labels


@query()
def kmeans_afkmc2(spark, sf_dir):
    return kmeans.kmeans(cloud(spark, sf_dir), 8, seed=1, max_iter=20, seeder=kmeans.afkmc2_seeds).labels


@query()
def kmeans_ninit(spark, sf_dir):
    return kmeans.kmeans(cloud(spark, sf_dir, 8), 4, seed=3, n_init=3, max_iter=20).labels


CORE = f"{PAIRS}, k AS (SELECT id, nbr, d2, row_number() OVER (PARTITION BY id ORDER BY d2, nbr) AS rank FROM d), core AS (SELECT id, d2 AS core FROM k WHERE rank = 4)"


@query(f"WITH {CORE} SELECT id, round(core, 6) AS core FROM core")
def core_distance(spark, sf_dir):
    return knn.k_distance(cloud(spark, sf_dir), 4).select("id", F.round("d2", 6).alias("core"))


@query(f"WITH {CORE} SELECT u, v, round(greatest(a.core, b.core, d2), 6) AS w FROM (SELECT DISTINCT least(id, nbr) AS u, greatest(id, nbr) AS v, d2 FROM k WHERE rank <= 4) JOIN core a ON a.id = u JOIN core b ON b.id = v")
def mrd_edges(spark, sf_dir):
    graph = knn.knn_join(cloud(spark, sf_dir), 4)
    return mst.mrd_edges(graph, mst.core_distances(graph, 4)).select("u", "v", F.round("w", 6).alias("w"))


@query(f"""WITH RECURSIVE {CORE}, n AS (SELECT d.id AS a, nbr AS b FROM d JOIN core x ON x.id = d.id JOIN core y ON y.id = nbr WHERE greatest(x.core, y.core, d2) <= 1.35),
r AS (SELECT id AS a, id AS b FROM e UNION SELECT r.a, n.b FROM r JOIN n ON r.b = n.a) SELECT a AS id, min(b) AS component FROM r GROUP BY a""")
def mst_cut(spark, sf_dir):
    x = cloud(spark, sf_dir)
    tree, _ = mst.boruvka_mst(x, 4)
    return mst.cut(tree, x, 1.35)


@query()
def mst_prim(spark, sf_dir):
    return mst.prim_mst(cloud(spark, sf_dir, 8), 4)[0]


@query()
def mst_neighbour_graph(spark, sf_dir):
    return mst.neighbour_graph_mst(cloud(spark, sf_dir), 4)[0]


@query()
def hdbscan_eom(spark, sf_dir):
    return hierarchy.hdbscan(cloud(spark, sf_dir, 2), 5).labels


@query()
def hdbscan_leaf(spark, sf_dir):
    return hierarchy.hdbscan(cloud(spark, sf_dir, 2), 5, method="leaf").labels


@query()
def hdbscan_64d(spark, sf_dir):
    return hierarchy.hdbscan(cloud(spark, sf_dir), 5).labels


@query()
def single_linkage(spark, sf_dir):
    return hierarchy.hdbscan(cloud(spark, sf_dir, 2), 5).dendrogram


@query()
def condensed_tree(spark, sf_dir):
    return hierarchy.hdbscan(cloud(spark, sf_dir, 2), 5).condensed


SIGNS = f"{EMBEDDINGS}, s AS (SELECT id, label AS a, (CASE WHEN f[1] > 0 THEN 1 ELSE 0 END + CASE WHEN f[2] > 0 THEN 2 ELSE 0 END) AS b FROM e), c AS (SELECT a, b, count(*) AS n FROM s GROUP BY a, b)"


def signs(spark: SparkSession, sf_dir: str) -> DataFrame:
    sign = lambda j: (F.get("features", F.lit(j)) > 0).cast("int")
    return cloud(spark, sf_dir).select("id", (sign(0) + 2 * sign(1)).alias("label"))


@query(f"WITH {SIGNS} SELECT a, b, n FROM c")
def contingency(spark, sf_dir):
    return agreement.contingency(labels(spark, sf_dir), signs(spark, sf_dir))


@query(f"WITH {SIGNS}, t AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM c) AS s, (SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM c GROUP BY a)) AS sa, (SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM c GROUP BY b)) AS sb, (SELECT sum(n) * (sum(n) - 1) / 2 FROM c) AS al) SELECT round((s - sa * sb / al) / ((sa + sb) / 2 - sa * sb / al), 8) AS ari FROM t")
def ari(spark, sf_dir):
    return agreement.adjusted_rand_index(labels(spark, sf_dir), signs(spark, sf_dir)).select(F.round("ari", 8).alias("ari"))


@query(f"WITH {SIGNS} SELECT id, (b <> a OR a % 4 <> a) AS differs FROM s")
def disagreement(spark, sf_dir):
    truth = labels(spark, sf_dir)
    return agreement.disagreement(truth, signs(spark, sf_dir), truth.select("id", (F.col("label") % 4).alias("label")))


@query()
def aligned_labels(spark, sf_dir):
    return agreement.align_labels(labels(spark, sf_dir), kmeans.kmeans(cloud(spark, sf_dir), 10, seed=2, max_iter=10).labels)[0]


@query("SELECT l_partkey AS id, round(sum(l_extendedprice) / nullif(sum(l_discount), 0), 4) AS ratio FROM lineitem GROUP BY l_partkey HAVING sum(l_discount) > 0")
def safe_ratio(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("id")).agg(F.sum("l_extendedprice").alias("a"), F.sum("l_discount").alias("b"))
    return rows.select("id", F.round(results.safe_ratio(F.col("a"), F.col("b")), 4).alias("ratio")).where(~F.isnan("ratio"))


@query("SELECT 'priority=' || o_orderpriority || '+status=' || o_orderstatus AS slug, count(*) AS n FROM orders GROUP BY ALL")
def slugs(spark, sf_dir):
    params = F.create_map(F.lit("status"), F.col("o_orderstatus"), F.lit("priority"), F.col("o_orderpriority"))
    return read(spark, sf_dir, "orders").select(results.slug(params).alias("slug")).groupBy("slug").agg(F.count("*").alias("n"))


@query()
def knee_radius(spark, sf_dir):
    return spark.createDataFrame([(float(agreement.knee_eps(cloud(spark, sf_dir, 2), 5)),)], "eps double")


@query()
def projection_2d(spark, sf_dir):
    return sources.project_2d(cloud(spark, sf_dir, 8), 8)


@query()
def blobs(spark, sf_dir):
    return sources.make_blobs(spark, 10_000)


@query()
def sphere_groups(spark, sf_dir):
    return sources.make_vmf(spark, 5_000, 32)
