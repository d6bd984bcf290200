import itertools
import json
import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from cairnspark.frame import dimension, points
from cairnspark.functions import arrays, distance
from cairnspark.operators import agreement, reductions, sampling
from cairnspark.operators.range_join import range_join, range_self_join
from cairnspark.plans import suite
from cairnspark.sources import results as R
from cairnspark.sources.points import as_float32, from_numpy, make_data, make_vmf, project_2d, read_csv, to_numpy, write_csv, write_labels

DATA = "/root/testdata/sf0.001"


def one(spark, expression):
    return spark.range(1).select(expression.alias("v")).first().v


def arr(*v):
    return F.array(*[F.lit(float(x)) for x in v]) if v else F.array().cast("array<double>")


def test_distances(spark):
    assert one(spark, distance.sq_euclidean(arr(), arr())) == 0
    assert one(spark, distance.manhattan(arr(1, -2), arr(0, 0))) == 3
    assert one(spark, distance.cosine(arr(0, 0), arr(1, 0))) == 1
    assert one(spark, distance.point_box_gap_sq(arr(3, 0), arr(0, 0), arr(1, 1))) == 4
    assert one(spark, distance.point_box_farthest_sq(arr(0, 0), arr(0, 0), arr(1, 2))) == 5
    assert one(spark, distance.box_box_gap_sq(arr(0), arr(1), arr(4), arr(5))) == 9
    distance.register_metric("first", lambda a, b: F.abs(F.get(a, F.lit(0)) - F.get(b, F.lit(0))))
    assert one(spark, distance.distance("first", arr(1, 5), arr(4, 9))) == 3
    with pytest.raises(ValueError):
        distance.distance("none", arr(), arr())


def test_arrays(spark):
    nan = float("nan")
    assert one(spark, arrays.array_equal(arr(), arr())) and not one(spark, arrays.array_equal(arr(nan), arr(nan)))
    assert one(spark, arrays.all_close(arr(1.0), arr(1.000001))) and not one(spark, arrays.all_close(arr(nan), arr(nan)))
    assert one(spark, arrays.reshape(arr(1, 2, 3, 4), 2)) == [[1, 2], [3, 4]] and one(spark, arrays.reshape(arr(1, 2, 3), 2)) is None
    x = from_numpy(spark, np.arange(12.0).reshape(4, 3))
    back = arrays.transpose(arrays.transpose(x))
    assert arrays.frames_equal(x, back) and to_numpy(arrays.column(x, 1), "value").tolist() == [1, 4, 7, 10]
    assert [r.features for r in arrays.slice_columns(x, 0, 9, 2).orderBy("id").collect()][0] == [0, 2]
    assert json.loads(arrays.dump(x, 1)) == {"id": 0, "features": [0, 1, 2]}
    with pytest.raises(ValueError):
        arrays.slice_rows(x, 0, 2, 0)


def test_points_are_checked(spark):
    rows = spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "id long, features array<double>")
    with pytest.raises(ValueError):
        dimension(rows)
    with pytest.raises(ValueError):
        dimension(points(spark.createDataFrame([(None, [1.0])], "id long, features array<double>")))
    assert dimension(rows.where("id < 0")) == 0


def test_range_joins(spark):
    rng = np.random.default_rng(0)
    a, b = np.round(rng.random((70, 2)), 1), np.round(rng.random((50, 2)), 1)
    want = {(i, j) for i in range(70) for j in range(50) if ((a[i] - b[j]) ** 2).sum() <= 0.3 * 0.3}
    for plan in ("grid", "block"):
        found = range_join(from_numpy(spark, a), from_numpy(spark, b), 0.3, plan)
        assert {(r.src, r.dst) for r in found.collect()} == want and found.count() == len(want)
        again = range_self_join(from_numpy(spark, a), 0.0, plan)
        assert {(r.src, r.dst) for r in again.collect()} == {(i, j) for i in range(70) for j in range(i, 70) if (a[i] == a[j]).all()}


def test_reductions(spark):
    rows = spark.createDataFrame([(3, 2.0), (1, 5.0), (2, 5.0), (4, 2.0)], "id long, x double")
    assert reductions.argmin(rows).first().id == 3 and reductions.argmax(rows).first().id == 1
    assert [r.id for r in reductions.top_k(rows, 3).collect()] == [1, 2, 3]
    assert reductions.total(rows.where("id < 0")).first().sum == 0 and not reductions.argmin(rows.where("id < 0")).collect()
    a, b, c = (np.random.default_rng(s).random((3, 3)) for s in range(3))
    cell = lambda m: reductions.to_cells(from_numpy(spark, m))
    got = {(r.i, r.j): r.v for r in reductions.gemm(cell(a), cell(b), cell(c), 2.0, 0.5).collect()}
    assert np.allclose([[got[i, j] for j in range(3)] for i in range(3)], 2 * a @ b + 0.5 * c)
    assert not any(math.isnan(r.v) for r in reductions.gemm(cell(a), cell(b), cell(c * np.nan)).collect())


def test_sampling(spark):
    rows = spark.createDataFrame([(i, float(i % 3)) for i in range(30)], "id long, w double")
    assert sampling.prefix_pick(rows, [0.0, 0.99, 1.0, 29.5, 99.0]) == [1, 1, 2, 29, 29]
    picks = sampling.weighted_pick(rows, 400, 1)
    assert set(p % 3 for p in picks) == {1, 2} and 200 < sum(p % 3 == 2 for p in picks) < 330
    drawn = sampling.weighted_reservoir(rows, 10, 1)
    assert drawn.count() == 10 and drawn.where("w = 0").count() == 0
    assert sampling.subsample(rows, 5, 1).collect() == sampling.subsample(rows.repartition(3), 5, 1).collect()
    table = sampling.alias_table(np.array([1.0, 0.0, 3.0]))
    counts = np.bincount(sampling.alias_sample(table, 8000, sampling.generator(1)), minlength=3)
    assert counts[1] == 0 and abs(counts[2] / 8000 - 0.75) < 0.03


def test_agreement(spark):
    frame = lambda v: spark.createDataFrame(list(enumerate(v)), "id long, label int")
    truth, found = frame([0, 0, 1, 1]), frame([5, 5, 3, 3])
    aligned, remap = agreement.align_labels(truth, found)
    assert to_numpy(aligned).tolist() == [0, 0, 1, 1] and remap == {5: 0, 3: 1}
    assert agreement.adjusted_rand_index(truth, found).first().ari == 1
    assert agreement.adjusted_rand_index(frame([0] * 4), frame([1] * 4)).first().ari == 1
    assert agreement.adjusted_rand_index(truth, frame([0, 1, 0, 1])).first().ari == pytest.approx(-0.5)
    cost = np.random.default_rng(2).random((4, 5))
    best = min(sum(cost[i, p[i]] for i in range(4)) for p in itertools.permutations(range(5), 4))
    assert np.isclose(cost[np.arange(4), agreement.hungarian(cost)].sum(), best)
    curve = spark.createDataFrame([(i, 1.0 if i < 90 else float(i - 88)) for i in range(100)], "id long, d double")
    assert 1 <= agreement.knee(curve) <= 2
    assert agreement.resolve_eps("sqrt_d", 2.0, curve, 8, 5) == 4


ROW = {"recipe_name": "kmeans", "size": 10, "dims": 2, "params": {"k": "3", "n_jobs": "1"}, "ours_median_ms": 1.0, "theirs_median_ms": 2.0, "ours_peak_mb": 1.0, "theirs_peak_mb": 1.0, "ari": 0.99, "ours_noise_frac": 0.0, "theirs_noise_frac": 0.0, "speedup": 2.0, "timestamp": "t", "effective_params": {}}


def test_results(spark, tmp_path):
    path = str(tmp_path / "r.json")
    R.save_results(path, R.Metadata(), [ROW])
    assert R.load_results(path) == (R.Metadata(), [ROW])
    (tmp_path / "bare.json").write_text(json.dumps([ROW]))
    assert R.load_results(str(tmp_path / "bare.json"))[0].git_sha == "unknown"
    (tmp_path / "bad.json").write_text('{"x": 1}')
    with pytest.raises(ValueError):
        R.load_results(str(tmp_path / "bad.json"))
    with pytest.raises(ValueError, match="row 0: ari"):
        R.payload_hash6([ROW | {"ari": float("nan")}])
    assert len(R.payload_hash6([ROW])) == 6 and 0 <= R.seed_of("abc123") < 2**32
    assert R.slug_from_params({"b": 1, "a": "x/y"}) == "a=x%2fy+b=1" and R.chart_filename("kmeans", {"k": 3}, "abc123", "vis") == "kmeans_k=3_vis_abc123.png"
    assert R.partition_key(ROW) == ("kmeans", (("k", "3"),)) and R.cell_key(5, 2, 4) == "n=5__d=2__jobs=4"
    with pytest.raises(TypeError):
        R.partition_key(ROW | {"params": {"k": [1]}})
    assert R.representative_dims([2, 8, 32, 64]) == [2, 32, 64]
    frame = R.results_frame(spark, [ROW, ROW | {"ari": 0.5, "size": 20, "ours_peak_mb": float("nan")}])
    assert R.partition(frame).first().partition == "kmeans|k=3"
    with pytest.raises(ValueError):
        R.partition(R.results_frame(spark, [ROW, ROW]))
    reasons = [r.reasons for r in R.gates(frame, spark.createDataFrame([("kmeans", 0.98)], "recipe_name string, threshold double")).orderBy("size").collect()]
    assert reasons[0] == [] and "ari below threshold" in reasons[1] and "ours_peak_mb not finite" in reasons[1]
    picked = R.pick_cells(frame.withColumn("place", F.col("size"))).select("size", R.cell_key_column().alias("k")).collect()
    assert [(r["size"], r.k) for r in picked] == [(20, "n=20__d=2__jobs=1")]
    assert R.expand_grid(R.Recipe("x", [], [], {"b": [1, 2], "a": [0]})) == [{"a": 0, "b": 1}, {"a": 0, "b": 2}]
    cells = spark.createDataFrame([("c", 1, 0)], "cell_key string, id long, ours int")
    R.save_labels(cells, str(tmp_path / "s"), "abc123", "kmeans", {"v": "1"})
    assert R.load_labels(spark, str(tmp_path / "s"), "abc123", "kmeans", {"v": "1"})[0] == "OK"
    assert R.load_labels(spark, str(tmp_path / "s"), "abc123", "kmeans", {"v": "2"})[0] == "WARN"
    assert R.load_labels(spark, str(tmp_path / "s"), "other1", "kmeans")[0] == R.load_labels(spark, str(tmp_path / "none"), "abc123", "kmeans")[0] == "ERROR"


def test_sources(spark, tmp_path):
    x = np.round(np.random.default_rng(1).random((20, 3)), 3)
    write_csv(from_numpy(spark, x), str(tmp_path / "p"))
    back = read_csv(spark, str(tmp_path / "p"), 4, 15)
    assert back.count() == 15 and np.allclose(np.array(to_numpy(back, "features")), np.hstack((x, np.zeros((20, 1))))[:15])
    write_labels(spark.createDataFrame([(1, 7), (0, -1)], "id long, label int"), str(tmp_path / "l"))
    assert [r.value for r in spark.read.text(str(tmp_path / "l")).collect()] == ["-1", "7"]
    sphere = make_vmf(spark, 50, 20, kappa=40.0)
    assert np.allclose(np.linalg.norm(np.array(to_numpy(sphere, "features")), axis=1), 1, atol=1e-5)
    assert make_data(spark, 10, 3).first().label == 0 and dimension(make_data(spark, 10, 20)) == 20
    for d in (2, 5, 20):
        assert dimension(project_2d(make_data(spark, 30, d), d)) == 2
    assert one(spark, F.lit(1)) == as_float32(sphere).count() / 50


def test_command_line(spark, tmp_path):
    (tmp_path / "in.csv").write_text("".join(f"{0.1 * i},0\n" for i in range(5)))
    assert suite.main(["fit", str(tmp_path / "in.csv"), "5", "2", "0.3", "2", str(tmp_path / "out")]) == 0
    assert [r.value for r in spark.read.text(str(tmp_path / "out")).collect()] == ["0"] * 5
    assert suite.main(["fit"]) == 1 and suite.main(["bench", "none", "--out", "x"]) == 1
    assert suite.main(["bench", "kmeans", "--sizes", "400", "--dims", "2", "--out", str(tmp_path / "r.json")]) in (0, 2)
    assert R.load_results(str(tmp_path / "r.json"))[1][0]["recipe_name"] == "kmeans"


def test_streaming(spark, tmp_path):
    from cairnspark.streaming.assign import assign_stream

    from_numpy(spark, np.array([[0.0, 0], [9, 9]])).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, features array<double>").parquet(str(tmp_path / "in"))
    q = assign_stream(stream, np.array([[0.0, 0], [10, 10]])).writeStream.format("memory").queryName("assigned").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.id, r.label) for r in spark.table("assigned").collect()) == [(0, 0), (1, 1)]


SLOW = {"mst_cut", "dbscan_8d", "dbscan_cluster_sizes", "noise_fraction"}
CHECKED = [k for k in __spark_entry__.oracle_sql() if not k.startswith("op") and k != "pipeline" and k not in SLOW]


@pytest.mark.parametrize("name", CHECKED)
def test_query_matches_sql(spark, name):
    db = duckdb.connect()
    for t in ("customer", "supplier", "part", "orders", "lineitem", "embeddings"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    ours = __spark_entry__.queries()[name](spark, DATA).toPandas()
    theirs = db.execute(__spark_entry__.oracle_sql()[name]).df()
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)
    key = lambda f: sorted(map(repr, f[columns].astype(object).itertuples(index=False, name=None)))
    assert key(ours) == key(theirs)


def test_entry(spark):
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() == 500
