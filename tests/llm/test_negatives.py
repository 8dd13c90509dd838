import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.llm import negatives as hn


def brute(rows, anchors, n_pos=5, n_neg=5):
    """Every result by plain loops over (vec_id, label, vector) rows."""
    out = []
    dot = lambda u, v: sum(int(a) * int(b) for a, b in zip(u, v))
    for i, lab, v in anchors:
        scored = [(dot(v, w), j, m) for j, m, w in rows if j != i]
        liked = sorted((-s, j) for s, j, m in scored if m == lab)[:n_pos]
        for s, j in liked:
            fit = sorted((-t, h) for t, h, m in scored if m != lab and 80 * -s <= 100 * t <= 100 * -s)[:n_neg]
            out += [(i, j, r, h, -s, -t) for r, (t, h) in enumerate(fit, 1)]
    return sorted(out)


def clustered(n, dims, groups, seed, labels=4, noise=0.05):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, dims))
    x = centres[rng.integers(0, groups, n)] + noise * rng.normal(size=(n, dims))
    return [(int(k), int(rng.integers(0, labels)), [float(v) for v in row]) for k, row in enumerate(x)]


def wholes(spark, rows):
    return hn.whole_numbers(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>"))


def got(frame):
    return sorted(map(tuple, frame.collect()))


@pytest.mark.parametrize("most_broadcast", [1 << 25, 0])
def test_equals_brute_force(spark, most_broadcast):
    rows = clustered(400, 8, 6, 1)
    rows += [(k, 2, rows[0][2]) for k in range(1000, 1120)]  # a hot vector
    rows += [(k, 1, rows[0][2]) for k in range(2000, 2030)]
    rows += [rows[20], rows[20], rows[3]]  # repeated rows
    whole = [tuple(r) for r in wholes(spark, rows).collect()]
    want = brute(whole, [r for r in whole if r[0] % 20 == 0])
    assert got(hn.hard_negatives(wholes(spark, rows), F.col("vec_id") % 20 == 0, clusters=7, visits=1, most_broadcast=most_broadcast)) == want and len(want) > 100


def test_small_chunks_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(hn, "BLOCK", 3)
    rows = clustered(300, 5, 4, 2, labels=2, noise=0.5)
    whole = wholes(spark, rows)
    centroids = hn.fit_centroids(whole, 300, clusters=5)
    lists = hn.build_lists(whole, centroids, chunk=16)
    assert lists.chunks.agg(F.sum("n")).first()[0] == 300
    assert lists.chunks.count() > 300 // 32
    want = brute(plain := [tuple(r) for r in whole.collect()], [r for r in plain if r[0] % 10 == 0])
    assert got(hn.hard_negatives(whole, F.col("vec_id") % 10 == 0, clusters=5)) == want


def test_bounds_hold_and_leave_clusters_out(spark):
    whole = wholes(spark, clustered(600, 6, 12, 3, labels=2, noise=0.01))
    centroids = hn.fit_centroids(whole, 600, clusters=12)
    lists = hn.build_lists(whole, centroids)
    rows = whole.collect()
    a = np.array([r["vector"] for r in rows[:30]])
    least, most = hn._bounds(a, centroids, lists.radius)
    near = {r["vec_id"]: r["cluster"] for r in hn.assigned(whole, centroids).collect()}
    for k in range(30):
        for r in rows:
            s = float(a[k] @ np.array(r["vector"]))
            assert least[k, near[r["vec_id"]]] <= s <= most[k, near[r["vec_id"]]]
    blocks = hn.anchor_blocks(whole.where("vec_id < 4"), centroids)
    windows = hn.open_windows(blocks)
    early = hn._round(blocks, windows, lists, True, 5, 1, True).where("rank = 5")
    closed = windows.join(early.select("slot", F.col("score").alias("kth")), "slot").select("slot", F.col("kth").alias("low"), "high")
    packed = closed.groupBy(F.expr(f"slot div {hn.BLOCK * 64}").alias("block")).agg(F.collect_list(F.struct(F.expr(f"slot % {hn.BLOCK * 64}").cast("int").alias("which"), "low", "high")).alias("w"))
    visited = hn._items(blocks.join(packed.selectExpr("block", "w.which", "w.low", "w.high"), "block"), lists, None)
    assert visited.count() < blocks.count() * len(centroids) / 2


def test_odd_rows(spark):
    rows = [
        (None, 1, [1.0]), (1, None, [1.0]), (2, 1, None), (3, 1, [1.0, None]), (4, 1, [float("nan")]), (5, 1, [float("inf")]),
        (10, 1, []), (20, 1, [0.5, 0.25]), (30, 2, [0.5]), (40, 2, [0.5, 0.2, 7.0]), (50, 1, [0.5, 0.25, 0.0]), (60, 2, []), (60, 2, []), (70, 3, [1e6, -1e6]), (80, 3, [1e6, 3.0]), (90, 1, [9e5, 1.0]),
    ]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, label int, embedding array<double>, score string, rank int")
    whole = hn.whole_numbers(frame)
    plain = [tuple(r) for r in whole.collect()]
    assert len(plain) == 10
    want = brute(plain, plain)
    assert got(hn.hard_negatives(whole, F.lit(True), clusters=2)) == want and want
    assert got(hn.hard_negatives(whole, F.lit(False))) == []
    assert got(hn.hard_negatives(whole.limit(0), F.lit(True))) == []
    empty = [r for r in plain if not r[2]]
    assert got(hn.hard_negatives(whole.where("size(vector) = 0"), F.lit(True))) == brute(empty, empty) and len(empty) == 3


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '/root/testdata/{sf}/embeddings.parquet'")
    frame = hn.op11_hard_negatives(spark, f"/root/testdata/{sf}")
    want = con.execute(hn.OP11_SQL)
    names = [d[0] for d in want.description]
    assert got(frame.select(*names)) == sorted(want.fetchall()) and frame.count() > 100
