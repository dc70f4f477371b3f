"""The vector operators against plain versions, with the awkward rows: null, short, zero, non-finite and repeated vectors, clashing names, empty tables."""

import hashlib
import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quillsift.llm import clusters, neighbours, queries, vectors, whitening

SCHEMA = "vec_id long, embedding array<double>, label int, x string, n long, key string, cluster string, rank string"
SIZE = 64


def made(n=400, seed=3):
    """Tight clouds, equal vectors, scattered ones."""
    rng = np.random.default_rng(seed)
    clouds = rng.standard_normal((5, SIZE))
    rows = [clouds[i % 5] + 0.05 * rng.standard_normal(SIZE) if i % 3 else rng.standard_normal(SIZE) for i in range(n)]
    for i in range(min(30, n // 8)):
        rows[7 * i + 1] = rows[1]
    return [(i, r.tolist()) for i, r in enumerate(rows)]


AWKWARD = [
    (9001, None), (9002, []), (9003, [1.0] * 63), (9004, [float("nan")] + [0.0] * 63), (9005, [float("inf")] + [0.0] * 63), (9006, [None] + [1.0] * 63), (9007, [1e300] + [0.0] * 63), (9100, None),
]
EXTRA = (1, "x", 2, "k", "c", "r")


def frame(spark, rows):
    return spark.createDataFrame([(*r, *EXTRA) for r in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def table(spark):
    return frame(spark, made() + [(None, made()[5][1]), (4, made()[4][1])] + AWKWARD)


def sound(rows, sizes=(SIZE,), most=vectors.LARGEST):
    return [(i, v) for i, v in rows if v is not None and len(v) in sizes and all(x is not None and math.isfinite(x) and abs(64 * x) < most for x in v)]


def test_matrices_of_lists(spark):
    import pyarrow as pa

    column = pa.array([r[1] for r in AWKWARD] + [[1.0, 2.0]], pa.list_(pa.float32()))
    found = {m.shape[1]: (rows.tolist(), m) for rows, m in vectors.matrices(column)}
    assert found[63][0] == [2] and found[2][0] == [8] and found[0][0] == [1] and not len(found[64][0])  # 1e300 is infinite as a float
    assert vectors.matrices(pa.array([], pa.list_(pa.float32()))) == []
    cut = {m.shape[1]: rows.tolist() for rows, m in vectors.matrices(column.slice(2))}
    assert cut[63] == [0] and cut[2] == [6]


def plain_clusters(rows, k=16, rounds=3):
    x = np.array([[math.floor(64 * c) for c in v] for _, v in rows])
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, hashlib.sha256(f"1:{rows[i][0]}".encode()).hexdigest(), x[i].tolist()))
    c = x[order[:k]].copy()
    for step in range(rounds + 1):
        d2 = ((x[:, None] - c[None]) ** 2).sum(axis=2)
        at = d2.argmin(axis=1)
        if step < rounds:
            c = np.array([x[at == j].sum(axis=0) // (at == j).sum() if (at == j).any() else c[j] for j in range(len(c))])
    return at, d2.min(axis=1), c


@pytest.mark.parametrize("n", [400, 20, 9])
def test_clusters_against_brute_force(spark, n):
    rows = made(n) if n > 300 else made(400)[:n]
    rows = sorted(rows + [(None, rows[5][1]), (4, rows[4][1]), (3, rows[4][1])], key=str)
    out = clusters.cluster_table(frame(spark, rows + AWKWARD)).collect()
    at, d2, c = plain_clusters(rows)
    name = [hashlib.sha256(",".join(map(str, r)).encode()).hexdigest() for r in c.tolist()]
    want = [(i, a, d, int(d2[at == a].sum()), int(d2.sum()), name[a]) for (i, _), a, d in zip(rows, at, d2)]
    assert sorted(map(tuple, out), key=str) == sorted(((i, int(a), int(d), s, t, h) for i, a, d, s, t, h in want), key=str)


def test_bounds_skip_work_and_change_nothing():
    rng = np.random.default_rng(1)
    x = (rng.integers(-200, 200, (12, 8))[rng.integers(0, 12, 2000)] + rng.integers(-9, 9, (2000, 8))).astype(np.int64)
    c = x[:24].copy()
    group = clusters.grouped(c, 4)
    assert sorted(set(group.tolist())) == list(range(group.max() + 1))
    at, _, upper, lower = clusters.first(x, c, group)
    for _ in range(12):
        new = np.array([x[at == j].sum(axis=0) // (at == j).sum() if (at == j).any() else c[j] for j in range(24)])
        drift, c = np.sqrt(((new - c) ** 2).sum(axis=1)) * (1 + 1e-12), new
        at, upper, lower, looked = clusters.moved(x, at, upper, lower, c, group, drift)
        exact = ((x[:, None] - c[None]) ** 2).sum(axis=2)
        assert (at == exact.argmin(axis=1)).all() and (upper >= np.sqrt(exact.min(axis=1))).all()
        exact = np.sqrt(exact)
        exact[np.arange(len(x)), at] = np.inf
        assert all((lower[:, g] <= exact[:, group == g].min(axis=1)).all() for g in range(lower.shape[1]))
    assert looked < 2000 * 24 / 4


def test_squares_are_exact_at_every_size():
    for most in (100, 1 << 20, 1 << 26):
        rng = np.random.default_rng(most)
        x, c = rng.integers(-most, most, (20, SIZE)), rng.integers(-most, most, (5, SIZE))
        assert clusters.squared(x, c).tolist() == [[sum((int(a) - int(b)) ** 2 for a, b in zip(r, s)) for s in c] for r in x]


def test_sql_of_clusters(spark, tmp_path):
    frame(spark, made(120)).select("vec_id", "embedding").coalesce(1).write.parquet(str(tmp_path / "e"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/e/*.parquet')")
    columns = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({queries.OP13_SQL})").fetchall()
    assert sorted(want) == sorted(map(tuple, clusters.cluster_table(spark.read.parquet(str(tmp_path / "e"))).select(*columns).collect()))


def test_whitening_against_plain_eigenvectors(spark, table):
    rows = sound(made() + [(None, made()[5][1]), (4, made()[4][1])])
    x = np.array([[math.floor(64 * c) for c in v] for _, v in rows]) + 1_000_000
    n, s = len(x), x.sum(axis=0)
    out = whitening.whitening_table(table).collect()
    assert len(out) == n * 32 and {r["n"] for r in out} == {n} and {r["component"] for r in out} == set(range(1, 33))
    deviation = {tuple(r): int(d) for r, d in zip(x.tolist(), ((n * x - s) ** 2).sum(axis=1))}
    by_id = {i: deviation[tuple(r)] for (i, _), r in zip(rows, x.tolist())}
    assert all(r["deviation"] == by_id[r["vec_id"]] for r in out)
    centred = (n * x - s) / n
    values, u = np.linalg.eigh(centred.T @ centred / n)
    values, u = values[::-1][:32], u[:, ::-1][:, :32]
    z = centred @ u / np.sqrt(values)
    got = {(r["vec_id"], r["component"]): r["whitened"] for r in out}
    mine = np.array([[got[i, c + 1] for c in range(32)] for i, _ in rows])
    sign = np.sign((z * mine).sum(axis=0))
    assert np.abs(mine - z * sign).max() < 1e-7
    trace = (centred**2).sum() / n
    assert all(abs(r["explained"] * trace / values[r["component"] - 1] - 1) < 1e-9 for r in out)
    assert {r["identity_error"] < 1e-9 for r in out} == {True}


def test_whitening_of_flat_and_single_tables(spark):
    flat = [(i, [float(i % 7), float(i % 7), 0.0, 1.0]) for i in range(50)]
    out = whitening.whitening_table(frame(spark, flat)).collect()
    assert len(out) == 200 and all((r["whitened"] is None) == (r["component"] > 1) for r in out)
    assert all(abs(r["explained"] - (r["component"] == 1)) < 1e-9 and r["identity_error"] < 1e-9 for r in out)
    one = whitening.whitening_table(frame(spark, [(1, [1.0, 2.0])])).collect()
    assert [(r["deviation"], r["whitened"], r["n"]) for r in one] == [(0, None, 1)] * 2
    mixed = whitening.whitening_table(frame(spark, flat + [(99, [1.0])])).collect()
    assert len(mixed) == 200
    for empty in ([], AWKWARD[:1], AWKWARD[1:2]):
        assert whitening.whitening_table(frame(spark, empty)).collect() == []


def test_lanczos_restarts_and_converges():
    rng = np.random.default_rng(5)
    q = np.linalg.qr(rng.standard_normal((60, 60)))[0]
    for values in (np.r_[np.full(20, 9.0), np.zeros(40)], np.r_[np.full(6, 5.0), np.full(54, 1.0)], 2.0 ** -np.arange(60), np.zeros(60)):
        a = q @ np.diag(values) @ q.T
        found, u, passes = whitening.lanczos(lambda v: a @ v, 60, 10, block=4)
        assert np.allclose(found, np.sort(values)[::-1][:10], atol=1e-12 * max(values.max(), 1))
        assert np.allclose(u.T @ u, np.eye(10), atol=1e-12) and np.abs(a @ u - u * found).max() <= 1e-11 * max(values.max(), 1)
    _, _, passes = whitening.lanczos(lambda v: (q @ np.diag(2.0 ** -np.arange(60)) @ q.T) @ v, 60, 4, block=4)
    assert passes < 12  # residuals end it before the basis spans everything


def test_deviations_are_exact_for_large_numbers():
    x = np.array([[1 << 26, -5], [0, 7], [3, 1]])
    for n, sums in ((3, ((1 << 26) + 3, 3)), (1 << 40, (12345678901234567, -5))):
        want = [[n * int(v) - s for v, s in zip(r, sums)] for r in x]
        d = whitening.deviations(x, n, sums)
        assert d.tolist() == want
        assert whitening.squares(d) == [v if (v := sum(c * c for c in r)) < 1 << 63 else None for r in want]


def plain_neighbours(rows, k=10, every=100):
    out = {}
    for i, v in rows:
        if i is not None and i % every == 0:
            others = sorted((math.dist(v, w), j) for j, w in rows if j is not None and j != i and len(w) == len(v))
            out[i] = others[:k]
    return out


def recall(out, want):
    got = {}
    for r in out:
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    hit = total = 0
    for q, near in want.items():
        assert sorted(got.get(q, {})) == list(range(1, len(near) + 1))
        assert [s for _, s in sorted((r, x[1]) for r, x in got.get(q, {}).items())] == sorted(x[1] for x in got.get(q, {}).values())
        hit, total = hit + len({j for _, j in near} & {x[0] for x in got.get(q, {}).values()}), total + len(near)
    assert set(got) == {q for q, near in want.items() if near}
    return hit / max(total, 1)


@pytest.mark.parametrize("parts", [None, 16])
def test_neighbours_against_brute_force(spark, parts, monkeypatch):
    if parts:
        monkeypatch.setattr(neighbours, "ITEMS", parts), monkeypatch.setattr(neighbours, "QUERIES", parts), monkeypatch.setattr(neighbours, "BLOCK_BYTES", 5000)
    rows = made(900)
    zero = [(10_000, [0.0] * SIZE)]
    out = neighbours.search(frame(spark, rows + [(None, rows[5][1]), rows[4], rows[100]] + AWKWARD[:6] + zero), every=10).collect()
    assert recall(out, plain_neighbours(rows + AWKWARD[2:3], every=10)) >= 0.95
    vector = dict(rows)
    assert all(abs(r["score"] - math.dist(vector[r["query_id"]], vector[r["vec_id"]])) < 1e-12 for r in out)


def test_small_and_tied_searches_are_exact(spark):
    rows = [(i, [1.0, float(i % 2)]) for i in range(30)] + [(100, [1.0, 0.0]), (200, [5.0])]
    out = neighbours.search(frame(spark, rows)).collect()
    got = {q: [r["vec_id"] for r in sorted((r for r in out if r["query_id"] == q), key=lambda r: r["rank"])] for q in (0, 100, 200)}
    assert got[0] == [2, 4, 6, 8, 10, 12, 14, 16, 18, 20] and got[100] == [0, 2, 4, 6, 8, 10, 12, 14, 16, 18] and got[200] == []
    assert [r["vec_id"] for r in neighbours.search(frame(spark, rows[:3])).orderBy("rank").collect()] == [2, 1]
    for empty in ([], AWKWARD[:2], [(1, [1.0])]):
        assert neighbours.search(frame(spark, empty)).collect() == []
    huge = [(0, [1e300, 1.0]), (1, [1e300, 2.0]), (2, [-1e300, 0.0])]
    assert [(r["vec_id"], r["score"]) for r in neighbours.search(frame(spark, huge)).orderBy("rank").collect()] == [(1, 1.0), (2, math.inf)]


def test_probing_order_is_success_order():
    rng = np.random.default_rng(2)
    block = rng.standard_normal((3, 12))
    slot, place = neighbours.slots(block, 0.7)
    chance = neighbours.success(place)
    assert chance.shape == (3, neighbours.TABLES, 3**neighbours.HASHES) and (chance.sum(axis=2) < 1).all()
    found = neighbours.visits(block, 0.7)
    cell = neighbours.cells(slot[:, :, None, :] + neighbours._STEPS[None, None], 12)
    for c, p, f in zip(cell, chance, found):
        by_cell = dict(zip(c.reshape(-1).tolist(), p.reshape(-1).tolist()))
        order = [by_cell[x] for x in f.tolist()]
        assert order == sorted(order, reverse=True) and order[0] == max(by_cell.values())
    # of neighbours at the radius about the promised part lies in visited buckets
    q, far, hits = rng.standard_normal((200, 12)), rng.standard_normal((200, 12)), 0
    far = q + 0.7 * far / np.linalg.norm(far, axis=1, keepdims=True)
    homes = neighbours.cells(neighbours.slots(far, 0.7)[0], 12)
    for home, f in zip(homes, neighbours.visits(q, 0.7)):
        hits += bool(set(home.tolist()) & set(f.tolist()))
    assert hits >= 180


def test_vector_queries_leave_no_tables_between(spark, tmp_path, monkeypatch):
    from quillsift.llm import common

    monkeypatch.setattr(common, "shared_dir", lambda _: str(tmp_path))
    data = frame(spark, made(200))
    assert neighbours.search(data).count() == 20 and clusters.cluster_table(data).count() == 200
    assert sorted(p.name.split("-")[1] for p in tmp_path.iterdir()) == ["clusters", "neighbours"]
