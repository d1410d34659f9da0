import numpy as np
import pytest

from kinlink.llm import neardup
from kinlink.llm.shared import components


def rows(seed=0):
    r = np.random.default_rng(seed)
    out, vid = [], 0
    for label in (0, 1, 2):
        for _ in range(150):
            base = r.standard_normal(24)
            for _ in range(int(r.choice([1, 1, 1, 2, 5, 30], p=[0.5, 0.2, 0.1, 0.1, 0.08, 0.02]))):
                out.append((vid, [float(x) for x in base + r.standard_normal(24) * r.choice([0, 0.05, 0.25])], label))
                vid += 1
    nan = float("nan")
    out += [(vid, None, 0), (vid + 1, [0.0] * 24, 0), (vid + 2, [nan] * 24, 0), (vid + 3, [1.0] * 24, None), (vid + 4, [1.0, None], 1), (vid + 5, [1.0, 2.0], 1), (vid + 6, [2.0, 4.0], 1), (vid + 7, [], 1), (None, [1.0, 2.0], 1)]
    return out


def brute(data, least=0.93):
    ok = [(i, np.array(v, float), (lab, len(v))) for i, v, lab in data if i is not None and lab is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    links, low = {i: 0 for i, *_ in data}, {i: i for i, *_ in data}

    def find(x):
        while low[x] != x:
            x = low[x]
        return x

    for a in range(len(ok)):
        for b in range(a):
            if ok[a][2] == ok[b][2] and ok[a][1] @ ok[b][1] / np.sqrt((ok[a][1] @ ok[a][1]) * (ok[b][1] @ ok[b][1])) >= least:
                links[ok[a][0]] += 1
                links[ok[b][0]] += 1
                x, y = find(ok[a][0]), find(ok[b][0])
                low[max(x, y)] = min(x, y)
    return {i: (links[i], find(i)) for i, *_ in data}


@pytest.mark.parametrize("shard", [700, 60])
def test_op4_brute_force(spark, shard):
    data = rows()
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, label int")
    out = neardup.near_duplicates(df, shard=shard)
    got = {r["vec_id"]: r for r in out.collect()}
    want = brute(data)
    assert len(got) == len(want)
    true = sum(n for n, _ in want.values())
    found = sum(min(got[i]["n_links"], n) for i, (n, _) in want.items())
    assert found >= 0.98 * true and all(got[i]["n_links"] <= n for i, (n, _) in want.items())
    if found == true:
        assert all(got[i]["component_id"] == c for i, (_, c) in want.items())
    assert all(r["kept"] == (r["vec_id"] is not None and r["vec_id"] == r["component_id"]) for r in got.values())
    assert neardup.audit_recall(df, out) >= 0.9


def test_op4_family_over_many_shards(spark):
    r = np.random.default_rng(5)
    near = r.standard_normal(64) + r.standard_normal((2400, 64)) * 0.23  # mean cosine 0.95, links astride of all its shards
    x = np.concatenate([near, r.standard_normal((1200, 64))])
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = (u @ u.T >= 0.93).sum(axis=1) - 1
    for block_bytes in (8 << 20, 300 * 64 * 8):  # one piece, and many that meet two by two
        out = neardup.near_duplicates(df, shard=60, block_bytes=block_bytes).cache()
        got = {r["vec_id"]: r["n_links"] for r in out.collect()}
        found = sum(min(got[i], n) for i, n in enumerate(want.tolist()))
        assert len(got) == len(x) and found >= 0.99 * want.sum() and all(got[i] <= n for i, n in enumerate(want.tolist()))
        assert neardup.audit_recall(df, out) >= 0.99


@pytest.mark.parametrize("groups", [(60,) * 10, (60, 60), (60, 120, 200, 300)])
def test_op4_groups_of_copies_only(spark, groups):
    r = np.random.default_rng(6)
    x = np.concatenate([r.standard_normal(64) + r.standard_normal((n, 64)) * 0.1 for n in groups])
    data = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    out = neardup.near_duplicates(spark.createDataFrame(data, "vec_id long, embedding array<double>, label int"))
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in out.collect()} == brute(data)


def test_op4_repeated_ids_and_vectors(spark):
    """Rows are vectors of their own, whatever their ids: each counts for the others."""
    x, y = [1.0, 0.0, 0.2], [0.0, 1.0, 0.0]
    df = spark.createDataFrame([(7, x, 1, "a"), (7, x, 1, "b"), (8, [2.0, 0.0, 0.4], 1, "c"), (9, y, 1, "d"), (7, y, 1, "e"), (5, x, 2, "f")], "vec_id long, embedding array<double>, label int, node string")
    got = sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(df).collect())
    assert got == [(5, 0, 5, True), (7, 1, 7, True), (7, 2, 7, True), (7, 2, 7, True), (8, 2, 7, False), (9, 1, 7, False)]


def test_op4_oversized_shard_meets_in_pieces(spark):
    """A family too large for a graph's task, with neighbours in other shards."""
    r = np.random.default_rng(8)
    x = np.concatenate([r.standard_normal(32) + r.standard_normal((400, 32)) * 0.3, r.standard_normal((200, 32))])
    data = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    out = neardup.near_duplicates(spark.createDataFrame(data, "vec_id long, embedding array<double>, label int"), shard=100, most=150, block_bytes=120 * 32 * 8)
    got, want = {r["vec_id"]: r["n_links"] for r in out.collect()}, brute(data)
    true = sum(n for n, _ in want.values())
    assert sum(min(got[i], n) for i, (n, _) in want.items()) >= 0.95 * true and all(got[i] <= n for i, (n, _) in want.items())


def test_op4_graph_reaches_what_a_scan_finds():
    """Batched insertion and the growing search, against all pairs of a shard."""
    r = np.random.default_rng(9)
    x = np.concatenate([r.standard_normal((500, 48)), *[r.standard_normal(48) + r.standard_normal((n, 48)) * 0.2 for n in (2, 3, 5, 40, 80)]])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    g = neardup.Graph(x, np.zeros(len(x), int), 2.0, 16, 1.2, 32)  # no ball holds two
    assert (g.leader == np.arange(len(x))).all()
    ids, val = neardup.beam(x, g.table, x, np.arange(len(x))[:, None], 96)
    found = [(ids[i][val[i] >= 0.93]).tolist() for i in range(len(x))]
    true = [np.flatnonzero(x @ x[i] >= 0.93).tolist() for i in range(len(x))]
    assert sum(len(set(a) & set(b)) for a, b in zip(found, true)) >= 0.97 * sum(map(len, true))


def test_op4_cells_of_many_centroids():
    r = np.random.default_rng(10)
    x = r.standard_normal((40, 24))[r.integers(0, 40, 3000)] + 0.4 * r.standard_normal((3000, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    m = neardup.centroids(x, 300, 0.99, flat=64)
    assert 250 <= len(m) <= 320 and np.allclose(np.linalg.norm(m, axis=1), 1)
    whole, cells = neardup.Cells(m), neardup.Cells(m, flat=64)
    a, b = whole.nearest(x, 2), cells.nearest(x, 2)
    assert whole.coarse is None and cells.coarse is not None and (a[0][:, 0] == b[0][:, 0]).mean() > 0.95 and (np.diff(b[1], axis=1) <= 0).all()


def test_op4_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert neardup.near_duplicates(df).count() == 0


def test_components(spark):
    e = [(i, i + 1) for i in range(40)] + [(100, 7), (200, 201), (203, 202), (202, 200), (5, 5)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(e, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 0, 200: 200, 201: 200, 202: 200, 203: 200}
