"""Nearest neighbours: estimates and bounds, recall against brute force, hard cases."""

import numpy as np

from pactscope.llm import ann, queries
from tests.llm.fixtures import SF


def brute(rows, k, wanted):
    good = [(i, np.array(v, float)) for i, v in rows if v and None not in v and np.isfinite(v).all() and np.any(np.array(v))]
    out = {}
    for i, v in good:
        if wanted(i):
            near = sorted((-float(v @ w / (np.linalg.norm(v) * np.linalg.norm(w))), j) for j, w in good if j != i and len(w) == len(v))
            out[i] = [(j, -s) for s, j in near[:k]]
    return out


def test_estimates_lie_within_their_bounds():
    r = np.random.default_rng(1)
    x, q = r.standard_normal((3000, 64)), r.standard_normal((20, 64))
    turn = ann.rotation(64)
    estimate, error = ann.estimated(ann.coded(x, turn), ann.rounded(q, turn))
    true = (q / np.linalg.norm(q, axis=1, keepdims=True)) @ (x / np.linalg.norm(x, axis=1, keepdims=True)).T
    off = np.abs(estimate - true)
    assert (off > error[None, :]).mean() < 0.005
    assert abs((estimate - true).mean()) < 0.005
    assert off.mean() < 0.05


def test_recall_on_the_table(spark):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    want = brute(rows, 5, lambda i: i % 50 == 0)
    got = queries.op3_approximate_nearest_neighbours(spark, SF).collect()
    assert len(got) == 5 * len(want)
    hits = sum(r.vec_id in {j for j, _ in want[r.query_id]} for r in got)
    assert hits >= 0.97 * len(got)
    exact = {(i, j): s for i, near in want.items() for j, s in near}
    assert all(abs(r.score - exact[r.query_id, r.vec_id]) < 1e-12 for r in got if (r.query_id, r.vec_id) in exact)


def test_hard_cases(spark, monkeypatch):
    monkeypatch.setattr(ann, "WAVE", 3)
    r = np.random.default_rng(2)
    rows = [(i, r.standard_normal(8).tolist()) for i in range(60)]
    rows += [(100 + i, [1.0] * 8) for i in range(40)] + [(200 + i, [2.0] * 8) for i in range(5)]
    rows += [(150, None), (250, []), (300, [0.0] * 8), (350, [1.0, None] * 4), (400, [float("nan")] * 8), (450, [float("inf")] * 8)]
    rows += [(500, [1.0, 2.0]), (501, [2.0, 1.0]), (550, [3.0] * 3), rows[50], rows[3], (None, [1.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    want = brute(list({i: (i, np.array(v, np.float32).astype(float).tolist() if v and None not in v else v) for i, v in rows if i is not None}.values()),
                 5, lambda i: i % 50 == 0)
    got = {}
    for x in ann.nearest(df, "vec_id % 50 = 0").collect():
        got.setdefault(x.query_id, []).append((x.rank, x.vec_id, x.score))
    for i, near in want.items():
        found = sorted(got.pop(i, []))
        assert [x[0] for x in found] == list(range(1, len(near) + 1))
        assert np.allclose([x[2] for x in found], [s for _, s in near], atol=1e-12)
        if i in (100, 200, 500):
            assert [x[1] for x in found][:1] == [near[0][0]]
    assert not got
    assert ann.nearest(df.limit(0), "vec_id % 50 = 0").collect() == []
