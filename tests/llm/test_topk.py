"""Search against brute force."""

import numpy as np

from tessera.llm import topk


def brute(rows, k):
    fine = [(i, [int(np.floor(64 * x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    width = max((len(v) for _, v in fine), default=0)
    fine = [(i, v + [0] * (width - len(v))) for i, v in fine]
    out = {}
    for q, a in fine:
        if q % 20 == 0:
            found = sorted(((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in fine if i != q))[:k]
            out[q] = [(i, -s) for s, i in found]
    return out


def test_search_equals_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(0, 0.2, 8).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[20][1]) for i in range(40)]  # one vector many times: ties
    rows += [(400, None), (420, [float("nan")] * 8), (440, [None] * 8), (460, [float("inf")] + [0.0] * 7), (None, [1.0] * 8), (480, [0.5, -0.5]), (500, [0.0] * 8), (520, [])]
    monkeypatch.setattr(topk, "STRIDE", 16)
    vectors = topk.integers(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3))
    got = topk.search(vectors, vectors.where("vec_id % 20 = 0"), k=20, shard_rows=64, query_rows=8).collect()
    found = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert found == brute(rows, 20)


def test_few_and_no_candidates(spark):
    few = topk.integers(spark.createDataFrame([(0, [1.0]), (1, [0.5]), (2, [2.0])], "vec_id long, embedding array<double>"))
    assert [(r.rank, r.vec_id, r.score) for r in topk.search(few, few.where("vec_id = 0")).orderBy("rank").collect()] == [(1, 2, 64 * 128), (2, 1, 64 * 32)]
    assert topk.search(few.limit(0), few.limit(0)).count() == 0


def test_maxscore_skips_nothing_that_competes():
    rng = np.random.default_rng(2)
    for _ in range(50):
        data = rng.integers(-9, 10, (200, 6)).astype(float)
        query = rng.integers(-9, 10, 6).astype(float)
        ids, scores = topk.maxscore(query, -1, np.arange(200), data.T.copy(), data.max(0), data.min(0), 10)
        full = data @ query
        first = np.lexsort((np.arange(200), -full))[:10]
        assert ids.tolist() == first.tolist() and scores.tolist() == full[first].tolist()


def test_queries_of_one_id_are_apart(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (0, [0.0, 1.0]), (1, [2.0, 0.5]), (2, [0.25, 3.0]), (2, [0.25, 3.0])]
    vectors = topk.integers(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = topk.search(vectors, vectors.where("vec_id = 0"), k=2).collect()
    assert sorted((r.rank, r.vec_id, r.score) for r in got) == sorted([(1, 1, 64 * 128), (2, 2, 64 * 16), (1, 2, 64 * 192), (2, 2, 64 * 192)])


def test_many_repeated_candidates(spark):
    one = spark.createDataFrame([(5, [1.0, 2.0])], "vec_id long, embedding array<double>")
    hot = spark.range(30_000).crossJoin(one).select("vec_id", "embedding").unionByName(spark.createDataFrame([(0, [1.0, 1.0]), (9, [2.0, 2.0]), (4, [1.0, 2.0])], one.schema))
    vectors = topk.integers(hot)
    got = topk.search(vectors, vectors.where("vec_id = 0"), k=4, shard_rows=8, query_rows=2).orderBy("rank").collect()
    assert [(r.rank, r.vec_id, r.score) for r in got] == [(1, 9, 64 * 64 * 4), (2, 4, 64 * 64 * 3), (3, 5, 64 * 64 * 3), (4, 5, 64 * 64 * 3)]


def test_products_are_skipped_and_nothing_that_competes(spark, monkeypatch):
    """Rows by norm, in steps with bounds of their own: the same rows as all products give, from fewer products."""
    rng = np.random.default_rng(3)
    for first, stride in ((512, 4096), (16, 64), (1, 1), (7, 1000)):
        monkeypatch.setattr(topk, "FIRST_ROWS", first)
        monkeypatch.setattr(topk, "STRIDE", stride)
        for width, scale in ((64, 1.0), (5, 1.0), (1, 1.0), (64, 0.0)):
            data = np.floor(rng.normal(0, 20, (2000 if stride > 1 else 60, width)) * scale)
            data[: len(data) // 3] *= rng.integers(0, 4, (len(data) // 3, 1))
            data[5:9] = data[4]
            ids = rng.permutation(len(data)) + 10
            shard = topk.by_norm(ids, data)
            for own in (4, 30, 50):
                got_ids, got = topk.maxscore(data[own], ids[own], *shard[:4], 20, shard[4])
                full = data @ data[own]
                order = [i for i in np.lexsort((ids, -full)) if i != own][:20]
                assert got_ids.tolist() == ids[order].tolist() and got.tolist() == full[order].tolist()
    monkeypatch.setattr(topk, "FIRST_ROWS", 512)
    monkeypatch.setattr(topk, "STRIDE", 4096)
    rows = [(r.vec_id, list(r.v)) for r in topk.integers(spark.read.parquet("/root/testdata/check_s/embeddings.parquet")).collect()]
    ids, data = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    shard, counted = topk.by_norm(ids, data), []
    for i in np.flatnonzero(ids % 20 == 0)[:60]:
        topk.maxscore(data[i], ids[i], *shard[:4], 20, shard[4], counted)
    assert sum(counted) < 0.65 * 60 * data.size
    skewed = topk.by_norm(ids, data * (1 + (ids[:, None] % 50 == 0) * 9))
    counted.clear()
    for i in np.flatnonzero(ids % 20 == 0)[:60]:
        topk.maxscore(data[i], ids[i], *skewed[:4], 20, skewed[4], counted)
    assert sum(counted) < 0.3 * 60 * data.size
