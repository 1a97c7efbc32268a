import numpy as np
from pyspark.sql import functions as F

from tandem.llm import nearest
from tandem.llm.queries import op10_nearest

SCHEMA = "vec_id bigint, embedding array<float>"


def exact(rows, queries, k):
    good = {i: np.array(v, np.float32).astype(np.float64) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out = {}
    for q in queries:
        if q in good:
            near = sorted((float(np.sqrt(((good[q] - v) ** 2).sum())), i) for i, v in good.items() if i != q and len(v) == len(good[q]))
            out[q] = near[:k]
    return out


def check(got, want, recall):
    found = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        found.setdefault(r.query_id, []).append((r.score, r.vec_id))
        assert r.rank == len(found[r.query_id])
    assert {q for q in want if want[q]} == set(found)
    hits = total = 0
    for q, near in want.items():
        own = found.get(q, [])
        assert own == sorted(own) and len(own) == len(near)
        hits += len({i for _, i in own} & {i for _, i in near})
        total += len(near)
    assert hits >= recall * total, hits / total


def test_blocks_ties_and_odd_vectors(table, monkeypatch):
    monkeypatch.setattr(nearest, "BLOCK_VALUES", 64 * 16)
    monkeypatch.setattr(nearest, "QUERY_ROWS", 7)
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.standard_normal(16) + 3 * (i % 4)]) for i in range(700)]
    rows += [(700 + i, rows[0][1]) for i in range(150)]  # ties
    odd = [None, [], [0.0] * 16, [1.0, None], [float("nan")] * 16, [float("inf")] * 16, [1.0, 2.0], [1.0, 2.5]]
    rows += [(10 * (100 + i), v) for i, v in enumerate(odd)]
    df = table([(*r, 5, "x") for r in rows], SCHEMA + ", block int, part string")
    got = nearest.search(df, F.col("vec_id") % 10 == 0, 10).collect()
    check(got, exact(rows, [i for i, _ in rows if i % 10 == 0], 10), 0.97)
    tied = [r.vec_id for r in sorted(got, key=lambda r: r.rank) if r.query_id == 0]
    assert tied == list(range(700, 710))


def test_small_and_empty_tables(table):
    df = table([], SCHEMA)
    assert nearest.search(df, F.col("vec_id") == 0).count() == 0
    df = table([(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [1.0, 1.0]), (None, [1.0, 1.0])], SCHEMA)
    assert [tuple(r) for r in nearest.search(df, F.col("vec_id") == 0).collect()] == [(0, 1, 1, 1.0)]
    same = table([(i, [1.0, 0.0]) for i in range(30)], SCHEMA)
    assert [r.vec_id for r in nearest.search(same, F.col("vec_id") == 5, 3).collect()] == [0, 1, 2]


def test_query_recall(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    check(op10_nearest(spark, sf_dir).collect(), exact(rows, [i for i, _ in rows if i % 100 == 0], 10), 0.97)
