import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tandem.llm import hard_negatives as hard
from tandem.llm.queries import op11_hard_negatives

SCHEMA = "vec_id bigint, label int, embedding array<double>"


def plain(rows, anchors, k=5, m=5, low=80, high=100):
    """All rows of the answer, by sorting every anchor's scores. ``rows``: (id, label, vector) with distinct ids."""
    good = [
        (i, y, [math.floor(min(max(256 * x, -1.7e308), 1.7e308)) for x in v]) for i, y, v in rows
        if i is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for a, ya, va in good:
        if not anchors(a):
            continue
        near = sorted(
            (-max(min(sum(p * q for p, q in zip(va, v)), 2**63 - 1), 1 - 2**63), i, y) for i, y, v in good if i != a and len(v) == len(va)
        )
        for p, i, _ in [e for e in near if e[2] == ya][:k]:
            fits = [e for e in near if e[2] != ya and low * -p <= high * -e[0] <= high * -p]
            out += [(a, i, r + 1, n, -p, -s) for r, (s, n, _) in enumerate(fits[:m])]
    return sorted(out)


def clustered(seed, n, dim=6, labels=4):
    rng = np.random.default_rng(seed)
    centre = rng.standard_normal(dim)
    return [(i, int(rng.integers(labels)), (centre + 0.6 * rng.standard_normal(dim)).round(2).tolist()) for i in range(n)]


def answer(df, every=10, **kw):
    return sorted(tuple(r) for r in hard.mine(df, F.col("vec_id") % every == 0, **kw).collect())


@pytest.mark.parametrize("values", [1 << 20, 120])
def test_one_block_and_many_equal_brute_force(table, monkeypatch, values):
    monkeypatch.setattr(hard, "BLOCK_VALUES", values)
    monkeypatch.setattr(hard, "SCORES", 300)
    rows = clustered(1, 300)
    rows += [(1000 + i, i % 4, rows[i % 7][2]) for i in range(60)]  # ties
    got = answer(table(rows, SCHEMA))
    assert got == plain(rows, lambda i: i % 10 == 0) and len(got) > 100


def test_other_limits(table):
    rows = clustered(2, 200)
    got = answer(table(rows, SCHEMA), positives=2, negatives=3, low=1, high=2)
    assert got == plain(rows, lambda i: i % 10 == 0, 2, 3, 1, 2) and got


def test_odd_rows(table):
    rows = clustered(3, 60)
    odd = [None, [], [1.0, None], [float("nan")] * 6, [float("inf")] * 6, [0.0] * 6, [1.0, 2.0], [2.0, 2.0], [1.0], [1e300] * 6, [9e15] * 6, [-9e15] * 6]
    rows += [(100 + 10 * i, i % 2, v) for i, v in enumerate(odd)] + [(990, None, [1.0] * 6), (None, 1, [1.0] * 6), (995, 7, [1.0] * 6)]
    df = table([(*r, 1, "x", 2.0) for r in rows], SCHEMA + ", block int, slot string, score double")
    assert answer(df) == plain(rows, lambda i: i % 10 == 0)


def test_repeated_rows_count_once_and_the_least_label_holds(table):
    rows = clustered(4, 80)
    again = rows + rows[:30] + [(5, 99, [9.0] * 6), (10, 99, [9.0] * 6)]
    assert answer(table(again, SCHEMA)) == plain(rows, lambda i: i % 10 == 0)


def test_one_label_empty_tables_and_floats(table):
    same = [(i, 1, [float(i), 1.0]) for i in range(20)]
    assert answer(table(same, SCHEMA)) == []
    assert answer(table([], SCHEMA)) == []
    rows = clustered(6, 90)
    floats = [(i, y, [float(np.float32(x)) for x in v]) for i, y, v in rows]
    assert answer(table(rows, "vec_id bigint, label int, embedding array<float>")) == plain(floats, lambda i: i % 10 == 0)


def test_suffixes_of_slots_hold_every_window():
    """Best rows per slot, merged downwards, are the best rows of each window."""
    rng = np.random.default_rng(5)
    for _ in range(50):
        limits = sorted(rng.integers(0, 40, 5).tolist(), reverse=True)
        block = hard.Block(np.arange(80), rng.integers(1, 3, 80), rng.integers(0, 8, (80, 2)).astype(float))
        ask = rng.integers(0, 5, (1, 2)).astype(float)
        found = block.negatives(np.array([-1]), np.array([0]), ask, [limits], 3, 80, 100)
        best = sorted((-s, i, slot) for _, slots, ids, ss in found for slot, i, s in zip(slots, ids, ss))
        every = sorted((-int(s), i) for i, s in enumerate(hard.scores(ask, block.vectors)[0]))
        for j, p in enumerate(limits):
            merged = [(s, i) for s, i, slot in best if slot >= j][:3]
            assert [e for e in merged if 80 * p <= 100 * -e[0]] == [e for e in every if 80 * p <= 100 * -e[0] <= 100 * p][:3]


def test_query(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    given = [(r.vec_id, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label, r.embedding) for r in rows]
    got = sorted(tuple(r) for r in op11_hard_negatives(spark, sf_dir).collect())
    assert got == plain(given, lambda i: i % 100 == 0)
