import numpy as np

from tandem.llm import near_vectors
from tandem.llm.queries import op7_near_vectors

from . import brute

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def expected(rows, least):
    good = []
    for i, (_, v, label) in enumerate(rows):
        if label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good.append(i)
    links = []
    for a, i in enumerate(good):
        for j in good[a + 1 :]:
            x, y = (np.array(rows[k][1], np.float32).astype(np.float64) for k in (i, j))
            if rows[i][2] == rows[j][2] and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= least:
                links.append((i, j))
    roots = brute.components(range(len(rows)), links)
    least_id = {}
    for i, r in roots.items():
        least_id[r] = min(least_id.get(r, rows[i][0]), rows[i][0])
    degree = np.bincount(np.array(links, int).reshape(-1), minlength=len(rows))
    return sorted((r[0], int(degree[i]), least_id[roots[i]], r[0] == least_id[roots[i]]) for i, r in enumerate(rows))


def test_copies_groups_and_odd_vectors(table, monkeypatch):
    monkeypatch.setattr(near_vectors, "BLOCK", 16)  # hot buckets are cut
    rng = np.random.default_rng(3)
    base = rng.standard_normal((6, 24))
    rows = []
    for i in range(300):
        v = base[i % 6] + rng.standard_normal(24) * rng.choice([0, 0.05, 0.2, 1.5])
        rows.append((1000 - i, [float(x) for x in v], int(i % 2)))
    odd = [None, [], [0.0] * 24, [1.0, None], [float("nan")] * 24, [float("inf"), 1.0], [1.0, 0.0], [-0.0, 1.0], [3.0]]
    rows += [(2000 + i, v, 0) for i, v in enumerate(odd)] + [(3000, rows[0][1], None), (3001, [2 * x for x in rows[0][1]], 0)]
    df = table([(*r, "clash", 1) for r in rows], SCHEMA + ", rep string, code int")
    got = sorted(map(tuple, near_vectors.deduplicate(df, 0.93).select("vec_id", "n_links", "component_id", "kept").collect()))
    assert got == expected([(a, None if v is None else v, c) for a, v, c in rows], 0.93)


def test_empty_table(table):
    assert near_vectors.deduplicate(table([], SCHEMA)).count() == 0
    alone = near_vectors.deduplicate(table([(None, [1.0], 1), (4, [1.0], 1)], SCHEMA)).collect()
    assert sorted((r.n_links for r in alone)) == [0, 0]


def test_query_finds_all(spark, sf_dir):
    rows = [tuple(r)[:3] for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    got = sorted(map(tuple, op7_near_vectors(spark, sf_dir).select("vec_id", "n_links", "component_id", "kept").collect()))
    assert got == expected(rows, 0.93)


def test_an_id_with_other_vectors_and_labels(table):
    rng = np.random.default_rng(9)
    base = rng.standard_normal((5, 24))
    rows = []
    for i in range(120):
        v = base[i % 5] + rng.standard_normal(24) * rng.choice([0.02, 0.05])
        rows.append((i // 4, [float(x) for x in v], int(i % 3)))
    rows += [(500, rows[0][1], 0), (500, [1.001 * x for x in rows[0][1]], 0)]
    got = sorted(map(tuple, near_vectors.deduplicate(table(rows, SCHEMA), 0.93).select("vec_id", "n_links", "component_id", "kept").collect()))
    assert got == expected(rows, 0.93)
