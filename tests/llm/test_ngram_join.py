import random

import numpy as np
import pyarrow as pa
import pytest

from tandem.llm import ngram_join
from tandem.llm.queries import op3_ngram_join
from tandem.llm.words import sorted_sets, words_of

from . import brute


def made_texts(seed, n=160):
    rng = random.Random(seed)
    texts, common = [], [f"common{i}" for i in range(40)]
    for _ in range(n):
        kind = rng.random()
        if kind < 0.5 or not texts:
            ws = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([0, 1, 2, 3, 4, 5, 6, 9, 14, 25, 60, 150, 400]))]
        else:
            ws = rng.choice(texts).split()
            for _ in range(rng.choice([0, 1, 1, 2, 4, 8])):
                if ws:
                    at = rng.randrange(len(ws))
                    ws[at : at + rng.randint(0, 2)] = [f"e{rng.randrange(99)}"] * rng.randint(0, 2)
        if rng.random() < 0.2:
            ws = ws + common
        texts.append(rng.choice([" ", "\n", "\t "]).join(ws))
    return texts


@pytest.mark.parametrize("n,num,den", [(4, 85, 100), (5, 4, 5), (1, 1, 2)])
def test_against_all_pairs(table, n, num, den):
    rows = list(enumerate(made_texts(n)))
    docs = table([(d * 7 % 1000, t, "x", 1) for d, t in rows], "doc_id bigint, text string, fp string, key int")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.link(docs, n, num, den).collect()}
    assert got == brute.linked([(d * 7 % 1000, t) for d, t in rows], n, num, den)


@pytest.mark.parametrize("num,den", [(85, 100), (4, 5), (1, 2)])
def test_bands_and_allotments(num, den):
    join = ngram_join.Join(4, num, den)
    starts = join.band_starts(5000)
    band = lambda s: np.searchsorted(starts, s, "right") - 1
    for a in range(1, 3000, 7):
        most = a * den // num
        assert band(most) <= band(a) + 1
        h = join.most_different(most)
        assert (den - num) * (a + most) >= (den + num) * (a + most - 2 * a)  # sizes alone allow the link
        assert h >= most - a
    for least, larger in ((5, 9), (20, 40), (700, 900)):
        for sets in (10, 1e4, 1e9):
            s = join.allot(least, larger, sets)
            if s is not None:
                assert s.ones + 2 * s.twos == join.most_different(larger) + 1 + s.slack


@pytest.mark.parametrize("scheme", [(3, 0, 0), (0, 2, 0), (2, 1, 1), (1, 2, 1), (4, 0, 2), (0, 3, 3)])
def test_sets_within_the_difference_share_a_key(scheme):
    """Whatever the allotment, two sets that differ in at most H tokens have a key in common."""
    rng = np.random.default_rng(5)
    made = ngram_join.Scheme(*scheme)
    h = made.ones + 2 * made.twos - 1 - made.slack
    for _ in range(400):
        base = rng.integers(1, 1 << 50, rng.integers(1, 14), dtype=np.uint64)
        cut = rng.integers(0, min(h, len(base) - 1) + 1) if h else 0
        more = rng.integers(1, 1 << 50, h - cut, dtype=np.uint64)
        sets = [np.unique(base), np.unique(np.concatenate([base[cut:], more]))]
        tokens, bounds = np.concatenate(sets), np.cumsum([0, *map(len, sets)])
        row, key = ngram_join.segment_keys(tokens, bounds, np.array([0, 1]), np.array([0, 0]), [made])
        assert set(key[row == 0]) & set(key[row == 1])


def test_words_and_sets_of_odd_texts():
    texts = ["", None, " \t\n", "A b", "a  B\x0bc", "é É", "a b c d a b c d", "x" * 3_000_000 + " y", "w " * 700_000, "\x1c \x85"]
    column = pa.array(texts, pa.string())
    for n in (1, 2, 4):
        sizes = [int(c) for w in words_of(column) for c in np.diff(sorted_sets(w, n)[1])]
        assert sizes == [len(set(brute.shingle_list(t, n))) for t in texts]


def test_odd_rows(table):
    docs = table(
        [(1, None), (2, ""), (3, "a b c d e"), (3, "a b c d e"), (4, "A B C D E"), (None, "a b c d e"), (5, "b"), (6, "B")],
        "doc_id bigint, text string",
    )
    got = sorted(map(tuple, ngram_join.link(docs, 4, 85, 100).collect()), key=str)
    assert got == sorted([(1, 0, 1), (2, 0, 2), (3, 2, 3), (3, 2, 3), (4, 2, 3), (None, 2, None), (5, 1, 5), (6, 1, 5)], key=str)
    assert ngram_join.link(docs.limit(0)).count() == 0


def test_chain_of_near_copies(table):
    """Links that no hub has: each text is near to the next one only."""
    ws, rows = [f"w{i}" for i in range(120)], []
    for i in range(30):
        rows.append((100 - i, " ".join(ws)))
        ws = ws[4:] + [f"n{i}-{k}" for k in range(4)]
    got = {r.doc_id: r.component_id for r in ngram_join.link(table(rows, "doc_id bigint, text string"), 4, 85, 100).collect()}
    assert set(got.values()) == {71}


def test_query(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in op3_ngram_join(spark, sf_dir).collect()}
    assert got == brute.linked(rows, 4, 85, 100)
