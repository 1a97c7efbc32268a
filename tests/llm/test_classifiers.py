import itertools
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tandem.llm import quality, toxicity
from tandem.llm.queries import op1_quality, op4_toxicity

SF = "/root/testdata/sf0.1"  # enough labels for a held-out share


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


@pytest.mark.parametrize("query,label,limit", [(op1_quality, "quality", 0.3), (op4_toxicity, "toxic", 0.5)])
def test_held_out_accuracy(spark, query, label, limit):
    got = {r.doc_id: r for r in query(spark, SF).collect()}
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    labels = {r.doc_id: r[label] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert all(r.held_out == held(d) and 0 <= r.score <= 1 and r.predicted == int(r.score >= limit) for d, r in got.items())
    right = {0: [], 1: []}
    for d, y in labels.items():
        if held(d):
            right[y].append(got[d].predicted == y)
    print(label, {y: (len(v), np.mean(v)) for y, v in right.items()})
    assert min(np.mean(v) for v in right.values()) > 0.9


@pytest.mark.parametrize("kind", ["quality", "toxic"])
def test_odd_rows_and_labels(table, kind):
    good, bad = "the fine words of a calm text", "you moron!! MORON!! moron!!"
    rows = [(i, f"{good} {i} x{i}" if i % 3 else f"{bad} {i} y{i}") for i in range(400)]
    rows += [(None, good), (900, None), (901, ""), (902, " \n"), (903, "z " * 40_000), (904, good), (904, good)]
    docs = table([(*r, "clash", 0.5) for r in rows], "doc_id bigint, text string, score string, label double")
    toxic = lambda i: int(i % 3 == 0) if kind == "toxic" else int(i % 3 != 0)
    labels = table([(i, toxic(i)) for i in range(400)] + [(None, 1), (901, None), (5000, 1), (7, 1 - toxic(7))], f"doc_id bigint, {kind} int")
    for known in (labels, labels.limit(0), labels.where(f"{kind} = 1")):
        if kind == "toxic":
            got = toxicity.score(docs, toxicity.train(docs, known)).collect()
        else:
            got = quality.score(docs, quality.train(docs, known)).collect()
        assert len(got) == len(rows) and all(r.score is not None and 0 <= r.score <= 1 for r in got)
        if known is labels:
            wrong = [r for r in got if r.doc_id is not None and r.doc_id < 400 and r.predicted != toxic(r.doc_id)]
            assert len(wrong) <= 2
    assert quality.score(docs.limit(0), np.zeros((1 << quality.BITS) + 1, np.float32)).count() == 0


def test_score_is_the_sparse_dot_product(table):
    texts = ["a b a", "A1 b!! b!!", None, "", "x"]
    weights = np.random.default_rng(1).standard_normal((1 << quality.BITS) + 1).astype(np.float32)
    docs = table(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r.score for r in quality.score(docs, weights).collect()}
    for row, term, value in quality.vectors(pa.array(texts, pa.string())):
        assert got[row] == pytest.approx(1 / (1 + np.exp(-(weights[term] @ value + weights[-1]))), abs=1e-6)


def test_learner_follows_the_regularised_leader():
    """Against the closed form: z and n are plain sums over the rows learned."""
    rng, learner = np.random.default_rng(2), quality.Learner(4)
    for _ in range(60):
        term = np.sort(rng.choice(4, 2, replace=False))
        learner.learn(term, np.ones(2), int(term[0] == 0))
    w = learner.weights()
    assert w[0] > 0.2 and w[3] < 0 and np.abs(learner.z[:4]).min() >= 0


def plain_matches(symbols):
    out = []
    aimed = toxicity.TARGET in symbols
    for i, s in enumerate(symbols):
        if s in (toxicity.INSULT, toxicity.THREAT):
            reported = toxicity.REPORT in symbols[:i]
            negated = toxicity.NEGATION in symbols[max(0, i - toxicity.NEGATION_REACH) : i]
            out.append(4 * (s == toxicity.THREAT) + (3 if reported else 2 if negated else 1 if aimed else 0))
    return out


def test_composed_grammar_against_plain_rules():
    for n in range(6):
        for symbols in itertools.product(range(6), repeat=n):
            assert toxicity.clause_matches(list(symbols)) == plain_matches(list(symbols)), symbols


def test_clauses_and_stems():
    insults = np.sort(np.array([toxicity.text_hash("moron")], np.uint64))
    texts = ["(Moron), he", "not a moron. moron", "He said: moron\nshe said moron", "morons", None, "", "123 -- !", "moron?you"]
    got = toxicity.match_counts(pa.array(texts, pa.string()), insults)
    name = toxicity.MATCHES.index
    want = np.zeros_like(got)
    want[0, name("aimed insult")] = 1
    want[1, name("negated insult")] = want[1, name("plain insult")] = 1
    want[2, name("plain insult")] = want[2, name("reported insult")] = 1
    assert (got[:, :-1] == want[:, :-1]).all()
    assert got[:, -1].tolist() == [2, 4, 6, 1, 0, 0, 3, 1]


def test_rejected_rows_go_with_all_columns(table):
    docs = table([(1, "you moron", "a"), (2, "fine", "b"), (None, None, None)], "doc_id bigint, text string, lang string")
    grammar = toxicity.Grammar(np.sort(np.array([toxicity.text_hash("moron")], np.uint64)), toxicity._FIRST)
    assert sorted(map(tuple, toxicity.reject(docs, grammar).collect()), key=str) == [(2, "fine", "b"), (None, None, None)]
