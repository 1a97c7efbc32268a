import random
import re

import pytest

from tandem.llm import decontamination as dec
from tandem.llm.queries import op12_decontamination
from tests.llm.brute import LOWER

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def found(text):
    return [(m.group(), m.start(), m.end()) for m in WORD.finditer((text or "").translate(LOWER))]


def plain(docs, benchmark, size=10):
    """(doc_id, n_words, n_hit, items, spans) of every document, by comparing windows of words."""
    windows = {}
    for item, text in benchmark:
        ws = [w for w, _, _ in found(text)]
        m = min(size, len(ws))
        for i in range(len(ws) - m + 1) if m else ():
            windows.setdefault(tuple(ws[i : i + m]), set()).add(None if item is None else str(item))
    out = []
    for doc_id, text in docs:
        ws = found(text)
        hit, items = [False] * len(ws), set()
        for m in {len(w) for w in windows}:
            for i in range(len(ws) - m + 1):
                names = windows.get(tuple(w for w, _, _ in ws[i : i + m]))
                if names is not None:
                    items |= names
                    hit[i : i + m] = [True] * m
        spans, at = [], 0
        while at < len(ws):
            to = at
            while to < len(ws) and hit[to]:
                to += 1
            if to > at:
                spans.append((ws[at][1], ws[to - 1][2]))
            at = max(to, at + 1)
        out.append((doc_id, len(ws), sum(hit), sorted(items - {None}), spans))
    return out


def rows_of(df):
    return sorted(repr((r.doc_id, r.n_words, r.n_hit, r["items"], [tuple(s) for s in r.spans])) for r in df.collect())


def case(seed=3):
    rng = random.Random(seed)
    word = lambda: rng.choice(["Alpha", "beta", "GAMMA", "é", "日本", "x1", "the", "of"])
    text = lambda n: "".join(word() + rng.choice([" ", ", ", "\n", "-", "\x00", " _ "]) for _ in range(n))
    benchmark = [(i, text(rng.choice([3, 9, 10, 11, 25]))) for i in range(20)]
    benchmark += [(5, text(12)), (None, "only without an id"), (21, ""), (22, None), (23, "?!"), (24, "Wörd"), (25, benchmark[4][1]), (4, benchmark[4][1])]
    docs = []
    for i in range(80):
        parts = [text(rng.randrange(0, 30))]
        for _ in range(rng.randrange(0, 3)):
            _, t = rng.choice(benchmark)
            parts += [(t or "").upper() if rng.random() < 0.5 and (t or "").isascii() else t or "", text(rng.randrange(0, 9))]
        docs.append((i, "; ".join(parts)))
    docs += [(80, None), (81, ""), (82, "..."), (None, benchmark[1][1]), (3, docs[3][1]), (83, "x wörd, y"), (84, "Only without... an ID!")]
    return docs, benchmark


SCHEMA = "doc_id bigint, text string"


@pytest.mark.parametrize("pieces", [4096, 1, 3])
def test_hits_are_those_of_plain_comparison(table, monkeypatch, pieces):
    monkeypatch.setattr(dec, "PIECE_WORDS", pieces)
    docs, benchmark = case()
    df = table([(*d, "q", 1) for d in docs], SCHEMA + ", items string, n_hit int")
    bench = table([(*b, "q") for b in benchmark], "item_id bigint, text string, doc_id string")
    assert rows_of(dec.find(df, bench)) == sorted(map(repr, plain(docs, benchmark)))
    assert rows_of(dec.find(df, bench, 4)) == sorted(map(repr, plain(docs, benchmark, 4)))


@pytest.mark.parametrize("bound", ["SET_WORDS", "SET_BYTES"])
def test_a_benchmark_of_many_sets_gives_the_same(table, monkeypatch, bound):
    docs, benchmark = case(5)
    monkeypatch.setattr(dec, bound, 90)
    monkeypatch.setattr(dec, "PIECE_WORDS", 5)
    df, bench = table(docs, SCHEMA + ""), table(benchmark, "item_id bigint, text string")
    assert dec.benchmark_pieces(bench, 10)[1] > 2
    assert rows_of(dec.find(df, bench)) == sorted(map(repr, plain(docs, benchmark)))
    cut = sorted(map(repr, (tuple(r) for r in dec.cut(df, bench).collect())))
    assert cut == sorted(map(repr, cleaned(docs, benchmark)))


def cleaned(docs, benchmark):
    out = []
    for (doc_id, text), (_, _, _, _, spans) in zip(docs, plain(docs, benchmark)):
        for a, b in reversed(spans):
            text = text[:a] + text[b:]
        out.append((doc_id, text))
    return out


def test_spans_are_cut_and_documents_rejected(table):
    docs, benchmark = case(9)
    df = table([(i, *d, "x") for i, d in enumerate(docs)], "_runs int, " + SCHEMA + ", lang string")
    bench = table(benchmark, "item_id bigint, text string")
    got = dec.cut(df, bench)
    assert got.schema == df.schema
    assert sorted(tuple(r) for r in got.collect()) == sorted((i, *d, "x") for i, d in enumerate(cleaned(docs, benchmark)))
    facts = plain(docs, benchmark)
    for share in (0.0, 0.5):
        kept = sorted(r._runs for r in dec.reject(df, bench, share=share).collect())
        assert kept == [i for i, f in enumerate(facts) if f[2] <= share * f[1]]


def test_windows_with_one_hash_are_told_apart(table, monkeypatch):
    monkeypatch.setattr(dec, "mix", lambda x: x * 0 + dec.np.uint64(7))
    docs, benchmark = case(11)
    got = dec.window_set([(None if i is None else str(i), t, min(10, len(found(t)))) for i, t in benchmark if found(t)])
    assert len(set(got.hashes.tolist())) == 1
    out = dec.scan(dec.pa.array([t for _, t in docs], dec.pa.string()), got)
    want = plain(docs, benchmark)
    # pieces here are whole items, so the windows are those of the plain version
    assert out.n_hit.tolist() == [w[2] for w in want] and out.items == [w[3] for w in want]


def test_empty_tables(table):
    none, bench = table([], SCHEMA), table([], "item_id bigint, text string")
    assert dec.find(none, bench).count() == 0
    assert rows_of(dec.find(table([(1, "a b")], SCHEMA), bench)) == [repr((1, 2, 0, [], []))]


def test_a_very_long_text_and_a_very_long_word(table):
    rng = random.Random(1)
    item = " ".join(f"t{rng.randrange(10**6)}" for _ in range(40))
    long = " ".join(f"w{rng.randrange(10**6)}" for _ in range(300_000))
    docs = [(1, f"{long} {item} {long}"), (2, "z" * 3_000_000), (3, "z" * 3_000_000 + "y")]
    benchmark = [(1, item), (2, "z" * 3_000_000)]
    got = dec.find(table(docs, SCHEMA), table(benchmark, "item_id bigint, text string"))
    assert rows_of(got) == sorted(map(repr, plain(docs, benchmark)))


def test_query(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    want = {r[0]: (r[1], r[2], len(r[3]), r[2] > 0) for r in plain(docs, bench)}
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.contaminated) for r in op12_decontamination(spark, sf_dir).collect()}
    assert got == want and any(v[3] for v in want.values())
