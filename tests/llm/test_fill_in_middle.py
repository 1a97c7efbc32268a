import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tandem.llm import fill_in_middle as fim
from tandem.llm.queries import op13_fill_in_middle

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain(doc_id, text, seed=42, rate=50, spm=80):
    """(n, form, prefix, middle, output) by a loop over units."""
    text = text or ""
    units = UNIT.findall(text)
    n = len(units)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < spm:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab é🙂\t\n\r\x0b\x1c\xa0<S>"), max_size=80), st.integers(1, 9))
def test_ends_of_units_are_those_of_a_plain_loop_also_in_pieces(text, piece):
    want = [m.end() for m in UNIT.finditer(text)]
    assert fim.unit_ends(text).tolist() == want
    whole, fim.PIECE = fim.PIECE, piece
    try:
        assert fim.unit_ends(text).tolist() == want
    finally:
        fim.PIECE = whole


ODD = [
    (1, None), (2, ""), (3, " "), (4, "one"), (5, " \t lead and trail \n"), (6, "a <P> mark"), (7, "half < S> marks <M"),
    (None, "no id here at all"), (8, "é ü 🙂 日本 語"), (8, "é ü 🙂 日本 語"), (9, "x" * 5000), (10, "nul \x00 and nbsp \xa0 here"),
]


def test_odd_texts_and_clashing_columns(table):
    rows = ODD + [(100 + i, f"word{i} and {'more ' * (i % 7)}\n end <") for i in range(60)]
    df = table([(*r, 1, "z") for r in rows], "doc_id bigint, text string, n int, output string")
    out = fim.transform(df)
    got = sorted((repr(tuple(r)) for r in out.collect()))
    assert got == sorted(repr((d, *plain(d, t))) for d, t in rows)
    back = out.select("doc_id", fim.restored("output", "form").alias("text")).collect()
    assert sorted(map(repr, map(tuple, back))) == sorted(repr((d, t or "")) for d, t in rows)
    assert {r.form for r in out.collect()} == {"plain", "psm", "spm"}


def test_rates_and_seed(table):
    rows = [(i, f"some words of text {i}") for i in range(300)]
    df = table(rows, "doc_id bigint, text string")
    forms = lambda **kw: [r.form for r in fim.transform(df, **kw).orderBy("doc_id").collect()]
    assert set(forms(rate=0)) == {"plain"} and set(forms(rate=100, spm=100)) == {"spm"} and set(forms(rate=100, spm=0)) == {"psm"}
    assert forms() == [plain(*r)[1] for r in rows] != forms(seed=7) == [plain(*r, seed=7)[1] for r in rows]


def test_a_very_long_text_is_cut_as_a_whole(table):
    doc = next(i for i in range(1000) if plain(i, "a b c")[1] != "plain")
    text = "lorem  ipsum\tdolor " * 150_000 + "end "
    row = fim.transform(table([(doc, text)], "doc_id bigint, text string")).first()
    assert tuple(row) == (doc, *plain(doc, text)) and row.n == 450_002


@pytest.mark.parametrize("kind", ["bigint", "int", "string"])
def test_empty_table_keeps_its_kind_of_id(table, kind):
    out = fim.transform(table([], f"doc_id {kind}, text string"))
    assert out.count() == 0 and dict(out.dtypes)["doc_id"] == kind


def test_query_restores_every_text(spark, sf_dir):
    rows = {r.doc_id: r for r in op13_fill_in_middle(spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert len(rows) == len(docs)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for d in docs:
        n, form, p, m, output = plain(d.doc_id, d.text)
        assert tuple(rows[d.doc_id]) == (d.doc_id, n, form, p, m, sha(output), sha(d.text or ""))
