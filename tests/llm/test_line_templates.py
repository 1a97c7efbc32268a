import random

from tandem.llm import line_templates as lt
from tandem.llm.queries import op8_line_templates

from . import brute


def plain_templates(line):
    ws = [None if any(c in "0123456789" for c in w) else w for w in brute.words(line)]
    if len(ws) < lt.LEAST_WORDS:
        return set()
    head, rest = (len(ws), *ws[: lt.DEPTH]), ws[lt.DEPTH :]
    parts = [tuple((k, w) for k, w in enumerate(rest) if k * lt.PARTS // len(rest) == p) for p in range(lt.PARTS)]
    if len(ws) < lt.LEAST_VARIED:
        return {(head, tuple(parts))}
    return {(head, p, tuple(x for q, x in enumerate(parts) if q != p)) for p in range(lt.PARTS)}


def plain(rows, least=lt.LEAST_DOCS):
    docs, first, lines = {}, {}, {}
    for place, (d, text) in enumerate(rows):
        lines[place] = [plain_templates(x) for x in (text or "").split("\n")]
        if d is not None:
            for t in set().union(*lines[place]):
                docs[t] = docs.get(t, 0) + 1
                first[t] = min(first.get(t, d), d)
    out, gone_lines = [], set()
    for place, (d, _) in enumerate(rows):
        if d is not None:
            gone_lines |= {(d, k) for k, ts in enumerate(lines[place]) if any(docs[t] >= least and first[t] != d for t in ts)}
    for place, (d, text) in enumerate(rows):
        kept = [x for k, x in enumerate((text or "").split("\n")) if not text or (d, k) not in gone_lines]
        n = len(lines[place]) if text else 0
        gone = len(lines[place]) - len(kept)
        out.append((d, "\n".join(kept) if gone else text, n, gone))
    return sorted(out, key=str)


def test_against_plain(table):
    rng = random.Random(6)
    logs = ["user {} logged in from host {} at the main door", "All rights reserved.", "page {} of {}", "a b c d e f g h {}", "x y", "\t indented  {} text here "]
    rows = []
    for d in range(120):
        lines = []
        for _ in range(rng.randint(0, 8)):
            t = rng.choice(logs + ["".join(rng.choice("abc ") for _ in range(rng.randint(0, 40)))])
            lines.append(t.format(*(rng.choice([rng.randrange(99), "anna", "bob"]) for _ in range(2))))
        rows.append((d, rng.choice(["\n", "\n\n"]).join(lines)))
    rows += [(None, "All rights reserved."), (500, None), (501, ""), (501, "All rights reserved."), (501, "All rights reserved.")]
    rows += [(600 + i, "w " * 30_000 + f"end{i}\r") for i in range(6)]
    docs = table([(*r, 1, "x") for r in rows], "doc_id bigint, text string, line int, template string")
    got = lt.deduplicate(docs)
    assert got.columns == ["doc_id", "text", "line", "template", "n_lines", "n_dropped"]
    assert sorted(map(tuple, got.select("doc_id", "text", "n_lines", "n_dropped").collect()), key=str) == plain(rows)


def test_variable_field_of_two_words():
    a, b = "the job named alpha beta has been done by now today", "the job named gamma delta has been done by now today"
    assert plain_templates(a) & plain_templates(b)
    assert not plain_templates(a) & plain_templates("the job named gamma beta has been done by now never")


def test_empty_table(table):
    assert lt.deduplicate(table([], "doc_id bigint, text string")).count() == 0


def test_query(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = op8_line_templates(spark, sf_dir).select("doc_id", "text", "n_lines", "n_dropped").collect()
    assert sorted(map(tuple, got), key=str) == plain(rows)
