import hashlib
import random

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tandem.llm import lexicon
from tandem.llm.queries import op6_lexicon

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    "", None, " ", "The the THE", "it's John's 'd x'll 're", "a\x1cb c", "a b\tc\u2003d", "x<|endoftext|>y", "<|startoftext|>",
    "É é e\u0301 ñ Ñ ß ẞ İ ı ſ ŉ ΑΣ σς", "中文 🙂 ﬁ", "12½² 34", "...!!!???", "ab_cd-ef|gh", "Ü" * 50, "x" * 3000, "w " * 20_000, "÷×Ā",
]


def test_automaton_is_exact_and_minimal(tmp_path):
    rng = random.Random(1)
    words = list({"".join(rng.choice("abcé") for _ in range(rng.randint(1, 6))) for _ in range(800)})
    ids = [[rng.randrange(50_000) for _ in range(rng.randint(1, 4))] for _ in words]
    parts = lexicon.compile_words(words, ids)
    lexicon.save(parts, str(tmp_path / "x"))
    made = lexicon.Lexicon(str(tmp_path / "x"))
    places = made.places([*words, "", "zz", "abcabcabc"])
    assert [made.ids[made.bounds[k] : made.bounds[k + 1]].tolist() for k in places[: len(words)]] == ids
    assert places[len(words) :].tolist() == [-1, -1, -1]
    # as many states as there are different sets of endings
    raw = [w.encode() for w in words]
    heads = {w[:k] for w in raw for k in range(len(w) + 1)}
    assert len(made.ends) == len({frozenset(w[len(h) :] for w in raw if w.startswith(h)) for h in heads})


def test_no_words(tmp_path):
    lexicon.save(lexicon.compile_words([], []), str(tmp_path / "x"))
    assert lexicon.Lexicon(str(tmp_path / "x")).places(["a"]).tolist() == [-1]


def check(rows, texts):
    library = Tokenizer.from_file(PATH)
    for r in rows:
        ids = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids), texts[r.doc_id]
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_odd_texts(table, tmp_path, spark):
    docs = table([(i, t, b"x") for i, t in enumerate(ODD)], "doc_id bigint, text string, ids binary")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    rows = op6_lexicon(spark, str(tmp_path)).collect()
    assert len(rows) == len(ODD)
    check(rows, dict(enumerate(ODD)))


def test_decode_is_the_same_apart(table):
    docs = table(list(enumerate(ODD)), "doc_id bigint, text string")
    both = lexicon.encode(docs, PATH, lexicon.publish(docs, PATH, 5), decoded=True)
    apart = lexicon.decode(both.select("doc_id", "ids"), PATH)
    assert sorted(map(tuple, both.collect())) == sorted(map(tuple, apart.collect()))


def test_frequent_words_count_all(table):
    docs = table([(1, "b a, a"), (2, "B c"), (3, None), (4, "a\x1cb")], "doc_id bigint, text string")
    assert lexicon.frequent_words(docs, 3) == lexicon.frequent_words(docs, 2) == ["a", "b"]
    assert lexicon.frequent_words(docs, 4) == ["a", "b", ",", "c"]
    assert lexicon.frequent_words(docs, 1) == []
    assert lexicon.frequent_words(docs.limit(0)) == []


def test_query(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = op6_lexicon(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    check(rows, texts)
