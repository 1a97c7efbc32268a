import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tandem.llm import packing
from tandem.llm.encoding import byte_encoder
from tandem.llm.queries import op9_packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    "", None, " ", "a", "a b", " a", "a ", "a  b", "a   b", "a\nb", "a\n\nb", "a \nb", "a\n b", "it's John's 'd x'll",
    "a\tb", "a b", "a\x1cb", "x<|endoftext|>y", "é é ñ 中文 🙂", "1234 ½ ²", "don't\ndon't", "...!!!\n???", "\n", "word " * 5000 + "end",
    "x" * 5000, "\n" * 300, "a" + " " * 300 + "b", "naïve café Œuvre ŉ ÷ ×", "a\r\nb\r\n", "\ta\t\tb", "Ωmega ﬁ ４２", "don't I'LL we'Re ''s",
    "a" * 400 + " " + "b" * 401, "\x00 \x1f\x7f", "¿Qué? ¡No! «x»", "a\u0301 e\u0308", "\u200b \ufeff", "-" * 399 + "!", "1" * 200,
]


LIBRARY = Tokenizer.from_file(PATH)


def library(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def test_ids_are_the_library_ids():
    got = byte_encoder(PATH).encode(ODD)
    assert byte_encoder(PATH).ranked is not None
    for ids, text in zip(got, ODD):
        assert np.frombuffer(ids, "<u2").tolist() == library(text), text


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.sampled_from(" \n\t'.,sStreveml dD01éÑßŒ<|"), st.characters(max_codepoint=0x17F)), max_size=40))
def test_any_common_text(text):
    assert np.frombuffer(byte_encoder(PATH).encode([text])[0], "<u2").tolist() == library(text)


def check(pieces, texts, size):
    """Every id lies in one piece, sequences have no gap and only the last is short."""
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_sequence.setdefault(p.sequence_id, []).append(p)
    assert set(by_doc) == set(texts)
    tokenizer = Tokenizer.from_file(PATH)
    for doc, own in by_doc.items():
        ids = tokenizer.encode(texts[doc] or "", add_special_tokens=False).ids + [1]
        at = 0
        for p in sorted(own, key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids) and p.length > 0
            assert p.ids_crc32 == zlib.crc32(np.array(ids[at : at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids)
    for sequence, own in by_sequence.items():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at == size or sequence == max(by_sequence) and at < size
    assert sorted(by_sequence) == list(range(len(by_sequence)))


@pytest.mark.parametrize("size", [1, 7, 2048])
def test_odd_texts(table, size):
    texts = dict(enumerate(ODD[:-1] if size == 1 else ODD))
    docs = table([(k, v, "x", 1) for k, v in texts.items()], "doc_id bigint, text string, part string, place int")
    check(packing.pack(docs.repartition(3), PATH, size).collect(), texts, size)


def test_empty_table_and_repeated_rows(table):
    docs = table([], "doc_id bigint, text string")
    assert packing.pack(docs, PATH).count() == 0
    docs = table([(1, "a b"), (1, "a b"), (None, None)], "doc_id bigint, text string")
    assert sum(p.length for p in packing.pack(docs, PATH).collect()) == 7


def test_query(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    check(op9_packing(spark, sf_dir).collect(), docs, 2048)
