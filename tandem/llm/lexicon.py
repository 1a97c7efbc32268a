"""Encoding and decoding with a transducer of the frequent words.

The frequent words of all documents, counted in full, are compiled on the driver into a minimal acyclic automaton:
words that end alike share their last states. Every edge carries a number, and the sum along a word is the word's place
in the table of its token ids. The automaton is a file of a few megabytes whose size the number of words bounds; Spark
hands it to every executor, and each worker maps it into memory. A batch's new words walk it together, one letter of
all words at a time. A word that it does not have is merged exactly with the vocabulary's own merges.
"""

from __future__ import annotations

import functools
import os
import re
import tempfile
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandem.llm.encoding import forget, tokenizer
from tandem.llm.store import written

FREQUENT = 131_072
CHUNK = 256
_CLASSES = 64
_FLUSH = 100_000  # distinct pieces a task counts before it hands them on

# Pieces of these letters and marks are split here; any other piece goes through the library whole.
_PLAIN = re.compile(r"(?!.*<\|)[!-~À-ÖØ-öø-įĲ-ň]+")
_WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ňĀ-ň]+|[0-9]|[!-/:-@\[-`{-~]+")
_CONTROLS = "\x1c\x1d\x1e\x1f"  # white space for Python, but not for the vocabulary


def _split(text: str) -> list[str] | None:
    """The pieces between white space, or None where the two ideas of white space differ."""
    return None if any(c in text for c in _CONTROLS) else text.split()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pieces: Counter = Counter()

    def words():
        out: Counter = Counter()
        for piece, n in pieces.items():
            if _PLAIN.fullmatch(piece):
                for w in _WORD.findall(piece.lower()):
                    out[w] += n
        pieces.clear()
        return pa.RecordBatch.from_arrays(
            [pa.array(list(out), pa.string()), pa.array(list(out.values()), pa.int64())], names=["word", "n"]
        )

    for batch in batches:
        for text in batch.column("text"):
            pieces.update(_split(text.as_py() or "") or ())
            if len(pieces) > _FLUSH:
                yield words()
    yield words()


def frequent_words(docs: DataFrame, n: int = FREQUENT) -> list[str]:
    """The most frequent words, n at most, most frequent first; counts are over all documents.

    Words are taken by classes of frequency (steps of 1 / ``_CLASSES`` of a doubling), as many whole classes as fit, so
    only the sizes of the classes and the chosen words come to the driver.
    """
    counts = docs.select("text").mapInArrow(_count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    counts = written(counts.withColumn("class", F.floor(F.log2("n") * _CLASSES).cast("int")), "word-counts")
    sizes = sorted(counts.groupBy("class").count().collect(), reverse=True)  # a few thousand at most
    taken, least = 0, None
    for class_, size in sizes:
        taken += size
        if taken > n:
            break
        least = class_
    if least is None:
        return []
    chosen = counts.where(F.col("class") >= least).select("word", "n").collect()
    return [r.word for r in sorted(chosen, key=lambda r: (-r.n, r.word))]


def compile_words(words: list[str], ids: list[list[int]]) -> dict[str, np.ndarray]:
    """The minimal automaton of the words, built in their order: states that accept the same endings are one state."""
    order = sorted(range(len(words)), key=lambda i: words[i].encode())
    merged: dict[tuple, int] = {}
    states: list[tuple] = []

    def settle(node):
        key = (node[0], tuple(node[1]))
        if key not in merged:
            merged[key] = len(states)
            states.append(key)
        return merged[key]

    # path[k]: the open state after k letters of the last word, as [is a word, edges so far]
    path: list[list] = [[False, []]]
    last = b""
    for i in order:
        word = words[i].encode()
        same = next((k for k, (a, b) in enumerate(zip(last, word)) if a != b), min(len(last), len(word)))
        for k in range(len(path) - 1, same, -1):
            node = path.pop()
            path[-1][1].append((last[k - 1], settle(node)))
        path.extend([False, []] for _ in range(len(word) - same))
        path[-1][0] = True
        last = word
    for k in range(len(path) - 1, 0, -1):
        node = path.pop()
        path[-1][1].append((last[k - 1], settle(node)))
    start = settle(path[0])

    below = np.zeros(len(states), np.int64)  # words that a state leads to; a state's targets come before it
    keys, targets, skips = [], [], []
    for s, (ends, edges) in enumerate(states):
        passed = int(ends)
        for letter, target in edges:
            keys.append(s << 8 | letter)
            targets.append(target)
            skips.append(passed)
            passed += int(below[target])
        below[s] = passed
    lengths = np.array([len(ids[i]) for i in order], np.int64)
    return {
        "start": np.array([start], np.int64),
        "keys": np.array(keys, np.int64),
        "targets": np.array(targets, np.int64),
        "skips": np.array(skips, np.int64),
        "ends": np.array([e for e, _ in states], np.int64),
        "bounds": np.concatenate([[0], np.cumsum(lengths)]),
        "ids": np.array([x for i in order for x in ids[i]], np.int64),
    }


_PARTS = ("start", "keys", "targets", "skips", "ends", "bounds", "ids")


def save(parts: dict[str, np.ndarray], path: str) -> None:
    """One file: the lengths of the parts, then the parts."""
    with open(path, "wb") as out:
        np.array([len(parts[k]) for k in _PARTS], np.int64).tofile(out)
        for k in _PARTS:
            parts[k].astype(np.int64).tofile(out)


class Lexicon:
    """The automaton of a file, mapped into memory."""

    def __init__(self, path: str):
        lengths = np.fromfile(path, np.int64, len(_PARTS))
        data = np.memmap(path, np.int64, "r", offset=8 * len(_PARTS)) if lengths.sum() else np.zeros(0, np.int64)
        ends = np.cumsum(lengths)
        for k, a, b in zip(_PARTS, ends - lengths, ends):
            setattr(self, k, np.asarray(data[a:b]))

    def outputs(self, places: np.ndarray) -> list[bytes]:
        """The ids of the words at these places, as little-endian unsigned 32-bit integers."""
        first, last = self.bounds[places], self.bounds[places + 1]
        size = last - first
        at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(first, size)
        raw, ends = self.ids[at].astype("<u4").tobytes(), (4 * np.cumsum(size)).tolist()
        return [raw[a:b] for a, b in zip([0, *ends], ends)]

    def places(self, words: list[str]) -> np.ndarray:
        """The place of each word among the automaton's words, or -1."""
        raw = [w.encode() for w in words]
        size = np.array([len(w) for w in raw], np.int64)
        out = np.full(len(raw), -1, np.int64)
        if not len(self.keys) or not len(raw):
            return out
        letters = np.frombuffer(b"".join(raw), np.uint8)
        first = np.cumsum(size) - size
        rows, state, place = np.arange(len(raw)), np.full(len(raw), self.start[0]), np.zeros(len(raw), np.int64)
        step = 0
        while len(rows):
            done = size[rows] == step
            good = done & (self.ends[state] > 0)
            out[rows[good]] = place[good]
            rows, state, place = rows[~done], state[~done], place[~done]
            wanted = state << 8 | letters[first[rows] + step]
            at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
            hit = self.keys[at] == wanted
            rows, place, state = rows[hit], place[hit] + self.skips[at[hit]], self.targets[at[hit]]
            step += 1
        return out


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit integers."""

    def __init__(self, vocabulary: str, lexicon: str):
        self.library = tokenizer(vocabulary)
        self.lexicon = Lexicon(lexicon)
        self.known: dict[str, bytes] = {}

    def _merged(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, "<u4").tobytes() for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _work_out(self, pieces: list[str]) -> dict[str, bytes]:
        plain, odd = [], []
        for p in pieces:
            (plain if _PLAIN.fullmatch(p) else odd).append(p)
        split = [_WORD.findall(p.lower()) for p in plain]
        words = list(set().union(*split))
        places = self.lexicon.places(words)
        seen = np.flatnonzero(places >= 0)
        ids = dict(zip([words[i] for i in seen], self.lexicon.outputs(places[seen])))
        unseen = [words[i] for i in np.flatnonzero(places < 0)]
        merged = self._merged(unseen + odd)
        ids.update(zip(unseen, merged))
        out = dict(zip(odd, merged[len(unseen) :]))
        of = ids.__getitem__
        out.update(zip(plain, [of(ws[0]) if len(ws) == 1 else b"".join(map(of, ws)) for ws in split]))
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        parts = [_split(t or "") for t in texts]
        known = self.known
        missing = set().union(*filter(None, parts)).difference(known)
        new = self._work_out(missing) if missing else {}
        known.update(new)
        of = known.__getitem__
        whole = iter(self._merged([t for t, ps in zip(texts, parts) if ps is None]))
        out = [next(whole) if ps is None else b"".join(map(of, ps)) for ps in parts]
        forget(known, new)
        return out


@functools.lru_cache(maxsize=1)
def _encoder(vocabulary: str, name: str) -> Encoder:
    return Encoder(vocabulary, SparkFiles.get(name))


@functools.cache
def _tokens(vocabulary: str) -> list[str]:
    library = tokenizer(vocabulary)
    return [library.id_to_token(i) or "" for i in range(library.get_vocab_size())]


def publish(docs: DataFrame, vocabulary: str, n: int = FREQUENT) -> str:
    """Compile the frequent words of ``docs`` and hand the file to all executors; the name to give to ``encode``."""
    words = frequent_words(docs, n)
    made = tokenizer(vocabulary).encode_batch_fast(words, add_special_tokens=False)
    name = f"lexicon-{uuid.uuid4().hex}.bin"
    folder = os.path.realpath(tempfile.mkdtemp())
    save(compile_words(words, [x.ids for x in made]), os.path.join(folder, name))
    docs.sparkSession.sparkContext.addFile(os.path.join(folder, name))
    return name


def _decoded(vocabulary: str, ids: list[bytes]) -> pa.Array:
    """The vocabulary names no decoder, so a text is its tokens with a space between them."""
    name = _tokens(vocabulary).__getitem__
    return pa.array([" ".join(map(name, np.frombuffer(x, "<u4").tolist())) for x in ids], pa.string())


def encode(docs: DataFrame, vocabulary: str, lexicon: str, decoded: bool = False) -> DataFrame:
    """doc_id and ids (little-endian unsigned 32-bit integers) of every whole text, and if asked their decoded text.

    Null and empty texts have no ids. Repeated rows stay. Other columns of ``docs`` are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(vocabulary, lexicon)
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                rows = batch.slice(at, CHUNK)
                ids = encoder.encode(rows.column("text").to_pylist())
                columns = {"doc_id": rows.column("doc_id"), "ids": pa.array(ids, pa.binary())}
                if decoded:
                    columns["decoded"] = _decoded(vocabulary, ids)
                yield pa.RecordBatch.from_pydict(columns)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids binary" + ", decoded string" * decoded)


def decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, ids and the decoded text of every row of ``encoded`` (doc_id, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                rows = batch.slice(at, CHUNK)
                texts = _decoded(vocabulary, rows.column("ids").to_pylist())
                yield pa.RecordBatch.from_arrays([*rows.columns, texts], names=["doc_id", "ids", "decoded"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, ids binary, decoded string")
