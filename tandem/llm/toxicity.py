"""Toxicity by a weighted finite-state grammar over clauses.

Five small transducers read the words of a clause: insult, threat, target (whom it is said to), negation and reported
speech. They are composed into one machine whose states are the tuples of theirs and whose outputs name what was
matched: an insult or threat, and whether it is aimed at somebody, negated, or reported as another's words. A text's
score weighs its matched clauses, not its words alone.

Fixed word lists serve the last four; the words and stems of insults are learned from labelled texts, as those whose
share of toxic texts is beyond chance. Texts of one family (the same least shingle hash) are learned from once, so that
copies of one text do not make its words look telling. The lexicon has at most ``LEXICON`` entries and is broadcast.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandem.llm.labels import held_out, sample
from tandem.llm.words import Words, running_sums, shingles, span_hashes, text_hash, words_of

SAMPLE_ROWS = 20_000  # labelled rows that are learned from, at most
LEXICON = 4096  # learned entries, at most
LEAST_TEXTS = 4  # toxic texts that an entry must occur in
PURITY = 0.6  # share of toxic texts among those that an entry occurs in, at least
STEMS = (4, 5, 6, 7, 8)  # lengths of stems in bytes

# Words of the grammar
TARGETS = "you your yours yourself u ya he she him them they those these people everyone dich dir euch dein deine vous toi tes vos usted ustedes vosotros ti".split()
THREATS = "kill hurt destroy murder strangle stab shoot beat crush punish umbringen töten verletzen zerstören tuer détruire frapper matar destruir golpear".split()
NEGATIONS = "not never no nor neither isn't aren't wasn't don't doesn't didn't won't cannot can't without nicht kein keine nie niemals pas jamais aucun nunca jamás ningún".split()
REPORTS = "said says say told wrote writes claimed claims quoted quotes called reported sagte sagt schrieb behauptet dit écrit affirme raconte dijo dice escribió afirma".split()

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)
_LISTS = ((TARGET, TARGETS), (THREAT, THREATS), (NEGATION, NEGATIONS), (REPORT, REPORTS))


@dataclass(frozen=True)
class Transducer:
    """Arcs (state, symbol) -> (state, output); a missing arc stays in its state and says nothing."""

    arcs: dict[tuple, tuple]
    states: tuple
    start: object = 0

    def step(self, state, symbol):
        return self.arcs.get((state, symbol), (state, ()))


def compose(parts: list[Transducer]) -> Transducer:
    """One machine that runs all parts over the same symbols; its output joins theirs, seen from the new state."""
    arcs = {}
    for state in itertools.product(*(p.states for p in parts)):
        for symbol in range(6):
            steps = [p.step(s, symbol) for p, s in zip(parts, state)]
            arcs[state, symbol] = (tuple(s for s, _ in steps), tuple(o for _, out in steps for o in out))
    return Transducer(arcs, tuple(itertools.product(*(p.states for p in parts))), tuple(p.start for p in parts))


NEGATION_REACH = 3  # words after a negation that it covers


def _machines() -> list[Transducer]:
    insult = Transducer({(0, INSULT): (0, ("insult",))}, (0,))
    threat = Transducer({(0, THREAT): (0, ("threat",))}, (0,))
    target = Transducer({(0, TARGET): (1, ())}, (0, 1))
    left = range(NEGATION_REACH + 2)  # counts down to 0 after a negation
    negation = Transducer(
        {(s, x): (NEGATION_REACH + 1 if x == NEGATION else max(s - 1, 0), ()) for s in left for x in range(6)}, tuple(left)
    )
    report = Transducer({(0, REPORT): (1, ())}, (0, 1))
    return [insult, threat, target, negation, report]


GRAMMAR = compose(_machines())

# What a clause can match: an insult or a threat, each plain, aimed, negated or reported (the last that holds).
MATCHES = [f"{how} {what}" for what in ("insult", "threat") for how in ("plain", "aimed", "negated", "reported")]
# weights before learning, of the matches, the number of words and the constant
_FIRST = np.array([3.0, 4.0, 0.5, 0.5, 0.5, 3.0, 0.0, 0.0, 0.0, -2.0])


def clause_matches(symbols: list[int]) -> list[int]:
    """The numbers in MATCHES of what a clause's words match, in order."""
    state, hits = GRAMMAR.start, []
    for symbol in symbols:
        state, out = GRAMMAR.step(state, symbol)
        for o in out:
            hits.append((o, state[3] > 0, state[4]))
    aimed = state[2]
    return [
        4 * (o == "threat") + (3 if reported else 2 if negated else 1 if aimed else 0) for o, negated, reported in hits
    ]


_MARK = np.ones(256, bool)  # bytes that are no part of a word's core: signs and digits
_MARK[[*range(97, 123), *range(65, 91), *range(128, 256)]] = False
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?;:"]] = True


@dataclass
class Cores:
    """Hashes of the words without signs at their ends, of their stems, and the number of each word's clause."""

    whole: np.ndarray
    stems: list[np.ndarray]
    clause: np.ndarray


def cores(words: Words) -> Cores:
    n = len(words.begin)
    whole, stems = np.zeros(n, np.uint64), [np.zeros(n, np.uint64) for _ in STEMS]
    ends = np.zeros(n, bool)  # a clause ends after the word
    for at, to, base, piece in words.blocks():
        begin, end = words.begin[at:to] - base, words.end[at:to] - base
        ends[at:to] = _STOP[piece[end - 1]]
        for edge, step in ((begin, 1), (end, -1)):
            trim = np.arange(len(begin))
            while len(trim):
                trim = trim[begin[trim] < end[trim]]
                look = begin[trim] if step > 0 else end[trim] - 1
                trim = trim[_MARK[piece[look]]]
                edge[trim] += step
        total = running_sums(piece)
        whole[at:to] = np.where(end > begin, span_hashes(total, begin, end), np.uint64(0))
        for out, length in zip(stems, STEMS):
            long = end - begin > length
            made = span_hashes(total, begin, np.minimum(begin + length, len(piece))) ^ np.uint64(length)
            out[at:to] = np.where(long, made, np.uint64(0))
    # a line end between two words ends a clause as well
    gap = np.zeros(n, bool)
    if n:
        line = np.flatnonzero(words.raw[words.begin[0] : words.end[-1]] == 10) + words.begin[0]
        before = np.searchsorted(words.begin, line) - 1
        gap[before[before >= 0]] = True
    starts = np.zeros(n, bool)
    starts[1:] = (ends | gap)[:-1]
    starts[words.bounds[:-1][words.counts > 0]] = True
    return Cores(whole, stems, np.cumsum(starts))


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per entry (hash of a word or stem) the number of toxic and of other texts, added up per batch."""
    for batch in batches:
        label = batch.column("label").to_numpy()
        for words in words_of(batch.column("text")):
            made = cores(words)
            row = np.repeat(np.arange(len(words.counts)), words.counts)
            entry = np.concatenate([made.whole, *made.stems])
            rows = np.tile(row, 1 + len(STEMS))
            rows, entry = rows[entry != 0], entry[entry != 0]
            order = np.lexsort((entry, rows))
            rows, entry = rows[order], entry[order]
            first = np.ones(len(rows), bool)
            first[1:] = (rows[1:] != rows[:-1]) | (entry[1:] != entry[:-1])
            toxic = label[words.first : words.last][rows[first]] > 0
            entry, place = np.unique(entry[first], return_inverse=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(entry.view(np.int64)), pa.array(np.bincount(place, toxic, len(entry)).astype(np.int64)),
                 pa.array(np.bincount(place, ~toxic, len(entry)).astype(np.int64))],
                names=["entry", "toxic", "other"],
            )


def _families(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = np.zeros(batch.num_rows, np.uint64)
        for words in words_of(batch.column("text")):
            found, bounds = shingles(words, 5)
            some = np.flatnonzero(np.diff(bounds))
            if len(some):
                out[words.first + some] = np.minimum.reduceat(found, bounds[some])
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("text"), batch.column("label"), pa.array(out.view(np.int64))],
            names=["doc_id", "text", "label", "family"],
        )


@dataclass
class Grammar:
    """What has been learned: sorted hashes of insult words and stems, and the weights of matches."""

    insults: np.ndarray
    weights: np.ndarray


def match_counts(column, insults: np.ndarray) -> np.ndarray:
    """(rows, len(MATCHES) + 1): how often each text matches each pattern, and its number of words."""
    out = np.zeros((len(column), len(MATCHES) + 1))
    fixed = [(kind, np.sort(np.array([text_hash(w) for w in words], np.uint64))) for kind, words in _LISTS]

    def among(values, known):
        if not len(known):
            return np.zeros(len(values), bool)
        at = np.minimum(np.searchsorted(known, values), len(known) - 1)
        return known[at] == values

    for words in words_of(column):
        made = cores(words)
        out[words.first : words.last, -1] = words.counts
        symbol = np.zeros(len(made.whole), np.int64)
        for kind, known in fixed:
            symbol[among(made.whole, known)] = kind
        for values in (made.whole, *made.stems):
            symbol[among(values, insults)] = INSULT
        row = np.repeat(np.arange(len(words.counts)), words.counts)
        wanted = np.unique(made.clause[(symbol == INSULT) | (symbol == THREAT)])
        a = np.searchsorted(made.clause, wanted, "left")
        b = np.searchsorted(made.clause, wanted, "right")
        for i, j in zip(a, b):
            for hit in clause_matches(symbol[i:j].tolist()):
                out[words.first + row[i], hit] += 1
    return out


def _chance(counts: np.ndarray, weights: np.ndarray) -> np.ndarray:
    x = np.log1p(counts) @ weights[:-1] + weights[-1]
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def _fit(counts: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton steps; the prior is centred on the weights before learning."""
    x = np.hstack([np.log1p(counts), np.ones((len(counts), 1))])
    w = _FIRST.copy()
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        slope = x.T @ (p - label) + 0.5 * (w - _FIRST)
        bend = (x * (p * (1 - p))[:, None]).T @ x + 0.5 * np.eye(len(w))
        step = np.linalg.solve(bend, slope)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Grammar:
    """Learn the insults and the weights from at most ``rows`` labelled rows that are not held out."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    chosen = sample(docs, labels, "toxic", rows).select("doc_id", "text", "label")
    families = chosen.mapInArrow(_families, f"doc_id {kind}, text string, label int, family bigint")
    once = families.groupBy("family").agg(F.min_by(F.struct("text", "label"), "doc_id").alias("x")).select("x.text", "x.label")
    once = once.persist()  # at most ``rows`` texts
    try:
        n, toxic = once.agg(F.count("*"), F.count_if(F.col("label") > 0)).first()
        if not toxic or toxic == n:
            return Grammar(np.zeros(0, np.uint64), _FIRST.copy())
        tally = (
            once.mapInArrow(_tally, "entry bigint, toxic bigint, other bigint")
            .groupBy("entry").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
            .where(F.col("toxic") + F.col("other") >= LEAST_TEXTS).persist()
        )
        rate, all_ = toxic / n, F.col("toxic") + F.col("other")
        # how much likelier the counts are at the entry's own rate than at the rate of all texts
        gain = F.col("toxic") * F.log(F.col("toxic") / (all_ * rate)) + F.when(
            F.col("other") > 0, F.col("other") * F.log(F.col("other") / (all_ * (1 - rate)))
        ).otherwise(0.0)
        least = math.log(max(1, tally.count())) + 2  # as many entries are tried
        found = (
            tally.where((F.col("toxic") >= LEAST_TEXTS) & (F.col("toxic") >= PURITY * all_))
            .withColumn("gain", gain).where(F.col("gain") >= least).orderBy(F.desc("gain"), "entry").limit(LEXICON)
        )
        insults = np.sort(np.array([r.entry for r in found.select("entry").collect()], np.int64).view(np.uint64))
        tally.unpersist()

        def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                counts = match_counts(batch.column("text"), insults)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("label"), pa.array(counts.tolist(), pa.list_(pa.float64()))], names=["label", "counts"]
                )

        # the same features and label many times over: a row of numbers for each different one
        rows_ = once.mapInArrow(features, "label int, counts array<double>").collect()
        counts = np.array([r.counts for r in rows_])
        return Grammar(insults, _fit(counts, np.array([float(r.label > 0) for r in rows_])))
    finally:
        once.unpersist()


def score(docs: DataFrame, grammar: Grammar, reject: float = 0.5) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs``.

    Null and empty texts, as all texts without a match, have the score of the constant alone. Repeated rows stay. Other
    columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(grammar)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            chance = _chance(match_counts(batch.column("text"), known.insults), known.weights)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(chance)], names=["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= reject).cast("int").alias("predicted"))


def reject(docs: DataFrame, grammar: Grammar, reject: float = 0.5) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose score is below ``reject``."""
    shared = docs.sparkSession.sparkContext.broadcast(grammar)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            chance = _chance(match_counts(batch.column("text"), known.insults), known.weights)
            yield batch.filter(pa.array(chance < reject))

    return docs.mapInArrow(run, docs.schema)
