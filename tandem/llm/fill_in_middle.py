"""Fill-in-the-middle transformation: every text is cut in three at unit borders and its middle may be moved to the end.

A unit is a word with the white space before it, or the white space that ends a text. One full match of ``(unit)*`` with
the regex library keeps every repetition of the group; ``match.ends(1)`` then gives both the number of units and the
offsets of the two cuts, without a loop over units. A text of more than ``PIECE`` characters is matched in pieces that end
where a word ends before white space, which is always the end of a unit, so its units are the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tandem.llm.words import slices

# The unit, white space as its own class of signs, and the three marks
UNITS = regex.compile(r"([\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+)*")
WORD_END = regex.compile(r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
PREFIX, SUFFIX, MIDDLE = MARKS = ("<P>", "<S>", "<M>")

PIECE = 1 << 20  # characters matched at once; the library needs some 230 bytes a unit


def unit_ends(text: str) -> np.ndarray:
    """The end of every unit of the text, in characters."""
    ends, at = [np.zeros(0, np.int64)], 0
    while at < len(text):
        border = WORD_END.search(text, at + PIECE) if len(text) - at > PIECE else None
        to = border.start() if border else len(text)
        ends.append(np.array(UNITS.fullmatch(text[at:to] if to - at < len(text) else text).ends(1), np.int64) + at)
        at = to
    return np.concatenate(ends)


def arrange(text: str, h: list[int], rate: int, spm: int) -> tuple[int, str, int | None, int | None, str]:
    """Number of units, form, characters of prefix and middle, and the arranged text."""
    ends = unit_ends(text)
    n = len(ends)
    if not text or any(m in text for m in MARKS) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    a, b = (int(ends[c - 1]) if c else 0 for c in sorted((h[0] % (n + 1), h[1] % (n + 1))))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h[3] % 100 < spm:
        return n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def transform(docs: DataFrame, seed: int = 42, rate: int = 50, spm: int = 80) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and output of every row of ``docs`` (doc_id, text).

    The cuts and the form come from the SHA-256 of ``seed:doc_id``, so a document is always cut alike: ``rate`` of 100
    texts are rearranged, of those ``spm`` of 100 with the suffix first. A null text reads as empty, a null id as an
    empty one; empty texts, and texts that hold a mark, stay plain. Repeated rows stay. Other columns are not read.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    numbers = F.array(*[F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("bigint") for i in range(4)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, ["text"]):
                texts, hashes = part.column("text").to_pylist(), part.column("h").to_pylist()
                columns = zip(*(arrange(t or "", h, rate, spm) for t, h in zip(texts, hashes)))
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
                made = [pa.array(c, k) for c, k in zip(columns, kinds)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *made], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", numbers.alias("h")).mapInArrow(
        run, f"doc_id {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"
    )


def restored(output: Column | str, form: Column | str) -> Column:
    """The text that was arranged. Three marks part an arranged text, and its pieces hold none."""
    output, form = (F.col(c) if isinstance(c, str) else c for c in (output, form))
    parts = F.split(output, "|".join(MARKS), -1)
    at = lambda *order: F.concat(*[F.element_at(parts, i) for i in order])
    return F.when(form == "psm", at(2, 4, 3)).when(form == "spm", at(3, 4, 2)).otherwise(output)
