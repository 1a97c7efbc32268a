"""URL filter: a blocked Bloom filter of listed host and path prefixes, then an exact hash join of what it lets pass.

A listed entry covers its host with all subdomains and every path that starts with its path; the longest entry wins.
A url's candidates are its host's suffixes at dots, with its path's prefixes of the lengths that the list has. The filter is
a table of blocks of eight 64-bit words, one bit in each word per entry; it has at most ``MAX_BLOCKS`` rows whatever
the length of the list, so it may be broadcast. A fuller filter lets more candidates pass to the exact join, which
decides: the result does not depend on the filter's size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS_PER_ENTRY = 24
MAX_BLOCKS = 1 << 16
_WORDS = 8


def _lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/ ? #``, lower-cased; path: then up to ``? #``. Else both empty."""
    known = F.coalesce(url, F.lit(""))
    mark = F.instr(known, F.lit("://"))
    rest = F.when(mark > 0, F.substr(known, mark + 3)).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return _lower(host), path


def _hashed(df: DataFrame, n_blocks: int) -> DataFrame:
    """Adds the block and one bit for each of its words."""
    bits = {f"_b{i}": F.expr(f"shiftleft(1L, CAST(shiftrightunsigned(_marks, {6 * i}) & 63 AS INT))") for i in range(_WORDS)}
    return (
        df.withColumn("_block", F.pmod(F.xxhash64("host", "path"), F.lit(n_blocks)))
        .withColumn("_marks", F.xxhash64("host", "path", F.lit("bits")))
        .withColumns(bits)
        .drop("_marks")
    )


def bloom_blocks(entries: DataFrame, n_blocks: int) -> DataFrame:
    """The filter: one row per block that has a bit, at most ``n_blocks`` rows."""
    return _hashed(entries.select("host", "path"), n_blocks).groupBy("_block").agg(
        *[F.bit_or(f"_b{i}").alias(f"_w{i}") for i in range(_WORDS)]
    )


def judge(pages: DataFrame, listed: DataFrame, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule and verdict of every row of ``pages``.

    ``listed``: host, path, verdict. An entry listed with both verdicts blocks. A url without a listed entry has no
    rule and the default verdict; so have null urls and urls without ``://``, whose host and path are empty. Repeated
    rows stay. Other columns of ``pages`` are not read.
    """
    entries = listed.where("host IS NOT NULL AND path IS NOT NULL AND verdict IS NOT NULL").groupBy("host", "path").agg(
        F.max("verdict").alias("verdict")  # of allow and block the greater
    )
    facts = entries.agg(F.count("*").alias("n"), F.sort_array(F.collect_set(F.length("path"))).alias("lengths")).first()
    n_blocks = 1
    while n_blocks < MAX_BLOCKS and n_blocks * 64 * _WORDS < facts.n * BITS_PER_ENTRY:
        n_blocks *= 2
    lengths = F.array(*[F.lit(x) for x in facts.lengths]).cast("array<int>")  # as many as path lengths, not entries

    host, path = host_and_path(F.col("url"))
    urls = pages.select("page_id", host.alias("host"), path.alias("path"))
    distinct = urls.where("host <> ''").select(F.col("host").alias("_host"), F.col("path").alias("_path")).distinct()
    labels = F.split("_host", r"\.", -1)
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")
    )
    fitting = F.filter(lengths, lambda n: n <= F.length("_path"))
    candidates = (
        distinct.select("_host", "_path", F.explode(suffixes).alias("host"))
        .select("*", F.explode(fitting).alias("_n"))
        .select("_host", "_path", "host", F.expr("substring(_path, 1, _n)").alias("path"))
    )
    blocks = F.broadcast(bloom_blocks(entries, n_blocks))  # at most MAX_BLOCKS rows
    passed = _hashed(candidates, n_blocks).join(blocks, "_block")
    for i in range(_WORDS):
        passed = passed.where(F.expr(f"(_w{i} & _b{i}) <> 0"))
    exact = passed.select("_host", "_path", "host", "path").join(entries, ["host", "path"])
    size = F.length("host") + F.length("path")
    best = exact.groupBy("_host", "_path").agg(
        F.max_by(F.struct(F.concat("host", "path").alias("rule"), "verdict"), F.struct(size, F.length("host"))).alias("best")
    )
    return urls.join(best, (F.col("host") == F.col("_host")) & (F.col("path") == F.col("_path")), "left").select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
    )
