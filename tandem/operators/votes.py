"""Chapter equivalences: votes, consensus, official anchors, interpolation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tandem.operators.distributed import order_number

PAIR = ["work_id", "capitulo_manhwa"]


def upsert_votes(votes: DataFrame) -> DataFrame:
    """One vote per work, manhwa chapter and reader: the last one."""
    at = order_number(F.unix_micros(F.col("creada_en").cast("timestamp")), F.col("id"))
    last = F.max_by("capitulo_novela", at)
    return votes.groupBy(*PAIR, "user_id").agg(last.alias("capitulo_novela"), F.max("creada_en").alias("creada_en"))


def consensus(votes: DataFrame) -> DataFrame:
    """Most voted novel chapter per manhwa chapter; a tie goes to the lower chapter."""
    return most_voted(votes.groupBy(*PAIR, "capitulo_novela").agg(F.count("*").alias("n")))


def most_voted(counted: DataFrame) -> DataFrame:
    """``consensus`` of counted votes: work_id, capitulo_manhwa, capitulo_novela, n."""
    best = F.max(F.struct(F.col("n").alias("n"), (-F.col("capitulo_novela")).alias("m")))
    return counted.groupBy(*PAIR).agg(best.alias("b")).select(
        *PAIR, (-F.col("b.m")).alias("capitulo_novela"), F.col("b.n").alias("votos")
    )


def combined_equivalences(votes: DataFrame, anchors: DataFrame) -> DataFrame:
    """Community consensus overlaid by the official anchors."""
    com = consensus(votes).select(*PAIR, F.col("capitulo_novela").alias("com"))
    off = anchors.select(*PAIR, F.col("capitulo_novela").alias("off"))
    return com.join(off, PAIR, "full_outer").select(
        *PAIR, F.coalesce("off", "com").alias("capitulo_novela"), F.col("off").isNotNull().alias("oficial")
    )


def furthest_equivalence(combined: DataFrame) -> DataFrame:
    return combined.groupBy("work_id").agg(
        F.max("capitulo_manhwa").alias("capitulo_manhwa"),
        F.max_by("capitulo_novela", "capitulo_manhwa").alias("capitulo_novela"),
    )


def manhwa_to_novel(chapters: DataFrame, anchors: DataFrame) -> DataFrame:
    """Novel chapter for every distinct (work, manhwa chapter), by interpolating the anchors.

    Input rows are reduced to distinct numbers before the window, so a work
    contributes at most one row per chapter number and per anchor however many
    copies of a chapter there are. Result: work_id, numero, en_novela (NULL when
    the work has no anchors or the number is below 1).
    """
    x = F.col("x")
    wanted = chapters.where("numero IS NOT NULL").select("work_id", F.col("numero").alias("x")).distinct()
    points = anchors.select("work_id", F.col("capitulo_manhwa").alias("x"), F.col("capitulo_novela").alias("y"))
    marked = points.select("work_id", "x", F.struct("x", "y").alias("p"), F.lit(False).alias("q")).unionByName(
        wanted.select("work_id", "x", F.lit(None).cast(points.select(F.struct("x", "y")).schema[0].dataType).alias("p"),
                      F.lit(True).alias("q"))
    )
    # anchors of a number come before the number itself
    up = Window.partitionBy("work_id").orderBy("x", "q").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # the next anchor is the last one seen from the other end: both frames only grow, so each row is added once
    down = Window.partitionBy("work_id").orderBy(F.desc("x"), F.desc("q")).rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        marked.withColumn("lo", F.last("p", ignorenulls=True).over(up))
        .withColumn("hi", F.last("p", ignorenulls=True).over(down))
    )
    # the anchor before each anchor gives the slope past the last one
    chain = Window.partitionBy("work_id").orderBy("x")
    slope = points.withColumn("prev", F.lag(F.struct("x", "y")).over(chain))
    tail = slope.groupBy("work_id").agg(F.max_by("prev", "x").alias("prev"))
    lo, hi, prev = F.col("lo"), F.col("hi"), F.col("prev")

    def line(a, b):
        run = (b["x"] - a["x"]).cast("double")
        return (x - a["x"]) / run * (b["y"] - a["y"])

    def half_up(v):
        return F.floor(v + 0.5).cast("int")

    value = (
        F.when(x < 1, F.lit(None))
        .when(lo["x"] == x, lo["y"])
        .when(lo.isNull(), hi["y"])
        .when(hi.isNotNull(), half_up(lo["y"] + line(lo, hi)))
        .when(prev.isNull(), lo["y"])
        .otherwise(half_up(lo["y"] + (x - lo["x"]) * ((lo["y"] - prev["y"]) / (lo["x"] - prev["x"]).cast("double"))))
    )
    return (
        placed.where("q").join(tail, "work_id", "left").select("work_id", x.alias("numero"), value.alias("en_novela"))
    )
