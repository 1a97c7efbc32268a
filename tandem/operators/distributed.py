"""Building blocks that keep global order, top-k and graph work spread over all tasks.

A window without ``partitionBy`` puts the table on one task, and a window over a
hot key puts that key on one task. The helpers here replace both.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tandem.session import cut_lineage

_ROW_BITS = 33  # monotonically_increasing_id: partition in the high bits, row in the low 33


def order_number(first: Column, second: Column) -> Column:
    """One number that sorts like (first, second), both whole numbers, ``first`` below 10^18.

    Null sorts first. Its width is fixed, so ``max`` and ``max_by`` over it aggregate by hash, which they cannot over a
    struct.
    """
    high = F.coalesce(first.cast("decimal(19,0)"), F.lit(Decimal(-(10**18)))) * F.lit(Decimal(2 * 10**19))
    low = F.coalesce(second.cast("decimal(19,0)"), F.lit(Decimal(-(10**18))))
    return (high.cast("decimal(38,0)") + low).cast("decimal(38,0)")


def one_per_key(df: DataFrame, keys: Sequence[str], order: Column, largest: bool = True) -> DataFrame:
    """The row of each key with the largest (or least) whole number ``order``; ties go by a hash of the row.

    The choice is made over fixed-width numbers, which combine by hash before the shuffle; the chosen rows are then
    joined back, so texts are never held in an aggregate. Equal rows come out once. Null keys are keys.
    """
    rank = order if largest else -order
    ranked = df.withColumn("_rank", order_number(rank, F.xxhash64(*df.columns)))
    best = ranked.groupBy(*keys).agg(F.max("_rank").alias("_best"))
    on = [F.col(f"r.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys] + [F.col("r._rank") == F.col("b._best")]
    return ranked.alias("r").join(best.alias("b"), on, "left_semi").drop("_rank").distinct()


def global_position(
    df: DataFrame, order: Sequence[Column], name: str = "position", running: dict[str, Column] | None = None
) -> DataFrame:
    """Add the exact 1-based position of every row in a total order.

    ``order`` must end with a unique column. One range shuffle sorts the data;
    the row number inside each range is written down with the rows, and the
    number of rows before each range (one value per partition) is added by a
    join. No task ever sees more than one range. ``running`` adds sums over all
    rows up to and including the row, in the same way.
    """
    running = running or {}
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    marked = ranged.withColumns({"_mid": F.monotonically_increasing_id(), **{f"_r_{k}": v for k, v in running.items()}})
    written = cut_lineage(marked).withColumn("_part", F.shiftright("_mid", _ROW_BITS))
    per_part = written.groupBy("_part").agg(
        F.count("*").alias("_n"), *[F.sum(f"_r_{k}").alias(f"_s_{k}") for k in running]
    )
    # one row per partition: the only window without a key, and its size is the partition count
    before = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_part.select(
        "_part",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
        *[F.coalesce(F.sum(f"_s_{k}").over(before), F.lit(0)).alias(f"_b_{k}") for k in running],
    )
    in_part = F.col("_mid").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    placed = written.join(offsets, "_part").withColumn(name, F.col("_before") + in_part + 1)
    up_to = Window.partitionBy("_part").orderBy("_mid").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for k in running:
        placed = placed.withColumn(k, F.col(f"_b_{k}") + F.sum(f"_r_{k}").over(up_to)).drop(f"_r_{k}", f"_b_{k}")
    return placed.drop("_mid", "_part", "_before")


def position_in_group(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str = "position"
) -> DataFrame:
    """``row_number`` per group for groups of any size: a hot group spans many ranges."""
    placed = global_position(df, [F.col(k) for k in keys] + list(order), "_pos")
    first = placed.groupBy(*keys).agg(F.min("_pos").alias("_first"))
    on = [F.col(f"p.{k}").eqNullSafe(F.col(f"f.{k}")) for k in keys]
    return (
        placed.alias("p")
        .join(first.alias("f"), on)
        .select("p.*", (F.col("p._pos") - F.col("f._first") + 1).alias(name))
        .drop("_pos")
    )


def previous_in_group(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], value: str, name: str
) -> DataFrame:
    """``lag`` per group for groups of any size, as an equi-join on position - 1."""
    placed = global_position(df, [F.col(k) for k in keys] + list(order), "_pos")
    before = placed.select(
        (F.col("_pos") + 1).alias("_pos"),
        F.struct(*keys).alias("_group"),
        F.col(value).alias("_value"),
    )
    same = F.col("_group").eqNullSafe(F.struct(*[F.col(k) for k in keys]))
    return (
        placed.join(before, "_pos", "left")
        .withColumn(name, F.when(same, F.col("_value")))
        .drop("_pos", "_group", "_value")
    )


def top_per_group(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, spread: int | None = None, name: str = "rank"
) -> DataFrame:
    """The first ``k`` rows of each group, exact, in two steps.

    Step one takes the top ``k`` of each (group, salt) slice, so a hot group is
    cut into ``spread`` tasks, by default as many as the session has shuffle
    partitions; step two ranks the at most ``spread * k`` survivors. Every row
    of the true top ``k`` is in the top ``k`` of its slice.
    """
    spread = spread or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(spread)))
    first = Window.partitionBy(*keys, "_salt").orderBy(*order)
    final = Window.partitionBy(*keys).orderBy(*order)
    return (
        salted.withColumn("_rank", F.row_number().over(first))
        .where(F.col("_rank") <= k)
        .drop("_rank", "_salt")
        .withColumn(name, F.row_number().over(final))
        .where(F.col(name) <= k)
    )


def small_side(df: DataFrame, rows: int = 1 << 16) -> DataFrame:
    """A table of short rows for a join: broadcast if its counted rows are few, else shuffled."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def spread(df: DataFrame) -> DataFrame:
    """A table whose rows are short and cost much each, dealt over all tasks: a file of a few MB is read by one or two."""
    return df.repartition(2 * df.sparkSession.sparkContext.defaultParallelism)


def shuffled(df: DataFrame) -> DataFrame:
    """A table that grows with the input, for a join: sorted and merged, never broadcast. The size that Spark expects of
    it comes from compressed files, and from before rows are exploded."""
    return df.hint("merge")


def _large_star(edges: DataFrame) -> DataFrame:
    """Over edges u > v: every larger neighbour of a node moves to the node's smallest neighbour."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    smallest = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    moved = both.join(smallest, "u").where("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Over edges u > v: a node and its smaller neighbours move to the smallest of them."""
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = F.array(
        F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v"))
    )
    return edges.join(low, "u").select(F.explode(moved).alias("e")).select("e.u", "e.v").where("u <> v").distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Connected components of an undirected graph: (node, root), root = smallest node.

    Large-star / small-star rounds: each keeps the graph's components and halves
    distances, so the number of rounds grows with the logarithm of the longest
    chain. Each step is written to the shared folder, as each reads its input
    several times. A hub is never
    collected: its new edges come from a ``min`` per node that is pre-aggregated,
    joined back to the edge list.
    """
    current = cut_lineage(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    )
    for _ in range(max_rounds):
        current = cut_lineage(_small_star(cut_lineage(_large_star(current))))
        # done when every edge leads straight to a root: nobody has two targets, no target has one
        ends = current.select(F.col("u").alias("node"), F.col("v").alias("to")).unionByName(
            current.select(F.col("v").alias("node"), F.lit(None).alias("to"))
        )
        open_ends = ends.groupBy("node").agg(
            F.min("to").alias("lo"), F.max("to").alias("hi"), F.bool_or(F.col("to").isNull()).alias("target")
        ).where("lo IS NOT NULL AND (target OR lo <> hi)")
        if open_ends.limit(1).count() == 0:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = current.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return current.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots).distinct()


def grow_components(members: DataFrame, roots: DataFrame, edges: DataFrame, a: str = "a", b: str = "b") -> tuple[DataFrame, DataFrame]:
    """What new edges add to components that are kept: rows to append to ``members``, and ``roots`` rows to put in place.

    ``members``: node, grupo, never rewritten. ``roots``: grupo, root, the smallest node that the group's nodes are
    connected with now. Only groups that the edges touch are read into the graph, and of groups that grow together only their row in
    ``roots`` changes, however many nodes they have. Nodes are compared as ``components`` does.
    """
    ends = cut_lineage(edges.select(F.col(a).alias("_a"), F.col(b).alias("_b")).distinct())
    nodes = ends.select(F.col("_a").alias("node")).union(ends.select("_b")).distinct()
    known = nodes.join(members, "node", "left").join(roots, "grupo", "left")
    rooted = cut_lineage(known.select("node", "grupo", F.coalesce("root", "node").alias("root")))
    of = lambda end, name: rooted.select(F.col("node").alias(end), F.col("root").alias(name))
    linked = ends.join(of("_a", "a"), "_a").join(of("_b", "b"), "_b").where("a <> b").select("a", "b")
    merged = cut_lineage(components(linked)).select(F.col("node").alias("root"), F.col("root").alias("_now"))
    new = rooted.where("grupo IS NULL").join(merged, "root", "left").select("node", F.coalesce("_now", "root").alias("grupo"))
    new = cut_lineage(new)
    begun = new.where("node = grupo").select("grupo", F.col("grupo").alias("root"))
    moved = roots.join(small_side(merged.where("root <> _now")), "root").select("grupo", F.col("_now").alias("root"))
    return new, cut_lineage(moved.unionByName(begun))


def put_in_place(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """The table with the rows of the same key replaced, and new ones added."""
    return table.join(rows.select(key), key, "left_anti").unionByName(rows)


def follow_chains(links: DataFrame, src: str, dst: str, max_rounds: int = 40) -> DataFrame:
    """Resolve src -> dst chains to their end by pointer doubling; one dst per src.

    A cycle has no end: its members, and what leads to them, come out unresolved
    and are left out. Round r knows where 2^r steps lead, so a chain that has
    not ended after as many steps as there are links runs in a cycle.
    """
    current = cut_lineage(links.select(F.col(src).alias("s"), F.col(dst).alias("d")).where("s <> d"))
    links_left, reach = current.count(), 1
    for _ in range(max_rounds):
        step = current.select(F.col("s").alias("d"), F.col("d").alias("d2"))
        joined = current.join(step, "d", "left")
        moved = cut_lineage(joined.select("s", F.coalesce("d2", "d").alias("d"), F.col("d2").isNotNull().alias("m")))
        current = moved.select("s", "d")
        reach *= 2
        if reach > links_left or moved.where("m").limit(1).count() == 0:
            break
    else:
        raise RuntimeError(f"chains did not settle in {max_rounds} rounds")
    ends = current.join(current.select(F.col("s").alias("d")), "d", "left_anti")
    return ends.select(F.col("s").alias(src), F.col("d").alias(dst))
