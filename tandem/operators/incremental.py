"""Keeping tables current: snapshots with changes, inserts, upserts, limits, growth, sessions."""

from __future__ import annotations

import uuid
from collections import deque
from collections.abc import Iterator
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tandem.operators.distributed import global_position, one_per_key, previous_in_group, small_side, top_per_group
from tandem.session import cut_lineage, shared_dir

LATE_COMMITS = timedelta(minutes=5)   # changes that commit late are applied again, which does no harm
FULL_EVERY = timedelta(days=7)
KEEP_TOMBSTONES = timedelta(days=14)


# ---- snapshots --------------------------------------------------------------------------

def apply_changes(snapshot: DataFrame, changed: DataFrame, tombstones: DataFrame, since: datetime) -> DataFrame:
    """Snapshot after the changes since its watermark.

    ``changed``: the snapshot's columns, aprobado and modificado_en. Approved
    rows replace theirs, rows no longer approved and tombstones remove theirs.
    Of several changes of one id the last counts; changes of the same moment
    are told apart by a hash of the row, so the same one counts every time.
    """
    columns = snapshot.columns
    recent = changed.where(F.col("modificado_en") > F.lit(since)).select("aprobado", "modificado_en", *columns)
    latest = one_per_key(recent, ["id"], _micros("modificado_en"))
    dead = tombstones.where(F.col("borrado_en") > F.lit(since)).select("id")
    touched = recent.select("id").union(dead).distinct()
    fresh = latest.where("aprobado").join(dead.distinct(), "id", "left_anti").select(*columns)
    return snapshot.join(touched, "id", "left_anti").select(*columns).unionByName(fresh)


def next_watermark(now: datetime) -> datetime:
    return now - LATE_COMMITS


def needs_rebuild(
    spark, meta: dict | None, columns: list[str], now: datetime, snapshot_rows: int, base_rows: int
) -> DataFrame:
    """One row: rebuild from scratch or not, and why."""
    if meta is None:
        reason = "no snapshot"
    elif meta["columnas"] != ",".join(columns):
        reason = "columns differ"
    elif now - meta["completo_en"] > FULL_EVERY:
        reason = "last full snapshot is too old"
    elif snapshot_rows != base_rows:
        reason = "row counts differ"
    else:
        reason = ""
    return spark.createDataFrame([(reason != "", reason)], "completo boolean, motivo string")


def purge_tombstones(tombstones: DataFrame, now: datetime) -> DataFrame:
    return tombstones.where(F.col("borrado_en") >= F.lit(now - KEEP_TOMBSTONES))


# ---- inserts and upserts ----------------------------------------------------------------

def insert_new_chapters(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming chapters that are not there yet, by source and MD5 of the URL; of copies the lowest number counts.

    Rows that exist are never touched, so a chapter somebody hid stays hidden.
    """
    key = F.md5("url")
    known = existing.select("source_id", key.alias("url_md5")).distinct()
    new = incoming.withColumn("url_md5", key).join(known, ["source_id", "url_md5"], "left_anti")
    fresh = one_per_key(new, ["source_id", "url_md5"], F.coalesce("numero", F.lit(-1)), largest=False).select(*incoming.columns)
    return fresh if "aprobado" in fresh.columns else fresh.withColumn("aprobado", F.lit(True))


def keep_current_link(chapters: DataFrame, incoming: DataFrame, link_sources: DataFrame) -> DataFrame:
    """Link-out sources keep only the row of the URL seen last; other sources keep all rows."""
    seen = incoming.join(link_sources.select("source_id"), "source_id", "left_semi")
    current = seen.groupBy("source_id").agg(F.max_by("url", "visto_en").alias("_current"))
    marked = chapters.join(current, "source_id", "left")
    return marked.where(F.col("_current").isNull() | (F.col("url") == F.col("_current"))).drop("_current")


def upsert_works(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Works are inserted once, the first of a slug by ``orden``; what was edited later is kept. Missing lists become empty."""
    new = incoming.join(existing.select("slug"), "slug", "left_anti")
    fresh = one_per_key(new, ["slug"], F.col("orden"), largest=False).drop("orden")
    for field in existing.schema.fields:
        if field.name not in fresh.columns:
            fresh = fresh.withColumn(field.name, F.lit(None).cast(field.dataType))
        if field.dataType.typeName() == "array":
            fresh = fresh.withColumn(field.name, F.coalesce(field.name, F.array().cast(field.dataType)))
    return existing.unionByName(fresh.select(*existing.columns))


SOURCE_FIELDS = ["nombre", "url_listado", "idioma", "tipo", "plataforma", "portada_vista"]


def upsert_sources(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Sources by site and work: known ones get the new URL and description, id and switch stay.

    ``existing``: source_id, sitio_id, work_id, activa and the described fields.
    ``incoming``: sitio_id, work_id, orden and the described fields.
    """
    key = ["sitio_id", "work_id"]
    once = one_per_key(incoming, key, F.col("orden"), largest=False).select(*key, F.struct(*SOURCE_FIELDS).alias("n"))
    both = existing.join(once, key, "full_outer")
    new = F.col("n").isNotNull()
    described = [F.when(new, F.col(f"n.{c}")).otherwise(F.col(c)).alias(c) for c in SOURCE_FIELDS]
    return both.select(
        F.coalesce("source_id", F.xxhash64(*key)).alias("source_id"), *key,
        F.coalesce("activa", F.lit(True)).alias("activa"), *described,
    )


# ---- votes per day ----------------------------------------------------------------------

_DAY_US = 24 * 3600 * 1_000_000


def accept_in_order(stamps: list[int], limit: int, before: list[int] = ()) -> list[bool]:
    """Which of the ordered times (microseconds) are accepted, given times accepted earlier."""
    recent, out = list(before), []
    for now in stamps:
        recent = [t for t in recent if t > now - _DAY_US]
        ok = len(recent) < limit
        if ok:
            recent.append(now)
        out.append(ok)
    return out


def _micros(c: str) -> Column:
    return F.unix_micros(F.col(c).cast("timestamp"))


HOT_VOTES = 1 << 22  # votes of one run of days that one task decides in order


def rate_limit(votes: DataFrame, limit: int = 10, before: DataFrame | None = None, hot: int = HOT_VOTES) -> DataFrame:
    """Mark the votes that fit the limit of accepted votes in the trailing 24 hours per reader.

    Rejected votes do not count, so a reader's votes are decided in order of time, then id. ``before``: user_id,
    creada_en of votes accepted earlier; they stay accepted, and a late vote is judged by those of the 24 hours up to it.

    A day is calm when a reader has no more than ``limit`` votes in it and the day before together: all its votes fit.
    Only runs of other days are decided in order, each starting from the calm day before it, whose votes are all
    accepted. The runs of all readers are spread over all tasks, and a task remembers ``limit`` times of a run. A run of
    more than ``hot`` votes is too long for one task; such runs are decided day by day, all of them at once, after their
    votes have been thinned in parallel to those that can be accepted (``_thinned``). Both ways give the same answer.
    """
    stamped = votes.select("user_id", "id", _micros("creada_en").alias("_t"), F.lit(False).alias("_given"))
    if before is not None:
        given = before.select("user_id", F.lit(None).cast("bigint").alias("id"), _micros("creada_en").alias("_t"), F.lit(True).alias("_given"))
        stamped = stamped.unionByName(given)
    stamped = stamped.withColumn("_day", F.floor(F.col("_t") / _DAY_US).cast("bigint"))
    # one row per reader and day from here on
    days = stamped.groupBy("user_id", "_day").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy("user_id").orderBy("_day")
    yesterday = F.when(F.lag("_day").over(earlier) == F.col("_day") - 1, F.lag("_n").over(earlier)).otherwise(0)
    marked = days.withColumn("_busy", F.col("_n") + yesterday > limit)
    follows = F.lag("_busy").over(earlier) & (F.lag("_day").over(earlier) == F.col("_day") - 1)
    starts = F.col("_busy") & ~F.coalesce(follows, F.lit(False))
    # a calm day before a busy one belongs to the run as well: its votes still count there
    runs = marked.withColumn("_run", F.sum(starts.cast("int")).over(earlier.rowsBetween(Window.unboundedPreceding, 0)))
    leads = (F.lead("_day").over(earlier) == F.col("_day") + 1) & F.lead("_busy").over(earlier) & ~F.col("_busy")
    runs = runs.withColumn("_run", F.when(F.col("_busy"), F.col("_run")).when(leads, F.col("_run") + 1)).where("_run IS NOT NULL")
    size = F.sum("_n").over(Window.partitionBy("user_id", "_run"))
    runs = cut_lineage(runs.select("user_id", "_day", "_busy", "_run", (size > hot).alias("_hot")))
    inside = stamped.join(runs, ["user_id", "_day"]).select(
        *_RUN, "_day", "_t", "id", (F.col("_given") | ~F.col("_busy")).alias("_sure"), "_hot"
    )
    cool = inside.where("NOT _hot").withColumn("_recent", F.lit(None).cast("array<bigint>"))
    refused = _decided(cool, limit).where("NOT _ok").select("id")
    hot_days = [r[0] for r in runs.where("_hot").select("_day").distinct().orderBy("_day").collect()]  # a number a day
    if hot_days:
        refused = refused.unionByName(_refused_by_day(inside.where("_hot").drop("_hot"), hot_days, limit))
    refused = refused.withColumn("_refused", F.lit(True))
    return votes.join(refused, "id", "left").withColumn("aceptado", F.col("_refused").isNull()).drop("_refused")


_RUN = ["user_id", "_run"]


def _decided(rows: DataFrame, limit: int) -> DataFrame:
    """Votes of runs decided in order: user_id, _run, _t, id, _own, _ok. ``rows``: also _sure and, per run, the times accepted
    before. Votes without an id were accepted earlier and are not _own."""
    # accepted earlier comes first among equal times
    ordered = rows.repartition(*_RUN).sortWithinPartitions(*_RUN, "_t", F.desc("_sure"), "id")
    kind = rows.schema["user_id"].dataType.simpleString()
    whole = F.coalesce("id", F.lit(0)).alias("id")  # a null would make the ids of a batch floating-point numbers
    return ordered.select(*_RUN, "_t", whole, F.col("id").isNotNull().alias("_own"), "_sure", "_recent").mapInPandas(
        _decide(limit), f"user_id {kind}, _run bigint, _t bigint, id bigint, _own boolean, _ok boolean"
    )


def _decide(limit: int):
    """Whether each vote fits, from rows sorted by run and time."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_, recent = None, deque()
        for frame in frames:
            out = []
            for user, number, now, sure, given in zip(
                *(frame[c].tolist() for c in ("user_id", "_run", "_t", "_sure", "_recent"))
            ):
                if (user, number) != open_:
                    open_ = (user, number)
                    recent = deque(sorted(given) if given is not None else ())
                while recent and recent[0] <= now - _DAY_US:
                    recent.popleft()
                ok = sure or len(recent) < limit
                if ok:
                    recent.append(now)
                out.append(ok)
            yield frame[[*_RUN, "_t", "id", "_own"]].assign(_ok=out)

    return run


def _thinned(votes: DataFrame, limit: int) -> DataFrame:
    """The votes of a day that can be accepted, and those that are. ``votes``: also _recent, the times accepted the day before.

    Room comes free only 24 hours after a vote of the day before was accepted. Between two such moments votes are accepted until the limit
    is reached and then no more, so no more than the first ``limit`` of a stretch between them can be. They are picked by
    salted slices: a reader with very many votes is thinned by many tasks.
    """
    stretch = F.size(F.filter("_recent", lambda r: r <= F.col("_t") - _DAY_US))
    open_ = votes.where("NOT _sure").withColumn("_stretch", stretch)
    first = top_per_group(open_, [*_RUN, "_stretch"], [F.col("_t"), F.col("id")], limit, name="_place")
    return first.select(*votes.columns).unionByName(votes.where("_sure"))


def _refused_by_day(rows: DataFrame, days: list[int], limit: int) -> DataFrame:
    """Ids of the votes of very long runs that do not fit: a day of all runs at a time."""
    spark, folder = rows.sparkSession, f"{shared_dir(rows.sparkSession)}/hot-votes-{uuid.uuid4().hex}"
    rows.write.partitionBy("_day").parquet(folder)
    stored = spark.read.schema(rows.schema).parquet(folder)
    accepted, all_accepted = None, None
    for day in days:
        votes = stored.where(F.col("_day") == day)
        if accepted is None:
            votes = votes.withColumn("_recent", F.array().cast("array<bigint>"))
        else:
            # what was accepted the day before: no more than the limit, but for votes that were given
            state = accepted.groupBy(*_RUN).agg(F.collect_list("_t").alias("_recent"))
            votes = votes.join(small_side(state), _RUN, "left").withColumn(
                "_recent", F.coalesce("_recent", F.array().cast("array<bigint>"))
            )
        accepted = cut_lineage(_decided(_thinned(votes, limit), limit).where("_ok"))
        own = accepted.where("_own").select("id")
        all_accepted = own if all_accepted is None else all_accepted.unionByName(own)
    return stored.where("id IS NOT NULL").select("id").join(all_accepted, "id", "left_anti")


def trailing_votes(votes: DataFrame) -> DataFrame:
    """Votes of the same reader in the 24 hours up to each vote.

    Every vote asks twice how many votes lie before a moment: 24 hours ago and
    now. Questions and votes are put in one global order with a running count,
    so a reader with very many votes spans many tasks.
    """
    t = _micros("creada_en")
    asked = F.array(
        F.struct((t - _DAY_US).alias("at"), F.lit(0).alias("kind")),  # before the votes of that moment
        F.struct(t.alias("at"), F.lit(1).alias("kind")),  # the vote
        F.struct(t.alias("at"), F.lit(2).alias("kind")),  # after the votes of that moment
    )
    points = votes.select("user_id", "id", F.explode(asked).alias("p")).select("user_id", "id", "p.at", "p.kind")
    order = [F.col("user_id"), F.col("at"), F.col("kind"), F.col("id")]
    counted = global_position(points, order, "_pos", running={"_upto": (F.col("kind") == 1).cast("int")})
    low, high = (F.max(F.when(F.col("kind") == k, F.col("_upto"))) for k in (0, 2))
    return counted.groupBy("id").agg((high - low).alias("n"))


# ---- growth of sources ------------------------------------------------------------------

def growth(visits: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """State of each source after a log of visits: n_caps, ultimo_cambio, ultimo_scrape.

    ``visits``: source_id, cuando, ok, encontrados. ``known``: the state before.
    A visit that failed counts as a visit only. A source changed when a visit
    found more than the one before.
    """
    good = visits.where("ok").select("source_id", "cuando", "encontrados")
    once = good.groupBy("source_id", "cuando").agg(F.max("encontrados").alias("encontrados"))
    compared = previous_in_group(once, ["source_id"], [F.col("cuando")], "encontrados", "antes")
    seen = visits.groupBy("source_id").agg(F.max("cuando").alias("ultimo_scrape"))
    if known is None:
        before = seen.select("source_id", F.lit(0).cast("bigint").alias("_n"), F.lit(None).cast("timestamp").alias("_c"),
                             F.lit(None).cast("timestamp").alias("_s"))
    else:
        before = known.select("source_id", F.col("n_caps").alias("_n"), F.col("ultimo_cambio").alias("_c"),
                              F.col("ultimo_scrape").alias("_s"))
    judged = compared.join(before, "source_id", "left")
    grew = F.col("encontrados") > F.coalesce("antes", "_n", F.lit(0))
    state = judged.groupBy("source_id").agg(
        F.max_by("encontrados", "cuando").alias("n_caps"), F.max(F.when(grew, F.col("cuando"))).alias("ultimo_cambio")
    )
    joined = seen.join(state, "source_id", "left").join(before, "source_id", "full_outer" if known is not None else "left")
    kept_n = F.col("n_caps") if known is None else F.coalesce("n_caps", "_n")
    return joined.select(
        "source_id", F.coalesce("ultimo_scrape", "_s").alias("ultimo_scrape"), kept_n.alias("n_caps"),
        F.coalesce("ultimo_cambio", "_c").alias("ultimo_cambio"),
    )


# ---- activity and sessions --------------------------------------------------------------

def activity_windows(changes: DataFrame, size: str = "1 day", slide: str | None = None) -> DataFrame:
    """Changes per work in tumbling or sliding windows. ``changes``: work_id, visto_en."""
    at = F.window("visto_en", size, slide) if slide else F.window("visto_en", size)
    return changes.groupBy(at.alias("w"), "work_id").agg(
        F.count("*").alias("n"), F.max("visto_en").alias("ultimo")
    ).select("work_id", F.col("w.start").alias("desde"), F.col("w.end").alias("hasta"), "n", "ultimo")


def reading_sessions(progress: DataFrame, gap_seconds: int = 1800) -> DataFrame:
    """Sessions per reader: runs of reading without a pause longer than the gap.

    First sessions inside each (reader, hour), which splits a reader with very
    many rows; then those pieces, a few per hour, are joined across hours by a
    window whose gap reaches from the start of a piece past its end.
    """
    timed = progress.withColumn("_at", F.col("ts").cast("timestamp"))
    gap = f"{gap_seconds} seconds"
    pieces = timed.groupBy("user_id", F.date_trunc("hour", "_at").alias("_h"), F.session_window("_at", gap).alias("w")).agg(
        F.count("*").alias("n"), F.max("_at").alias("last"), F.collect_set("capitulo").alias("caps")
    ).select("user_id", F.col("w.start").alias("start"), "last", "n", "caps")
    reach = F.unix_micros("last") - F.unix_micros("start") + gap_seconds * 1_000_000
    reach_text = F.concat(reach.cast("string"), F.lit(" microseconds"))
    return pieces.groupBy("user_id", F.session_window("start", reach_text).alias("w")).agg(
        F.sum("n").alias("n"), F.max("last").alias("ultima"), F.array_distinct(F.flatten(F.collect_list("caps"))).alias("capitulos")
    ).select("user_id", F.col("w.start").alias("inicio"), "ultima", "n", F.array_sort("capitulos").alias("capitulos"))


def read_sets(progress: DataFrame) -> DataFrame:
    """Everything a reader has read of a work; chapter numbers bound the list."""
    return progress.groupBy("user_id", "work_id").agg(
        F.array_sort(F.collect_set("capitulo")).alias("capitulos"), F.bool_or("favorito").alias("favorito")
    )

