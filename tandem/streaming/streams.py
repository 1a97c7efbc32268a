"""Structured Streaming forms of the incremental operators.

Each builder takes and returns a streaming DataFrame (or starts a query that
writes to a folder); the batch operator of the same name gives the same result
on the same rows. Event times must be TIMESTAMP.
"""

from __future__ import annotations

import uuid
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from tandem.operators.incremental import activity_windows
from tandem.operators.votes import PAIR, most_voted
from tandem.session import shared_dir
from tandem.streaming.keyed_state import KeptTable, keep, run


def table_stream(spark: SparkSession, folder: str, name: str, files_per_batch: int = 200) -> DataFrame:
    """A folder of Parquet files as a stream; the schema is that of the files that are there."""
    schema = spark.read.parquet(f"{folder}/{name}").schema
    return (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", name)
        .parquet(folder)
    )


def folder_stream(spark: SparkSession, path: str, files_per_batch: int = 200) -> DataFrame:
    """A folder that is a Parquet table as a stream, oldest files first."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def run_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/run-{uuid.uuid4().hex}"


def store(stream: DataFrame, folder: str, mode: str = "append") -> None:
    """Everything available now, written to ``folder``/rows."""
    run(stream, folder, mode, "parquet", path=f"{folder}/rows")


# ---- activity, sessions -----------------------------------------------------------------

def activity_stream(changes: DataFrame, late: str = "1 day", size: str = "1 day", slide: str | None = None) -> DataFrame:
    """Windows of changes per work; a window comes out once no more rows are awaited, later rows are dropped."""
    return activity_windows(changes.withWatermark("visto_en", late), size, slide)


def session_stream(progress: DataFrame, late: str = "1 hour", gap: str = "30 minutes") -> DataFrame:
    """Reading sessions that have ended, with the chapters read. ``progress``: user_id, ts, capitulo."""
    sessions = progress.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w"))
    read = F.array_sort(F.collect_set("capitulo")).alias("capitulos")
    return sessions.agg(F.count("*").alias("n"), F.max("ts").alias("ultima"), read).select(
        "user_id", F.col("w.start").alias("inicio"), "ultima", "n", "capitulos"
    )


# ---- chapters ---------------------------------------------------------------------------

def new_chapters_stream(chapters: DataFrame, late: str = "7 days") -> DataFrame:
    """First arrival of each chapter (source, MD5 of URL) within the watermark."""
    keyed = chapters.withColumn("url_md5", F.md5("url")).withWatermark("visto_en", late)
    return keyed.dropDuplicatesWithinWatermark(["source_id", "url_md5"])


def insert_chapters(chapters: DataFrame, folder: str) -> KeptTable:
    """Chapters kept by source and MD5 of the URL. A chapter that is there is never touched: the earliest batch counts,
    within it the row seen first."""
    keyed = chapters.withColumn("url_md5", F.md5("url"))
    # the time of the batch, the same when it runs again
    arrived = keyed.withColumn("_lote", F.current_timestamp())
    return keep(arrived, folder, ["source_id", "url_md5"], [F.col("_lote"), F.col("visto_en")], keyed.columns, first=True)


# ---- tables kept by key -----------------------------------------------------------------

class Snapshot(KeptTable):
    """A snapshot kept by id: approved rows that are not deleted."""

    def read(self) -> DataFrame:
        return super().read().where("aprobado AND NOT borrado").drop("aprobado", "borrado", "modificado_en")


def apply_changes_stream(changes: DataFrame, folder: str, columns: list[str]) -> Snapshot:
    """A stream of changed rows (borrado marks tombstones) kept as a table by id.

    Of the changes of an id the latest by modificado_en counts, whenever it arrives; of the same moment a tombstone
    before a change. A deleted row leaves its id and the time, so that an older change cannot bring it back.
    """
    order = [F.col("modificado_en"), F.col("borrado")]
    kept = [*columns, "aprobado", "borrado", "modificado_en"]
    rows = changes.select(*kept)
    gone = F.col("borrado") | ~F.col("aprobado")
    slim = [F.when(~gone, F.col(c)).alias(c) if c not in ("id", *kept[-3:]) else F.col(c) for c in kept]
    table = keep(rows.select(*slim), folder, ["id"], order, kept)
    return Snapshot(table.spark, table.folder, table.schema)


def latest_votes_stream(votes: DataFrame, folder: str) -> KeptTable:
    """One vote per work, chapter and reader, the last one.

    ``votes``: id, work_id, capitulo_manhwa, user_id, capitulo_novela, creada_en.
    """
    columns = ["id", *PAIR, "user_id", "capitulo_novela", "creada_en"]
    return keep(votes.select(*columns), folder, [*PAIR, "user_id"], [F.col("creada_en"), F.col("id")], columns)


# ---- counts that follow changes ---------------------------------------------------------

_VOTE = "capitulo_novela int, creada bigint, id bigint"
_MOVE = "work_id bigint, capitulo_manhwa int, capitulo_novela int, paso int"


_SLOTS = 1024  # groups that votes are dealt into, so that one call in Python serves the votes of many readers


class _Moves(StatefulProcessor):
    """The votes of a slot, one per work, chapter and reader. A later vote takes one from what it said before and gives one to
    what it says now; a withdrawn vote only takes. The withdrawal is kept with its time, so an older vote cannot come back.
    A batch reads and writes the votes that it touches, whatever else the slot holds."""

    def __init__(self, key: T.StructType):
        self.key = key

    def init(self, handle) -> None:
        self.votes = handle.getMapState("votes", self.key, _VOTE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            latest: dict[tuple, tuple] = {}
            voters, at = [frame[c].tolist() for c in self.key.names], _micros(frame["creada_en"]).tolist()
            values = zip(*voters, at, frame["id"].tolist(), frame["capitulo_novela"].tolist(), frame["borrado"].tolist())
            for *voter, t, i, chapter, out in values:
                voter = tuple(voter)
                if voter not in latest or (t, i) >= latest[voter][1:]:
                    latest[voter] = (None if out else int(chapter), t, i)
            moves = []
            for voter, now in latest.items():
                known = self.votes.getValue(voter)
                if known is not None and now[1:] < (known[1], known[2]):
                    continue
                before = None if known is None else known[0]
                if known is None or now != tuple(known):
                    self.votes.updateValue(voter, now)
                if before != now[0]:
                    moves += [(*voter[:2], c, step) for c, step in ((before, -1), (now[0], 1)) if c is not None]
            yield pd.DataFrame(moves, columns=[*PAIR, "capitulo_novela", "paso"])

    def close(self) -> None:
        pass


class Consensus:
    """Counted votes kept up to date, and the consensus that they give."""

    def __init__(self, spark: SparkSession, folder: str):
        schema = T._parse_datatype_string("work_id bigint, capitulo_manhwa int, capitulo_novela int, n bigint")
        self.spark, self.folder, self.schema = spark, folder, schema

    def counts(self) -> DataFrame:
        return KeptTable(self.spark, f"{self.folder}/counts", self.schema).read().where("n > 0")

    def read(self) -> DataFrame:
        return most_voted(self.counts())


def consensus_stream(changes: DataFrame, folder: str) -> Consensus:
    """Consensus from a stream of votes, changed votes and withdrawn ones (borrado), none of which is counted twice.

    ``changes``: id, work_id, capitulo_manhwa, user_id, capitulo_novela, creada_en, borrado. The latest row of a reader and
    chapter counts, by time, then id, whenever it arrives. What a batch changes are moves of single votes, written to
    ``folder``/moves/rows; a second stream adds them up, so a batch costs as much as its rows.
    """
    votes = changes.where("work_id IS NOT NULL AND capitulo_manhwa IS NOT NULL AND user_id IS NOT NULL AND creada_en IS NOT NULL")
    votes = votes.select(
        F.col("work_id").cast("bigint").alias("work_id"), F.col("capitulo_manhwa").cast("int").alias("capitulo_manhwa"), "user_id", "id",
        F.coalesce("capitulo_novela", F.lit(0)).cast("int").alias("capitulo_novela"), "creada_en",
        (F.coalesce("borrado", F.lit(False)) | F.col("capitulo_novela").isNull()).alias("borrado"),
    )
    voter = [*PAIR, "user_id"]
    dealt = votes.withColumn("_slot", F.pmod(F.xxhash64(*voter), F.lit(_SLOTS)))
    processor = _Moves(T.StructType([votes.schema[c] for c in voter]))
    moves = dealt.groupBy("_slot").transformWithStateInPandas(processor, _MOVE, "Append", "None")
    store(moves, f"{folder}/moves")
    spark = changes.sparkSession
    written = spark.readStream.schema(_MOVE).option("maxFilesPerTrigger", 10_000).parquet(f"{folder}/moves/rows")
    counted = written.groupBy(*PAIR, "capitulo_novela").agg(F.sum("paso").alias("n"))
    run(counted, f"{folder}/counts", "update")
    return Consensus(spark, folder)


# ---- state that follows an order --------------------------------------------------------

_GROWTH = "n_caps bigint, cambio bigint, visita bigint"


def _micros(times: pd.Series) -> np.ndarray:
    return times.to_numpy().astype("datetime64[us]").astype(np.int64)


class _Growth(StatefulProcessor):
    """State of a source after its visits, batch by batch; visits of a batch count in order of time."""

    def init(self, handle) -> None:
        self.state = handle.getValueState("state", _GROWTH)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        known, change, last = self.state.get() if self.state.exists() else (None, None, None)
        found: dict[int, int] = {}
        for frame in rows:
            at = _micros(frame["cuando"])
            last = max(int(at.max()), last) if last is not None else int(at.max())
            good = frame["ok"].to_numpy(bool)
            for t, n in zip(at[good].tolist(), frame["encontrados"].to_numpy()[good].tolist()):
                found[t] = max(n, found.get(t, n))
        for t in sorted(found):
            if found[t] > (known or 0):
                change = max(t, change or t)
            known = found[t]
        self.state.update((known, change, last))
        yield pd.DataFrame({"source_id": [key[0]]})

    def close(self) -> None:
        pass


class Growth(KeptTable):
    """State of every source: ultimo_scrape, n_caps, ultimo_cambio."""

    def read(self) -> DataFrame:
        return super().read().select(
            "source_id", F.timestamp_micros("visita").alias("ultimo_scrape"), "n_caps", F.timestamp_micros("cambio").alias("ultimo_cambio")
        )


def growth_stream(visits: DataFrame, folder: str) -> Growth:
    """State of every source after each batch of visits, in the state of the stream."""
    followed = visits.select("source_id", "cuando", F.coalesce("ok", F.lit(False)).alias("ok"), "encontrados").where("cuando IS NOT NULL")
    kind = visits.schema["source_id"]
    out = followed.groupBy("source_id").transformWithStateInPandas(_Growth(), T.StructType([kind]), "Update", "None")
    run(out, folder, "update")
    return Growth(visits.sparkSession, folder, T.StructType([kind, *T._parse_datatype_string(_GROWTH).fields]), "state")


_DAY_US = 24 * 3600 * 1_000_000


class _VoteLimit(StatefulProcessor):
    """Accepted times of a reader, as far back as a vote may still ask for them."""

    def __init__(self, limit: int):
        self.limit = limit

    def init(self, handle) -> None:
        self.handle = handle
        self.accepted = handle.getListState("accepted", "t bigint")

    def _keep(self, accepted: list[int], now_ms: int) -> None:
        """Forget times that no vote within the watermark can ask for; look again when the last one is that old."""
        accepted = [t for t in accepted if t > now_ms * 1000 - _DAY_US]
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if accepted:
            self.accepted.put([(t,) for t in accepted])
            self.handle.registerTimer((accepted[-1] + _DAY_US) // 1000 + 1)
        else:
            self.accepted.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        votes = pd.concat(list(rows), ignore_index=True)
        at = _micros(votes["creada_en"])
        accepted = sorted(r[0] for r in self.accepted.get())
        fits = np.zeros(len(votes), bool)
        for i in np.lexsort((votes["id"].to_numpy(), at)).tolist():
            t = int(at[i])
            if bisect_right(accepted, t) - bisect_right(accepted, t - _DAY_US) < self.limit:
                fits[i] = True
                insort(accepted, t)
        self._keep(accepted, timerValues.getCurrentWatermarkInMs())
        yield votes[fits]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._keep(sorted(r[0] for r in self.accepted.get()), timerValues.getCurrentWatermarkInMs())
        yield from ()

    def close(self) -> None:
        pass


def rate_limit_stream(votes: DataFrame, folder: str, limit: int = 10, late: str = "7 days") -> None:
    """Accepted votes in ``folder``/rows, batch by batch.

    The accepted times of a reader are the state; a timer clears them a day after the watermark has passed the last one.
    Votes of a batch are decided in order of time, then id; a vote that comes late, by up to ``late``, is judged by the
    accepted votes of the 24 hours before it, and those accepted since stay accepted. Later ones are dropped.
    ``votes``: user_id, id, creada_en and more.
    """
    timed = votes.where("user_id IS NOT NULL AND creada_en IS NOT NULL").withWatermark("creada_en", late)
    out = timed.groupBy("user_id").transformWithStateInPandas(_VoteLimit(limit), votes.schema, "Append", "EventTime")
    store(out, folder)
