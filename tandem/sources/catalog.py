"""Reading the catalogue: tables, JSON snapshots, stored snapshots, ledgers."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tandem.functions.urls import decode
from tandem.operators.distributed import global_position

CHAPTER_COLUMNS = ["id", "work_id", "source_id", "numero", "titulo", "url", "idioma", "tipo"]


def read_chapters(spark: SparkSession, path: str, columns: list[str] = CHAPTER_COLUMNS) -> DataFrame:
    """Approved chapters; the filter and the columns reach the Parquet scan."""
    return visible_chapters(spark.read.parquet(path), columns)


def visible_chapters(chapters: DataFrame, columns: list[str] = CHAPTER_COLUMNS) -> DataFrame:
    return chapters.where("aprobado").select(*columns)


def read_works(spark: SparkSession, path: str) -> DataFrame:
    return visible_works(spark.read.parquet(path))


def visible_works(works: DataFrame) -> DataFrame:
    return works.where("publicada")


def read_table_jdbc(
    spark: SparkSession, url: str, table: str, key: str, low: int, high: int, parts: int, where: str = "1 = 1", **options
) -> DataFrame:
    """A database table in parallel ranges of its key, in place of paging through it."""
    return (
        spark.read.format("jdbc")
        .options(url=url, dbtable=f"(SELECT * FROM {table} WHERE {where}) t", partitionColumn=key,
                 lowerBound=str(low), upperBound=str(high), numPartitions=str(parts), **options)
        .load()
    )


SNAPSHOT_SCHEMA = "hasta string, completoEn string, cols array<string>, filas array<array<string>>"


def decode_snapshot(raw: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of JSON files that hold column names once and then arrays of values.

    ``raw``: value (one file or file part per row). Result: hasta and the named columns as text.
    """
    parsed = raw.select(F.from_json("value", SNAPSHOT_SCHEMA).alias("s")).where("s IS NOT NULL")
    return _named(parsed.select(F.col("s.hasta").alias("hasta"), F.col("s.cols").alias("cols"), F.explode("s.filas").alias("fila")), columns)


def _named(rows: DataFrame, columns: list[str]) -> DataFrame:
    def named(column: str):
        return F.try_element_at("fila", F.array_position("cols", column).cast("int"))

    return rows.select("hasta", *[F.when(F.array_contains("cols", c), named(c)).alias(c) for c in columns])


def json_pieces(spark: SparkSession, path: str, between: str, opens: str = "") -> DataFrame:
    """The elements of large JSON files, cut where ``between`` stands: file, value. Spark reads byte ranges of a file in parallel.

    The files are written without white space between their parts. ``opens`` is the end of ``between`` that belongs to
    the next element. Where ``between`` stands inside a string, the piece before it has an odd number of quotes; such
    pieces are put together again in the order of the file.
    """
    reader = spark.read.option("lineSep", between)
    raw = reader.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_at"))
    whole = F.when(F.col("value").startswith("{"), F.col("value")).otherwise(F.concat(F.lit(opens), "value"))
    quotes = F.length(F.regexp_replace(F.regexp_replace("value", r"\\.", ""), '[^"]', ""))
    pieces = raw.withColumn("value", whole).withColumn("_odd", (quotes % 2).cast("int"))
    if pieces.where("_odd = 1").limit(1).count() == 0:
        return pieces.select("file", "value")
    ordered = pieces.withColumn("_row", F.monotonically_increasing_id())  # within a byte range in the order of the file
    placed = global_position(ordered, [F.col("file"), F.col("_at"), F.col("_row")], "_pos", running={"_open": F.col("_odd")})
    broken = (F.col("_odd") == 1) | (F.col("_open") % 2 == 1)
    joint = between[: len(between) - len(opens)]
    parts = F.array_sort(F.collect_list(F.struct("_pos", "value")))
    mended = placed.where(broken).groupBy("file", F.floor((F.col("_open") + 1) / 2).alias("_k")).agg(
        F.array_join(F.transform(parts, lambda p: p["value"]), joint).alias("value")  # the pieces of one element
    )
    return placed.where(~broken).select("file", "value").unionByName(mended.select("file", "value"))


_HEAD = r'^(\{.*?)"filas":\['


def snapshot_rows(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """``decode_snapshot`` of files of any size, each a single JSON document: many tasks read one file."""
    pieces = json_pieces(spark, path, "],[")
    first = F.col("value").startswith("{")
    head = F.from_json(F.concat(F.regexp_extract("value", _HEAD, 1), F.lit('"filas":[]}')), "hasta string, cols array<string>")
    heads = pieces.where(first).select("file", head.alias("h")).select("file", "h.*")  # a row per file
    body = F.when(first, F.regexp_replace("value", r'^\{.*?"filas":\[\[?', "")).otherwise(F.col("value"))
    cells = F.from_json(F.concat(F.lit("["), F.regexp_replace(body, r"\]?\]\}\s*$", ""), F.lit("]")), "array<string>")
    rows = pieces.select("file", cells.alias("fila")).where(F.size("fila") > 0)
    return _named(rows.join(heads, "file"), columns)


def translation_rows(spark: SparkSession, path: str) -> DataFrame:
    """``read_translation_cache`` of files of any size, each a single JSON document."""
    pieces = json_pieces(spark, path, '},"', '"')
    entry = F.regexp_replace(F.regexp_replace("value", r"^\{", ""), r"\}?\}\s*$", "")
    parsed = pieces.select(entry.alias("e")).where("e <> ''").select(F.concat(F.lit("{"), "e", F.lit("}}")).alias("value"))
    return read_translation_cache(parsed)


def snapshot_age(raw: DataFrame, now: datetime) -> timedelta | None:
    """Age of the newest watermark; None when no file can be read."""
    newest = raw.select(F.max(F.get_json_object("value", "$.hasta").try_cast("timestamp"))).first()[0]
    return None if newest is None else now - newest


def read_snapshot(
    raw: DataFrame, columns: list[str], now: datetime, fallback: DataFrame, max_age: timedelta = timedelta(days=3)
) -> DataFrame:
    """Snapshot rows when it is fresh enough, else the base table."""
    age = snapshot_age(raw, now)
    if age is None or age > max_age:
        return fallback.select(*[F.col(c).cast("string").alias(c) for c in columns])
    return decode_snapshot(raw, columns).drop("hasta")


def latest_snapshot(spark: SparkSession, path: str) -> tuple[DataFrame, dict] | None:
    """Rows and meta of the newest complete version under ``path``; None when there is none."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    root = hadoop.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return None
    names = sorted((str(s.getPath().getName()) for s in fs.listStatus(root)), reverse=True)
    for name in names:
        if fs.exists(hadoop.Path(f"{path}/{name}/meta/_SUCCESS")):
            meta = spark.read.parquet(f"{path}/{name}/meta").first().asDict()
            return spark.read.parquet(f"{path}/{name}/rows"), meta
    return None


def traffic_slugs(lines: DataFrame) -> DataFrame:
    """Slugs of visited works in exported CSV lines: the URL is the first field."""
    first = F.split_part(F.col("value"), F.lit(","), F.lit(1))
    slug = F.regexp_extract(first, '/novela/([^/?#,"]+)', 1)
    return lines.select(decode(slug).alias("slug")).where("slug <> ''").distinct()


def read_traffic_csv(spark: SparkSession, paths: list[str] | str, previous: DataFrame) -> DataFrame:
    return merge_traffic(spark.read.text(paths), previous)


def merge_traffic(lines: DataFrame, previous: DataFrame) -> DataFrame:
    """Visited works: the set only ever grows."""
    return traffic_slugs(lines).union(previous.select("slug")).distinct()


def read_translation_cache(raw: DataFrame) -> DataFrame:
    """Cache files ``{hash: {lang: text}}`` as a tall table, one row per hash and language."""
    parsed = raw.select(F.explode(F.from_json("value", "map<string,map<string,string>>")).alias("hash", "por_idioma"))
    return parsed.select("hash", F.explode("por_idioma").alias("idioma", "texto"))


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """Slugs already exported, one per line."""
    return ledger_slugs(spark.read.text(path))


def ledger_slugs(lines: DataFrame) -> DataFrame:
    return lines.where("value <> ''").select(F.col("value").alias("slug")).distinct()
