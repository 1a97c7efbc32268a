"""Robots rules: which crawled URLs may be fetched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tandem.functions.text import trim_ws
from tandem.functions.urls import origin_of, path_of


def disallowed_prefixes(robots_txt: Column, agent: str) -> Column:
    """Path prefixes one file forbids to ``agent`` (or to everybody), read line by line."""
    lines = F.transform(F.split(robots_txt, "\n"), lambda x: F.split_part(x, F.lit("#"), F.lit(1)))

    def step(state: Column, line: Column) -> Column:
        key = F.lower(trim_ws(F.split_part(line, F.lit(":"), F.lit(1))))
        value = trim_ws(F.regexp_replace(line, "^[^:]*:?", ""))
        ours = (value == "*") | F.startswith(F.lit(agent.lower()), F.lower(value))
        applies = F.when(key == "user-agent", ours).otherwise(state["applies"])
        rule = (key == "disallow") & state["applies"] & (value != "")
        rules = F.when(rule, F.array_append(state["rules"], value)).otherwise(state["rules"])
        return F.struct(applies.alias("applies"), rules.alias("rules"))

    start = F.struct(F.lit(False).alias("applies"), F.array().cast("array<string>").alias("rules"))
    return F.aggregate(lines, start, step, lambda s: s["rules"])


def robots_filter(urls: DataFrame, robots: DataFrame, agent: str) -> DataFrame:
    """URLs whose path no rule of their origin forbids; an origin without a file allows all.

    ``robots``: origen, robots_txt (one file per origin). The rules of a file
    travel as one array, so the join is one row per URL.
    """
    rules = robots.select(F.lower("origen").alias("_o"), disallowed_prefixes(F.col("robots_txt"), agent).alias("_r"))
    joined = urls.join(rules, origin_of("url") == F.col("_o"), "left").withColumn("_p", path_of("url"))
    # the prefixes that fit a path are prefixes of it; compare them without a second table
    hit = F.exists("_r", lambda r: F.startswith(F.col("_p"), r))
    return joined.where(~F.coalesce(hit, F.lit(False))).drop("_o", "_r", "_p")
