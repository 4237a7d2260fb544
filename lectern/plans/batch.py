"""Batch drivers: which days and languages, and what became of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import dims
from lectern.functions.rx import strip, text_or_empty


def days_of_months(months: DataFrame, today: Column) -> DataFrame:
    """months(year, month) with ``date``: every day of a month up to today; no rows of one that begins later."""
    first = F.make_date("year", "month", F.lit(1))
    last = F.least(F.last_day(first), today)
    days = F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<date>"))
    return months.select(*months.columns, F.explode(days).alias("date"))


def days_of_month(spark: SparkSession, year: int, month: int, today: str) -> DataFrame:
    """date: every day of a month up to today; none if it begins later."""
    one = spark.range(1).select(F.lit(year).alias("year"), F.lit(month).alias("month"))
    return days_of_months(one, F.to_date(F.lit(today))).select("date")


def grid(dates: DataFrame, langs: list[str] | None = None) -> DataFrame:
    """dates with lang_pos and lang: every row once for each language, in the order in which they are published."""
    return dates.select(*dates.columns, F.posexplode(F.array(*map(F.lit, langs or dims.PUBLISH_ORDER))).alias("lang_pos", "lang"))


def parsed_languages(value: Column) -> dict[str, Column]:
    """langs and unknown (arrays) of a comma list, or all languages for ``all``; order and repeats stay."""
    known = F.array(*map(F.lit, sorted(dims.LANGUAGES)))
    parts = F.filter(F.transform(F.split(text_or_empty(value), ","), lambda x: F.lower(strip(x))), lambda x: x != "")
    langs = F.when(F.lower(value) == "all", known).otherwise(parts)
    return {"langs": langs, "unknown": F.filter(langs, lambda x: ~F.array_contains(known, x))}


def status_rollup(runs: DataFrame, by: list[str]) -> DataFrame:
    """by, n_ok, n_skip, n_fail of runs(status) by the status's beginning."""
    n = lambda x: F.count_if(F.col("status").startswith(x))
    return runs.groupBy(*by).agg(n("OK").alias("n_ok"), n("SKIP").alias("n_skip"), n("FAIL").alias("n_fail"))


def overall_status(codes: DataFrame, by: list[str]) -> DataFrame:
    """by, status: 200 if all codes are, else 207; 200 if there are none."""
    every = F.coalesce(F.bool_and(F.col("code") == 200), F.lit(True))
    return codes.groupBy(*by).agg(F.when(every, 200).otherwise(207).alias("status"))


def local_copy_name(day: Column, lang: Column, title: Column) -> Column:
    from lectern.functions.text import slug

    return F.concat(F.date_format(day, "yyyyMMdd"), F.lit("_"), lang, F.lit("_"), slug(title, 60, "episode"), F.lit(".mp3"))
