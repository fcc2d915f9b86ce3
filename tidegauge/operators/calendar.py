"""Calendar features and effects."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import safe_div
from .series import KEY, valid, val



def easter(year: Column) -> Column:
    """Gregorian Easter Sunday, by the anonymous algorithm on whole numbers."""
    div = lambda a, b: F.floor(a / b).cast("int")
    mod = lambda a, b: F.pmod(a, F.lit(b)).cast("int")
    golden, century = mod(year, 19), div(year, 100)
    rest = mod(year, 100)
    moon = mod(19 * golden + century - div(century, 4) - div(century - div(century + 8, 25) + 1, 3) + 15, 30)
    days = mod(32 + 2 * mod(century, 4) + 2 * div(rest, 4) - moon - mod(rest, 4), 7)
    fix = div(golden + 11 * moon + 22 * days, 451)
    total = moon + days - 7 * fix + 114
    return F.make_date(year, div(total, 31), mod(total, 31) + 1)


def thanksgiving(year: Column) -> Column:
    """The fourth Thursday of November."""
    return F.date_add(F.next_day(F.make_date(year, F.lit(10), F.lit(31)), "Thu"), 21)


def is_leap_year(year: Column) -> Column:
    return ((year % 4 == 0) & (year % 100 != 0)) | (year % 400 == 0)


def days_in_month(day: Column) -> Column:
    return F.dayofmonth(F.last_day(day))


def is_working_day(day: Column) -> Column:
    return F.weekday(day) < 5


def working_days_in_month(day: Column) -> Column:
    d = day.cast("date")
    return F.size(F.filter(F.sequence(F.trunc(d, "month"), F.last_day(d), F.expr("interval 1 day")), lambda x: F.weekday(x) < 5))


def is_fixed_holiday(day: Column) -> Column:
    """New Year and Christmas."""
    return ((F.month(day) == 1) & (F.dayofmonth(day) == 1)) | ((F.month(day) == 12) & (F.dayofmonth(day) == 25))


def calendar_features(df: DataFrame, ts: str = "ts") -> DataFrame:
    t = F.col(ts)
    cyc = lambda c, n: (F.sin(2 * math.pi * c / n), F.cos(2 * math.pi * c / n))
    out = {"dow": F.weekday(t), "month": F.month(t), "quarter": F.quarter(t), "year": F.year(t), "day_of_year": F.dayofyear(t), "iso_week": F.weekofyear(t), "hour": F.hour(t), "is_weekend": F.weekday(t) >= 5, "is_holiday": is_fixed_holiday(t)}
    for name, c, n in (("dow", F.weekday(t), 7), ("month", F.month(t) - 1, 12), ("hour", F.hour(t), 24)):
        out[f"{name}_sin"], out[f"{name}_cos"] = cyc(c, n)
    return df.withColumns(out)


def _effect(series: DataFrame, slot: Column, name: str) -> DataFrame:
    """Mean of each slot less the series' mean, with a t statistic."""
    rows = valid(series)
    t = rows.groupBy(KEY).agg(F.avg(val()).alias("gm"))
    e = rows.groupBy(KEY, slot.alias("slot")).agg(F.count("*").alias("n"), F.avg(val()).alias("mean"), F.stddev_samp(val()).alias("sd")).join(t, KEY)
    effect = F.col("mean") - F.col("gm")
    return e.select(KEY, F.lit(name).alias("effect_of"), F.col("slot").cast("int").alias("slot"), "n", "mean", effect.alias("effect"), safe_div(effect, F.col("sd") / F.sqrt("n")).alias("t"))


def day_of_week_effects(series: DataFrame) -> DataFrame:
    """Slots are weekdays, Monday 0."""
    return _effect(series, F.weekday("ts"), "day_of_week")


def month_effects(series: DataFrame) -> DataFrame:
    return _effect(series, F.month("ts"), "month")


def working_day_effect(series: DataFrame) -> DataFrame:
    return _effect(series, is_working_day(F.col("ts")).cast("int"), "working_day")


def leap_year_effect(series: DataFrame) -> DataFrame:
    return _effect(series, is_leap_year(F.year("ts")).cast("int"), "leap_year")


def trading_day_effect(series: DataFrame) -> DataFrame:
    """Slope of monthly sums on the number of working days."""
    m = valid(series).groupBy(KEY, F.trunc(F.col("ts").cast("date"), "month").alias("month")).agg(F.sum(val()).alias("total"))
    m = m.withColumn("days", working_days_in_month(F.col("month")).cast("double"))
    return m.groupBy(KEY).agg(F.regr_slope("total", "days").alias("per_day"), F.coalesce(F.regr_r2("total", "days"), F.lit(0.0)).alias("r2"), F.count("*").alias("n_months"))


def holiday_effects(series: DataFrame, holidays: DataFrame, within: int = 7, beyond: int = 14) -> DataFrame:
    """Mean at each day offset from a holiday (``name``, ``day``), less the mean of days far from that holiday.

    Each holiday is spread over its offsets, so the join is on equal days.
    """
    rows = valid(series).withColumn("day", F.col("ts").cast("date"))
    spread = holidays.select("name", F.col("day").alias("at"), F.explode(F.sequence(F.lit(-beyond), F.lit(beyond))).alias("offset")).withColumn("day", F.date_add("at", F.col("offset")))
    total = rows.groupBy(KEY).agg(F.sum(val()).alias("s"), F.count("*").alias("n"))
    near = rows.join(spread, "day")
    close = near.groupBy(KEY, "name").agg(F.sum(val()).alias("cs"), F.count("*").alias("cn"))
    base = close.join(total, KEY).select(KEY, "name", safe_div(F.col("s") - F.col("cs"), (F.col("n") - F.col("cn")).cast("double")).alias("baseline"))
    at = near.where(F.abs("offset") <= within).groupBy(KEY, "name", "offset").agg(F.avg(val()).alias("mean"), F.count("*").alias("n"))
    return at.join(base, [KEY, "name"]).select(KEY, "name", "offset", "n", "mean", "baseline", (F.col("mean") - F.col("baseline")).alias("impact"))


def easter_effect(series: DataFrame) -> DataFrame:
    """Mean on Good Friday, on the other days up to three from Easter, a week before it, and on all other days."""
    rows = valid(series).withColumn("off", F.datediff(F.col("ts").cast("date"), easter(F.year("ts"))))
    slot = F.when(F.col("off") == -2, "good_friday").when(F.abs("off") <= 3, "easter").when(F.col("off") == -7, "palm_sunday").otherwise("other")
    return rows.groupBy(KEY, slot.alias("slot")).agg(F.count("*").alias("n"), F.avg(val()).alias("mean"))


def calendar_strength(series: DataFrame) -> DataFrame:
    """Share of the variance between weekdays and between months."""
    rows = valid(series)
    t = rows.groupBy(KEY).agg(F.var_pop(val()).alias("v"), F.avg(val()).alias("gm"), F.count("*").alias("n"))
    out = None
    for name, slot in (("day_of_week", F.weekday("ts")), ("month", F.month("ts"))):
        g = rows.groupBy(KEY, slot.alias("slot")).agg(F.avg(val()).alias("m"), F.count("*").alias("k")).join(t, KEY)
        one = g.groupBy(KEY, "v", "n").agg(F.sum(F.col("k") * (F.col("m") - F.col("gm")) ** 2).alias("b")).select(KEY, F.lit(name).alias("effect_of"), safe_div(F.col("b") / F.col("n"), F.col("v")).alias("strength"))
        out = one if out is None else out.unionByName(one)
    return out
