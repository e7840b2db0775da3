"""Calendar and time-of-day operators: bar strength, turn of month, time-price profiles, volume against earlier sessions,
and the nearest-row test of a splitter."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..series import RN, Series, SeriesSpec

SLOTS = 48                                    # half-hours of a day


def bar_strength(high: str = "high", low: str = "low", close: str = "close") -> Column:
    """(close - low) / (high - low), one half on a bar without range."""
    span = F.col(high) - F.col(low)
    return F.when(span > 0, (F.col(close) - F.col(low)) / span).otherwise(0.5)


def business_days_on(date: Column, n: int) -> Column:
    """The date n business days later (n < 0: earlier); a weekend counts from the Friday before it (the Monday after it)."""
    dow = F.weekday(date)                     # Monday 0
    if n >= 0:
        base = F.least(dow, F.lit(4))
        return F.date_add(date, (base - dow + n + 2 * F.floor((base + n) / 5)).cast("int"))
    base = F.when(dow > 4, 7).otherwise(dow)
    left = F.when(dow > 4, 4).otherwise(4 - dow)
    return F.date_sub(date, (dow - base - n + 2 * F.floor((left - n) / 5)).cast("int"))


def turn_of_month(date: Column, last_days: int = 1, first_days: int = 3) -> Column:
    """Among the last or first business days of its month by the calendar, which is known ahead; no later row is needed."""
    differ = lambda other: F.month(other) != F.month(date)
    return differ(business_days_on(date, last_days)) | differ(business_days_on(date, -first_days))


def half_hour(ts: str) -> Column:
    return (F.hour(ts) * 2 + F.floor(F.minute(ts) / 30)).cast("int")


def time_price_profile(ticks: DataFrame, keys: list[str], ts: str, price: str, width: float) -> DataFrame:
    """keys, date, bin, periods: the half-hours of a session in which a price bin was traded.

    The half-hours are bits of one long, merged by OR, so a busy bin is one row a task before the shuffle.
    """
    d = ticks.where(F.col(price).isNotNull()).select(*keys, F.to_date(ts).alias("date"), F.floor(F.col(price) / width).alias("bin"), F.expr(f"shiftleft(1L, {'cast(hour(' + ts + ') * 2 + floor(minute(' + ts + ') / 30) as int)'})").alias("_bit"))
    return d.groupBy(*keys, "date", "bin").agg(F.bit_count(F.bit_or("_bit")).cast("long").alias("periods"))


def profile_levels(profile: DataFrame, keys: list[str], share: float = 0.7) -> DataFrame:
    """keys, date, bins, point: the bin with most half-hours (lowest first), and low and high of the most traded bins that
    together hold `share` of all half-hours."""
    by = [*keys, "date"]
    ranked = Window.partitionBy(*by).orderBy(F.desc("periods"), "bin")
    d = profile.withColumn("_before", F.coalesce(F.sum("periods").over(ranked.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("_all", F.sum("periods").over(Window.partitionBy(*by)))
    held = F.col("_before") < share * F.col("_all")
    return d.groupBy(*by).agg(F.count(F.lit(1)).alias("bins"), F.min_by("bin", F.struct(-F.col("periods"), F.col("bin"))).alias("point"),
                              F.min(F.when(held, F.col("bin"))).alias("value_low"), F.max(F.when(held, F.col("bin"))).alias("value_high"))


def relative_volume(ticks: DataFrame, keys: list[str], ts: str, size: str) -> DataFrame:
    """keys, date, slot, volume, ratio: volume of a half-hour over its mean in earlier sessions; null in the first."""
    d = ticks.groupBy(*keys, F.to_date(ts).alias("date"), half_hour(ts).alias("slot")).agg(F.sum(size).alias("volume"))
    past = Window.partitionBy(*keys, "slot").orderBy("date").rowsBetween(Window.unboundedPreceding, -1)
    return d.withColumn("ratio", F.try_divide(F.col("volume"), F.avg("volume").over(past)))


def nearest_row_r2(s: Series, y: str, fold: Column, gap: int = 0) -> DataFrame:
    """keys, n, r2 of a model that predicts each row with the nearest row in time that trains for its fold (ties go back).

    Such a model can only work through labels that overlap, so its score is what a splitter leaks.  A row's training rows are
    those of other folds at least `gap` rows outside its run of equal folds; the borders of the run come from running values
    in both directions, so no row meets the rows of a fold.
    """
    keys = s.keys
    d = Series.of(s.flat().df.where(F.col(y).isNotNull()).select(*keys, F.col(RN).alias("_at"), F.col(y).cast("double").alias("_y"), fold.alias("_fold")),
                  SeriesSpec(tuple(keys), ("_at",), "_at div 65536"), back=1)
    prior = d.lag("_fold")
    starts = d.add(_start=F.when(prior.isNull() | (prior != F.col("_fold")), F.col(RN))).running({"_from": ("last", F.col("_start"))}).done(keep_rn=True)
    # the last row of a run is the row before the next start; looked up by its start
    runs = starts.groupBy(*keys, "_from").agg(F.max(RN).alias("_to"))
    rows = starts.join(runs, [*keys, "_from"]).withColumn("_left", F.col("_from") - 1 - gap).withColumn("_right", F.col("_to") + 1 + gap)
    ys = starts.select(*keys, F.col(RN).alias("_p"), F.col("_y").alias("_v"))
    at = lambda side: ys.select(*keys, F.col("_p").alias(f"_{side}"), F.col("_v").alias(f"_{side}_y"))
    rows = rows.join(at("left"), [*keys, "_left"], "left").join(at("right"), [*keys, "_right"], "left")
    back, ahead = F.col(RN) - F.col("_left"), F.col("_right") - F.col(RN)
    p = F.when(F.col("_left_y").isNull(), F.col("_right_y")).when(F.col("_right_y").isNull() | (back <= ahead), F.col("_left_y")).otherwise(F.col("_right_y"))
    g = rows.withColumn("_hat", p).where("_hat is not null").groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum((F.col("_y") - F.col("_hat")) ** 2).alias("_e"), (F.var_pop("_y") * F.count(F.lit(1))).alias("_t"))
    return g.select(*keys, "n", (1 - F.try_divide(F.col("_e"), F.col("_t"))).alias("r2"))
