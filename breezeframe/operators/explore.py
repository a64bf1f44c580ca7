"""Exploratory statistics: distributions, seasons, trends, correlations and selections."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..core.quantiles import quantiles
from ..functions.air import main_pollutant, risk_class
from ..functions.calendar import month_name, season
from ..functions.numeric import clamp, correlation, sample_skewness
from .spine import DEFAULT_MONTH_AQI

# --- Fixed values: means of seasons without readings -------------------------
SEASON_AQI = {"Winter": 280.0, "Spring": 140.0, "Summer": 160.0, "Monsoon": 90.0, "Post_Monsoon": 200.0}

DAYS_PER_YEAR = 365.25
MIN_PAIRS = 10
MIN_SEASON_ROWS = 5


def select_years(df: DataFrame, first: int, last: int, stations: Sequence[str] = ()) -> DataFrame:
    """Closed year range, optionally some stations. Bounds on ``date`` itself reach the scan."""
    picked = df.where(
        (F.col("date") >= F.make_date(F.lit(first), F.lit(1), F.lit(1)))
        & (F.col("date") < F.make_date(F.lit(last + 1), F.lit(1), F.lit(1)))
    )
    return picked.where(F.col("station").isin(*stations)) if stations else picked


def describe(df: DataFrame, columns: Sequence[str], places: int = 3) -> DataFrame:
    """Count, mean, deviation, extremes, quartiles and skewness per station and column."""
    long = df.unpivot(["station"], list(columns), "variable", "value")
    group = ["station", "variable"]
    moments = long.groupBy(*group).agg(
        F.count("value").alias("count"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        sample_skewness(F.col("value")).alias("skew"),
    )
    q = quantiles(long, group, "value", {"p25": 0.25, "p50": 0.5, "p75": 0.75}).drop("n")
    names = ("mean", "std", "min", "p25", "p50", "p75", "max", "skew")
    return moments.join(q, group).select(
        *group, "count", *[F.round(c, places).alias(c) for c in names]
    )


def kpis(df: DataFrame, column: str = "aqi") -> DataFrame:
    return df.agg(
        F.count(column).alias("n"),
        F.round(F.avg(column), 6).alias("mean"),
        F.max(column).alias("max"),
        F.min(column).alias("min"),
    )


def monthly_means(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Means per month for each station and, with station null, for all rows together."""
    return df.groupBy("station", F.month("date").alias("month")).agg(
        *[F.sum(c).alias(f"_s_{c}") for c in columns], *[F.count(c).alias(f"_n_{c}") for c in columns]
    ).groupingSets(
        [["station", "month"], ["month"]], "station", "month"
    ).agg(
        *[(F.sum(f"_s_{c}") / F.sum(f"_n_{c}")).alias(c) for c in columns]
    )


def monthly_pattern(df: DataFrame, column: str = "aqi") -> DataFrame:
    """Twelve named months per station; a month without readings takes the default."""
    means = [
        F.struct(F.lit(m).alias("month"), F.avg(F.when(F.month("date") == m, F.col(column))).alias("v"))
        for m in range(1, 13)
    ]
    wide = df.groupBy("station").agg(F.array(*means).alias("_p"))
    return wide.select("station", F.explode("_p").alias("_m")).select(
        "station",
        month_name(F.col("_m.month")).alias("month"),
        F.round(F.coalesce("_m.v", F.lit(DEFAULT_MONTH_AQI)), 1).alias(column),
    )


def seasonal_pattern(df: DataFrame, column: str = "aqi", scheme: str = "training") -> DataFrame:
    """The mean of every season per station; a season without readings takes its default."""
    of = season(F.month("date"), scheme)
    means = [
        F.struct(F.lit(name).alias("season"), F.avg(F.when(of == name, F.col(column))).alias("v"), F.lit(default).alias("d"))
        for name, default in SEASON_AQI.items()
    ]
    wide = df.groupBy("station").agg(F.array(*means).alias("_p"))
    return wide.select("station", F.explode("_p").alias("_m")).select(
        "station", F.col("_m.season").alias("season"), F.round(F.coalesce("_m.v", "_m.d"), 1).alias(column)
    )


def seasonal_stats(df: DataFrame, column: str = "aqi", scheme: str = "training") -> DataFrame:
    return df.groupBy(season(F.month("date"), scheme).alias("season"), "station").agg(
        F.avg(column).alias("mean"),
        F.stddev_samp(column).alias("std"),
        F.min(column).alias("min"),
        F.max(column).alias("max"),
    )


def annual_trend(df: DataFrame, stations: Sequence[str], column: str = "aqi") -> DataFrame:
    """Yearly mean per listed station, and the first minus the second."""
    pivot = df.groupBy(F.year("date").alias("year")).pivot("station", list(stations)).agg(F.avg(column))
    return pivot.withColumn("difference", F.col(f"`{stations[0]}`") - F.col(f"`{stations[1]}`"))


def heatmap(df: DataFrame, column: str = "aqi") -> DataFrame:
    """Year by month means, one column per month."""
    by_year = df.groupBy(F.year("date").alias("year"))
    cells = [
        F.avg(F.when(F.month("date") == m, F.col(column))).alias(f"m{m}") for m in range(1, 13)
    ]
    return by_year.agg(*cells)


def pearson(df: DataFrame, columns: Sequence[str], by_station: bool = False) -> DataFrame:
    """Correlation of every column pair over rows where all columns are known (long, symmetric)."""
    full = df.dropna(subset=list(columns))
    pairs = list(combinations(columns, 2))
    aggs = [
        F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), correlation(a, b).alias("r")) for a, b in pairs
    ]
    keys = ["station"] if by_station else []
    packed = full.groupBy(*keys).agg(F.array(*aggs).alias("_p"))
    upper = packed.select(*keys, F.explode("_p").alias("_e")).select(*keys, "_e.x", "_e.y", "_e.r")
    both = F.array(
        F.struct(F.col("x").alias("x"), F.col("y").alias("y")),
        F.struct(F.col("y").alias("x"), F.col("x").alias("y")),
    )
    mirrored = upper.select(*keys, F.explode(both).alias("_e"), "r").select(
        *keys, "_e.x", "_e.y", "r"
    )
    diagonal = packed.select(
        *keys, F.explode(F.array(*[F.lit(c) for c in columns])).alias("x")
    ).select(*keys, "x", F.col("x").alias("y"), F.lit(1.0).alias("r"))
    return mirrored.unionByName(diagonal)


def correlations(
    df: DataFrame, features: Sequence[str], target: str = "aqi", by_station: bool = True, places: int = 4
) -> DataFrame:
    """Pairwise-complete correlation with the target; fewer than ten pairs are left out.

    One aggregate holds all features, so the rows are not multiplied by the number of features.
    """
    keys = ["station"] if by_station else []
    aggs = [
        F.struct(
            F.lit(f).alias("feature"),
            correlation(target, f).alias("r"),
            F.count(F.when(F.col(target).isNotNull() & F.col(f).isNotNull(), 1)).alias("n"),
        )
        for f in features
    ]
    long = df.groupBy(*keys).agg(F.array(*aggs).alias("_p")).select(
        *keys, F.explode("_p").alias("_e")
    )
    return long.where(F.col("_e.n") >= MIN_PAIRS).select(
        F.col("_e.feature").alias("feature"),
        *keys,
        F.round("_e.r", places).alias("pearson_r"),
        F.round(F.abs("_e.r"), places).alias("abs_r"),
    )


def compare_periods(
    df: DataFrame, periods: Mapping[str, tuple[str, str]], columns: Sequence[str]
) -> DataFrame:
    """Means within each named closed date range."""
    label = F.lit(None).cast("string")
    ranges = F.array(
        *[
            F.when(
                F.col("date").between(F.lit(lo).cast("date"), F.lit(hi).cast("date")), F.lit(name)
            ).otherwise(label)
            for name, (lo, hi) in periods.items()
        ]
    )
    # Ranges may overlap, so a row can belong to several periods.
    tagged = df.select(F.explode(F.array_compact(ranges)).alias("period"), *columns)
    return tagged.groupBy("period").agg(*[F.avg(c).alias(c) for c in columns])


def drop_between(
    df: DataFrame, before: tuple[str, str], during: tuple[str, str], column: str = "aqi"
) -> DataFrame:
    """Percentage by which a station's mean falls from one period to the next."""

    def mean(period: tuple[str, str]):
        inside = F.col("date").between(*[F.lit(d).cast("date") for d in period])
        return F.avg(F.when(inside, F.col(column)))

    m = df.groupBy("station").agg(mean(before).alias("before"), mean(during).alias("during"))
    return m.withColumn("drop_pct", (F.col("before") - F.col("during")) * 100.0 / F.col("before"))


def yearly_slope(df: DataFrame, column: str = "aqi", origin: str = "2000-01-01") -> DataFrame:
    years = F.date_diff(F.col("date"), F.lit(origin).cast("date")) / DAYS_PER_YEAR
    return df.groupBy("station").agg(F.regr_slope(F.col(column), years).alias("slope_per_year"))


def summary_facts(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Key figures as (metric, value) rows."""
    facts = {
        "rows": F.count(F.lit(1)).cast("double"),
        "stations": F.count_distinct("station").cast("double"),
        "aqi_mean": F.avg("aqi"),
        "aqi_std": F.stddev_samp("aqi"),
        "aqi_min": F.min("aqi"),
        "aqi_max": F.max("aqi"),
        "saturated": F.count_if(F.col("aqi") == 500).cast("double"),
        "first_year": F.min(F.year("date")).cast("double"),
        "last_year": F.max(F.year("date")).cast("double"),
    }
    facts |= {f"r_{a}_{b}": correlation(a, b) for a, b in pairs}
    wide = df.agg(*[v.alias(k) for k, v in facts.items()])
    return wide.unpivot([], list(facts), "metric", "value")


def season_distribution(df: DataFrame, column: str = "aqi", scheme: str = "training") -> DataFrame:
    """Quartiles per season and station with at least five values."""
    tagged = df.select("station", season(F.month("date"), scheme).alias("season"), column)
    q = quantiles(
        tagged, ["season", "station"], column, {"q1": 0.25, "median": 0.5, "q3": 0.75}
    )
    ext = tagged.groupBy("season", "station").agg(
        F.min(column).alias("min"), F.max(column).alias("max")
    )
    return q.where(F.col("n") >= MIN_SEASON_ROWS).join(ext, ["season", "station"])


def latest_per_station(df: DataFrame) -> DataFrame:
    """Newest row per station with its main pollutant and risk class."""
    values = [c for c in df.columns if c != "station"]
    newest = df.groupBy("station").agg(F.max_by(F.struct(*values), "date").alias("_r"))
    flat = newest.select("station", *[F.col(f"_r.{c}").alias(c) for c in values])
    return flat.withColumns(
        {
            "main_pollutant": main_pollutant(F.col("pm25"), F.col("pm10")),
            "risk": risk_class(F.col("aqi")),
        }
    )


def clip_normalise(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Map each column's 5th-95th percentile range to 0-1; a constant column becomes 0."""
    long = df.select(*columns).unpivot([], list(columns), "variable", "value")
    q = quantiles(long, ["variable"], "value", {"lo": 0.05, "hi": 0.95})
    # One row per column of the table: a scalar map, not a join.
    limits = q.agg(
        F.map_from_entries(F.collect_list(F.struct("variable", F.struct("lo", "hi")))).alias("m")
    ).scalar()
    with_limits = df.withColumn("_m", limits)
    out = {}
    for c in columns:
        lo, hi = F.col("_m")[c]["lo"], F.col("_m")[c]["hi"]
        out[f"{c}_norm"] = F.when(hi > lo, (clamp(F.col(c), lo, hi) - lo) / (hi - lo)).otherwise(
            F.when(F.col(c).isNotNull(), 0.0)
        )
    return with_limits.withColumns(out).drop("_m")


def top_days(df: DataFrame, n: int = 10, column: str = "aqi") -> DataFrame:
    """Highest values, then the earlier date, then the station name."""
    return df.orderBy(F.desc(column), "date", "station").limit(n)


def latest_rows(df: DataFrame, n: int) -> DataFrame:
    return df.orderBy(F.desc("date"), "station").limit(n)


def join_stations(df: DataFrame, a: str, b: str, columns: Sequence[str]) -> DataFrame:
    """Two stations side by side on their common dates."""
    left = df.where(F.col("station") == a).select("date", *[F.col(c).alias(f"{c}_a") for c in columns])
    right = df.where(F.col("station") == b).select("date", *[F.col(c).alias(f"{c}_b") for c in columns])
    return left.join(right, "date", "inner")


def sort_series(df: DataFrame) -> DataFrame:
    """Station, then date: a range-partitioned sort, for sinks only."""
    return df.orderBy("station", "date")
