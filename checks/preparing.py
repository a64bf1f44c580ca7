"""The whole preprocessing chain: messy readings to a clean, regular, split series."""

from __future__ import annotations

from pyspark.sql import functions as F

from breezeframe.core.schema import LIMITS
from breezeframe.operators import schema_ops
from breezeframe.plans.preprocess import Settings, preprocess

from . import inputs as I
from .registry import check

_COLUMNS = ("aqi", "pm25")
_K = 0.25  # narrow enough that readings are capped


def _known(c: str) -> str:
    """Value and moment of the last known reading before and the first one after, in both directions."""
    at = f"CASE WHEN {c} IS NOT NULL THEN date END"
    return f"""last_value({c} IGNORE NULLS) OVER b AS {c}_p, last_value({at} IGNORE NULLS) OVER b AS {c}_pt,
      first_value({c} IGNORE NULLS) OVER a AS {c}_n, first_value({at} IGNORE NULLS) OVER a AS {c}_nt"""


def _between(c: str) -> str:
    share = f"(epoch(date) - epoch({c}_pt)) / (epoch({c}_nt) - epoch({c}_pt))"
    return f"greatest(0.0, coalesce({c}, {c}_p + ({c}_n - {c}_p) * {share}, {c}_p, {c}_n)) AS {c}"


def _fence(c: str) -> str:
    q1, q3 = f"quantile_cont({c}, 0.25)", f"quantile_cont({c}, 0.75)"
    lo, hi = LIMITS[c]
    return f"greatest({q1} - {_K} * ({q3} - {q1}), {lo}) AS {c}_lo, least({q3} + {_K} * ({q3} - {q1}), {hi}) AS {c}_hi"


def _each(part) -> str:
    return ", ".join(part(c) for c in _COLUMNS)


_CHAIN = (
    I.with_(I.READINGS, I.GAPPY, I.HOURLY)
    + f""", carried AS (SELECT station, date, {_each(lambda c: f"last_value({c} IGNORE NULLS) OVER w AS {c}")} FROM hourly
      WINDOW w AS (PARTITION BY station ORDER BY date ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)),
    known AS (SELECT *, {_each(_known)} FROM carried
      WINDOW b AS (PARTITION BY station ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
        a AS (PARTITION BY station ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
    filled AS (SELECT station, date, {_each(_between)} FROM known),
    fences AS (SELECT station, {_each(_fence)} FROM filled GROUP BY 1),
    clean AS (SELECT station, date, {_each(lambda c: f"greatest(least({c}, {c}_hi), {c}_lo) AS {c}")} FROM filled JOIN fences USING (station)),
    placed AS (SELECT *, row_number() OVER (PARTITION BY station ORDER BY date) - 1 AS pos, count(*) OVER (PARTITION BY station) AS n FROM clean),
    cuts AS (SELECT *, n - CAST(floor(n * 0.15) AS BIGINT) AS test FROM placed),
    ends AS (SELECT *, test - 24 AS val_end, test - 24 - CAST(floor(n * 0.10) AS BIGINT) AS val FROM cuts)
    """
)


@check(
    "preprocess_chain",
    _CHAIN
    + """SELECT station, date, round(aqi, 4) AS aqi, round(pm25, 4) AS pm25,
      CASE WHEN pos < val - 24 THEN 'train' WHEN pos >= val AND pos < val_end THEN 'val' ELSE 'test' END AS split
    FROM ends WHERE pos < val - 24 OR (pos >= val AND pos < val_end) OR pos >= test""",
)
def _(spark, sf):
    g = I.gappy(spark, sf).select(
        F.col("date").alias(" Timestamp "), F.col("station").alias("StationName"), F.col("aqi").alias("air_quality_index"), F.col("pm25").alias("PM2.5")
    )
    # A third of the readings arrives twice.
    raw = g.unionByName(g.where(F.pmod(F.xxhash64(" Timestamp "), F.lit(3)) == 0))
    done = preprocess(schema_ops.trim_all(raw), Settings(threshold=_K, timeline=I.timeline()))
    return I.rounded(done.split.select("station", "date", *_COLUMNS, "split"), list(_COLUMNS), 4)


@check(
    "preprocess_outliers",
    _CHAIN
    + " UNION ALL ".join(
        f"""SELECT station, '{c}' AS variable, round(any_value({c}_lo), 3) AS lower_bound, round(any_value({c}_hi), 3) AS upper_bound,
      count(*) FILTER ({c} < {c}_lo OR {c} > {c}_hi) AS treated FROM filled JOIN fences USING (station) GROUP BY 1"""
        for c in _COLUMNS
    ),
)
def _(spark, sf):
    g = I.gappy(spark, sf).select("date", "station", "aqi", "pm25")
    done = preprocess(g, Settings(threshold=_K, timeline=I.timeline()))
    return done.outliers
