"""Scenario forecasts: recursive horizons over measured history, and free what-if steps."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..core.shared import materialise
from ..core.timeline import Timeline
from ..functions import air
from ..functions import calendar as cal
from ..functions.interactions import interactions
from ..functions.numeric import clamp, flag
from ..functions.weather import diurnal
from ..operators import asof, grid, spatial
from ..operators.history import EPISODE_AQI
from ..operators.requests import DELTA_FLOORS, DELTA_RANGE, month_terms
from ..core.shared import cut_lineage

HISTORY_DAYS = 30
HOURS = 24
LAST_HOUR = max(air.HORIZONS)
BLOCKS = LAST_HOUR // HOURS + 1
# --- Fixed values: measured columns, look-backs and clips of the what-if ----
MEASURED = (
    "aqi", "pm25", "pm10", "no2", "so2", "co", "o3", "nh3",
    "temperature", "humidity", "wind_speed", "pressure",
)
AQI_LAGS = (1, 2, 3, 7, 14, 30)
PM25_LAGS = (1, 7)
OTHER_LAGS = ("pm10", "co", "no2", "temperature", "wind_speed")
WHAT_IF_RANGE = (15.0, 500.0)
WHAT_IF_FACTORS = {
    "lag_pm25_1": ("pm25", 0.92),
    "lag_pm25_7": ("pm25", 0.85),
    "lag_pm10_1": ("pm10", 0.90),
    "lag_co_1": ("co", 0.88),
    "lag_no2_1": ("no2", 0.88),
    "lag_temperature_1": ("temperature", 1.0),
    "lag_wind_speed_1": ("wind_speed", 1.0),
    "roll_mean_pm25_7": ("pm25", 0.88),
    "roll_mean_pm10_7": ("pm10", 0.88),
    "roll_std_pm25_7": ("pm25", 0.08),
}
CUT_EVERY = 8


def half_days(readings: DataFrame, columns: Sequence[str], timeline: Timeline = Timeline()) -> DataFrame:
    """Nearest reading for every half day of a station, with the 30 days before and 3 after as arrays.

    Readings stand at midnight, so the nearest one is the same for every moment inside a half day
    ``(00:00, 12:00]`` or ``(12:00, 24:00]``: two lookups per day serve all hours. ``days[i]`` is the
    value ``BLOCKS - 1 - i`` days ahead.
    """
    # The spine reaches past both ends until arrays hold the first or the last reading only; moments
    # further out have the same arrays (``_covered``).
    span = readings.groupBy("station").agg(
        F.date_sub(F.min(F.col("date").cast("date")), 2 * HISTORY_DAYS).alias("lo"),
        F.date_add(F.max(F.col("date").cast("date")), HISTORY_DAYS + 2 * BLOCKS).alias("hi"),
    )
    days = grid.spine(span, "DAY", name="day")
    slots = days.select(
        "station",
        F.explode(F.array(F.lit(0), F.lit(1))).alias("half"),
        "day",
    ).withColumn("date", F.expr("CAST(day AS TIMESTAMP_NTZ) + make_dt_interval(0, 6 + 12 * half)"))
    stamped = readings.withColumn("date", F.col("date").cast("timestamp_ntz"))
    dense = asof.nearest(slots, stamped, columns, timeline=timeline)
    value = F.struct(*[F.col(c).cast("double").alias(c) for c in columns])
    series = Timeline(("station", "half"), "day", (), "MONTH", timeline.rows)
    return series.select(
        dense.withColumn("_v", value),
        lambda f: {
            "days": F.reverse(F.collect_list("_v").over(f.rows(-HISTORY_DAYS, BLOCKS - 1)))
        },
        before=HISTORY_DAYS,
        after=BLOCKS - 1,
        keep=["station", "half", "day"],
    ).where(F.size("days") == HISTORY_DAYS + BLOCKS)


def forecast_hours(
    requests: DataFrame,
    readings: DataFrame,
    model: PipelineModel,
    timeline: Timeline = Timeline(),
    columns: Sequence[str] | None = None,
    extra: Sequence[str] = (),
    anchors: DataFrame | None = None,
) -> DataFrame:
    """Hourly predictions 0..72 per request.

    ``requests``: ``request``, ``station``, ``at`` (timestamp) and optional override columns
    ``o_<name>``. Look-backs reach whole days back, so hour h depends on hours h-24, h-48 and h-72
    only: one row per (request, hour of day) carries its own earlier predictions and four model passes
    over the same rows replace 72 dependent steps, without joins or lineage cuts between them.

    With ``anchors`` (``station, lat, lon``) and request columns ``lat`` and ``lon``, a request at a station without readings is
    answered for its place: every reading it looks up is the inverse-distance blend of the anchors' nearest readings.

    Every request row is answered on its own, whatever its ``request`` says. Requests without a moment, and
    those at stations without readings and without a place, stay with null predictions.
    """
    cols = list(columns or [c for c in MEASURED if c in readings.columns])
    dense = half_days(readings, cols, timeline)
    span = readings.groupBy("station").agg(
        F.min(F.col("date").cast("date")).alias("_from"), F.max(F.col("date").cast("date")).alias("_to")
    )
    span = materialise(span.where(F.col("station").isNotNull()), "forecast-span")
    overrides = [c for c in cols if f"o_{c}" in requests.columns]
    by_place = anchors is not None and {"lat", "lon"} <= set(requests.columns)
    place = F.concat_ws(" ", F.col("lat").cast("string"), F.col("lon").cast("string")) if by_place else F.lit(None).cast("string")
    held = list(dict.fromkeys(["request", "station", "at", *extra, *(f"o_{c}" for c in overrides), *(("lat", "lon") if by_place else ())]))
    asked = requests.select(*held, F.monotonically_increasing_id().alias("_id"), place.alias("_place"))
    asked = materialise(asked, "forecast-requests")
    timed = asked.where(F.col("at").isNotNull())
    known = timed.join(span.select("station"), "station", "left_semi")
    rows = _arrays(known, lambda moments: _covered(moments, span).join(dense, ["station", "day", "half"]).drop("day", "half"))
    answered_ids = known.select("_id")
    if by_place:
        free = timed.where(F.col("lat").isNotNull() & F.col("lon").isNotNull()).join(span.select("station"), "station", "left_anti")
        used = anchors.join(span.select("station"), "station", "left_semi")
        blended = _blended(free, used, dense, span, cols)
        rows = rows.unionByName(_arrays(free, lambda moments: moments.join(blended, ["_place", "day", "half"]).drop("day", "half")))
        answered_ids = answered_ids.unionByName(free.select("_id")) if not used.isEmpty() else answered_ids
    for b in range(BLOCKS):
        rows = _predict_block(rows, b, cols, overrides, model)
    kept = rows.select(
        "request",
        "station",
        "at",
        *extra,
        "hour",
        F.posexplode_outer(F.array(*[F.col(f"_pred{b}") for b in range(BLOCKS)])).alias("_b", "prediction"),
    )
    answered = (
        kept.withColumn("hours", F.col("hour") + HOURS * F.col("_b"))
        .where(F.col("hours") <= LAST_HOUR)
        .drop("hour", "_b")
    )
    unknown = asked.join(answered_ids, "_id", "left_anti").select(
        "request",
        "station",
        "at",
        *extra,
        F.lit(None).cast("double").alias("prediction"),
        F.explode(F.sequence(F.lit(0), F.lit(LAST_HOUR))).alias("hours"),
    )
    return answered.unionByName(unknown)


def _arrays(asked: DataFrame, looked_up: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A row for each request and hour of day with the arrays of its moment, and the readings nearest to the request itself.

    Overrides are relative to those; ``looked_up`` adds ``days`` to moments with ``day`` and ``half``.
    """
    hours = asked.withColumn("hour", F.explode(F.sequence(F.lit(0), F.lit(HOURS - 1))))
    hours = hours.withColumn("_when", F.col("at") + F.make_dt_interval(hours=F.col("hour"))).withColumns(_slot(F.col("_when")))
    own = asked.select("_id", "station", "_place", "at").withColumns(_slot(F.col("at")))
    base = looked_up(own).select("_id", F.get("days", F.lit(BLOCKS - 1)).alias("_base"))
    return looked_up(hours).join(base, "_id").drop("_id", "_place", "lat", "lon")


def _blended(free: DataFrame, anchors: DataFrame, dense: DataFrame, span: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``_place, day, half, days`` of the half days that requests at places look up: their anchors' arrays, blended by distance."""
    weights = spatial.station_weights(free.select("_place", "lat", "lon").distinct(), anchors, "_place")
    weights = materialise(weights.where("weight > 0"), "forecast-weights")
    when = F.explode(F.sequence(F.lit(0), F.lit(HOURS), F.lit(HOURS // 2)))
    moments = free.select("_place", "at", when.alias("_h"))  # hours 0, 12 and 24 reach every half day of the requests' hours
    moments = moments.select("_place", (F.col("at") + F.make_dt_interval(hours=F.col("_h"))).alias("_when")).withColumns(_slot(F.col("_when")))
    needed = moments.select("_place", "day", "half").distinct()
    met = needed.join(weights, "_place").withColumn("_asked", F.col("day"))
    met = _covered(met, span).join(dense, ["station", "day", "half"])
    each = met.select("_place", F.col("_asked").alias("day"), "half", "weight", F.posexplode("days").alias("_k", "_v"))

    def mean(c: str) -> Column:
        known = F.col(f"_v.{c}").isNotNull()
        return F.sum(F.col("weight") * F.col(f"_v.{c}")) / F.sum(F.when(known, F.col("weight")))

    days = each.groupBy("_place", "day", "half", "_k").agg(F.struct(*[mean(c).alias(c) for c in cols]).alias("_v"))
    whole = days.groupBy("_place", "day", "half").agg(F.array_sort(F.collect_list(F.struct("_k", "_v"))).alias("_all"))
    return whole.select("_place", "day", "half", F.transform("_all", lambda e: e["_v"]).alias("days"))


def _covered(rows: DataFrame, span: DataFrame) -> DataFrame:
    """Move ``day`` to the nearest day that has arrays; beyond it only the first or last reading is nearest."""
    first = F.date_sub("_from", HISTORY_DAYS)
    last = F.date_add("_to", HISTORY_DAYS + BLOCKS)
    day = F.greatest(first, F.least(last, F.col("day")))
    return rows.join(span, "station").withColumn("day", day).drop("_from", "_to")


def _slot(when: Column) -> dict[str, Column]:
    """Day and half of the right-closed half-day that holds ``when``."""
    shifted = when - F.expr("INTERVAL '0.000001' SECOND")
    return {
        "day": shifted.cast("date"),
        "half": (F.hour(shifted) >= 12).cast("int"),
    }


def _moved(name: str, now: Column, overrides: Sequence[str]) -> Column:
    """Value at a future step: the nearest reading plus the request's change, within its floor."""
    value = now[name]
    if name in overrides:
        asked = F.coalesce(F.col(f"o_{name}").cast("double"), F.col("_base")[name])
        value = value + (asked - F.col("_base")[name])
    if name in DELTA_FLOORS:
        return F.when(value.isNotNull(), F.greatest(value, F.lit(DELTA_FLOORS[name])))
    return clamp(value, *DELTA_RANGE[name]) if name in DELTA_RANGE else value


def _predict_block(
    rows: DataFrame, b: int, cols: Sequence[str], overrides: Sequence[str], model: PipelineModel
) -> DataFrame:
    keep = [*rows.columns, f"_pred{b}"]

    def day(k: int) -> Column:
        """The struct ``k`` days before this block's moment."""
        return F.get("days", F.lit(BLOCKS - 1 - b + k))

    def aqi_back(k: int) -> Column:
        return F.col(f"_pred{b - k}") if k <= b else day(k)["aqi"]

    def pm25_back(k: int) -> Column:
        return _moved("pm25", day(k), overrides) if k <= b else day(k)["pm25"]

    when = F.col("_when") + F.make_dt_interval(days=F.lit(b))
    out = {c: _moved(c, day(0), overrides) for c in cols if c != "aqi"}
    out |= {**cal.calendar_parts(when), **cal.cyclical_parts(when), **cal.hour_cycle(when)}
    step = rows.withColumns(out)
    seasonal = {"season": cal.season(F.col("month")), **cal.event_flags(when)}
    step = step.withColumns(seasonal).withColumns(cal.season_flags(F.col("season")))
    back = {f"lag_aqi_{k}": aqi_back(k) for k in AQI_LAGS}
    back |= {"_aqi": F.array(*[aqi_back(k) for k in range(1, HISTORY_DAYS + 1)])}
    if "pm25" in cols:
        back |= {f"lag_pm25_{k}": pm25_back(k) for k in PM25_LAGS}
        back |= {"_pm25": F.array(*[pm25_back(k) for k in range(1, 8)])}
    back |= {f"lag_{c}_1": day(1)[c] for c in OTHER_LAGS if c in cols}
    if "pm10" in cols:
        back["_pm10"] = F.array(*[day(k)["pm10"] for k in range(1, 8)])
    step = step.withColumns(back)
    rolled = {
        **{f"roll_mean_aqi_{n}": _mean("_aqi", n) for n in (3, 7, 14, 30)},
        "roll_std_aqi_7": _deviation("_aqi", 7),
        **{f"roll_trend_aqi_{n}": _slope("_aqi", n) for n in (7, 30)},
    }
    if "pm25" in cols:
        rolled |= {"roll_mean_pm25_7": _mean("_pm25", 7), "roll_std_pm25_7": _deviation("_pm25", 7)}
    if "pm10" in cols:
        rolled["roll_mean_pm10_7"] = _mean("_pm10", 7)
    step = step.withColumns(rolled)
    step = step.withColumns(
        {
            "roll_aqi_momentum": F.round(F.col("roll_mean_aqi_3") - F.col("roll_mean_aqi_7"), 4),
            "roll_episode_flag": flag(F.col("roll_mean_aqi_7") > EPISODE_AQI),
            "aqi_saturated": flag(F.col("lag_aqi_1") == cal.SATURATED_AQI),
        }
    )
    step = step.withColumns(interactions(step.columns))
    scored = model.transform(step)
    return scored.withColumn(
        f"_pred{b}", F.greatest(F.lit(0.0), F.col("prediction"))
    ).select(*keep)


def _first(values: str, n: int) -> Column:
    return F.slice(values, 1, n)


def _mean(values: str, n: int) -> Column:
    return F.aggregate(_first(values, n), F.lit(0.0), lambda a, v: a + v) / n


def _deviation(values: str, n: int) -> Column:
    mean = _mean(values, n)
    squares = F.aggregate(_first(values, n), F.lit(0.0), lambda a, v: a + (v - mean) * (v - mean))
    return F.sqrt(squares / (n - 1))


def _slope(values: str, n: int) -> Column:
    """Least-squares slope; ``values`` runs from yesterday backwards."""
    centre = (n - 1) / 2.0
    spread = sum((i - centre) ** 2 for i in range(n))
    weighted = F.transform(_first(values, n), lambda v, i: v * (F.lit(centre) - i))
    return F.aggregate(weighted, F.lit(0.0), lambda a, v: a + v) / spread


def read_out(hourly: DataFrame, horizons: Sequence[int] = air.HORIZONS) -> DataFrame:
    """Bands, labels and advice at the reported horizons."""
    at = hourly.where(F.col("hours").isin(*horizons))
    timeless = F.col("at").isNull() if "at" in hourly.columns else F.lit(False)
    lower, upper = air.band(F.col("prediction"), F.col("hours"))
    return at.select(
        "request",
        "station",
        "hours",
        air.horizon_label(F.col("hours")).alias("horizon"),
        F.round("prediction", 2).alias("aqi"),
        F.round(lower, 2).alias("lower"),
        F.round(upper, 2).alias("upper"),
        air.advisory(F.col("prediction")).alias("advisory"),
        F.when(timeless, "no moment given").when(F.col("prediction").isNull(), "no readings at this station").alias("reason"),
    )


def what_if_steps(
    scenarios: DataFrame,
    model: PipelineModel,
    features: Sequence[str],
    means: DataFrame,
    steps: int = HOURS,
    cut_every: int = CUT_EVERY,
) -> DataFrame:
    """Hourly what-if forecast that feeds each prediction back as yesterday's value.

    ``scenarios``: ``scenario``, ``at`` and any of the measured columns, ``lag_aqi_1`` and
    ``lag_aqi_7``. The steps depend on each other, so the plan is cut every ``cut_every`` steps.
    """
    lags = ("lag_aqi_1", "lag_aqi_7")
    mean_row = means.agg(
        F.struct(*[F.avg(c).alias(c) for c in dict.fromkeys((*features, *lags))]).alias("m")
    ).scalar()
    given = [c for c in MEASURED if c in scenarios.columns and c != "aqi"]
    start = [
        F.coalesce(*([F.col(c).cast("double")] if c in scenarios.columns else []), F.col(f"_m.{c}"))
        for c in lags
    ]
    state = scenarios.withColumn("_m", mean_row).select(
        "scenario",
        "at",
        "_m",
        F.struct(*[F.col(c).cast("double").alias(c) for c in given]).alias("_g"),
        start[0].alias("_lag1"),
        start[1].alias("_lag7"),
        F.array().cast("array<double>").alias("_out"),
    )
    for i in range(1, steps + 1):
        state = _what_if_step(state, i, features, given, model)
        if i % cut_every == 0 and i < steps:
            state = cut_lineage(state)
    return state.select("scenario", "at", F.posexplode_outer("_out").alias("_i", "_v")).select(
        "scenario", "at", (F.col("_i") + 1).alias("hours"), F.floor("_v").cast("int").alias("aqi")
    )


def _what_if_step(
    state: DataFrame, i: int, features: Sequence[str], given: Sequence[str], model: PipelineModel
) -> DataFrame:
    when = F.col("at") + F.make_dt_interval(hours=F.lit(i))
    half_sum = (F.col("_lag1") + F.col("_lag7")) / 2

    def value(c: str) -> Column:
        options = [F.col(f"_g.{c}")] if c in given else []
        options += [F.col(f"_m.{c}")] if c in features else []
        return F.coalesce(*options)

    known = {c: value(c) for c in MEASURED if c != "aqi" and (c in given or c in features)}
    terms: dict[str, Column] = {c: F.col(f"_m.{c}") for c in features}
    terms |= known
    terms |= {f"lag_aqi_{k}": F.col("_lag1" if k <= 3 else "_lag7") for k in AQI_LAGS}
    terms |= {
        name: known[source] * factor
        for name, (source, factor) in WHAT_IF_FACTORS.items()
        if source in known
    }
    terms |= {
        "roll_mean_aqi_7": half_sum,
        "roll_mean_aqi_30": half_sum,
        "roll_std_aqi_7": F.abs(F.col("_lag1") - F.col("_lag7")) / 2,
        "roll_aqi_momentum": F.col("_lag1") - F.col("_lag7"),
        "roll_episode_flag": flag(half_sum > EPISODE_AQI),
        "is_covid_lockdown": F.lit(0),
        "is_diwali": F.lit(0),
        "aqi_saturated": F.lit(0),
        "year": F.year(when),
        "quarter": F.quarter(when),
        "is_weekend": (F.weekday(when) >= 5).cast("int"),
        **month_terms(F.month(when)),
    }
    # Interactions use the requested weather; the daily curves move it afterwards.
    step = state.withColumns(terms)
    step = step.withColumns(interactions(step.columns))
    if {"temperature", "humidity", "wind_speed", "pressure"} <= set(known):
        weather = [F.col(c) for c in ("temperature", "humidity", "wind_speed", "pressure")]
        step = step.withColumns(diurnal(F.hour(when), *weather))
    scored = model.transform(step)
    clipped = clamp(F.round("prediction", 1), *WHAT_IF_RANGE)
    return scored.select(
        "scenario", "at", "_m", "_g", clipped.alias("_lag1"), "_lag7", F.array_append("_out", clipped).alias("_out")
    )
