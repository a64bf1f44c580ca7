"""Raw readings of any number of stations to a clean, regular, split series."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame

from ..core.schema import NUMERIC
from ..core.timeline import Timeline
from ..operators import dedupe, fences, fill, grid, quality, schema_ops, splits


@dataclass(frozen=True)
class Settings:
    step: str = "HOUR"
    strategy: str = "interpolate"
    axis: str = "time"
    min_valid: float = 0.60
    method: str = "iqr"
    threshold: float = fences.THRESHOLD
    treatment: str = "cap"
    test: float = splits.TEST_SHARE
    val: float = splits.VAL_SHARE
    gap: int = splits.GAP_ROWS
    timeline: Timeline = Timeline()


@dataclass(frozen=True)
class CleaningState:
    """What fitting learned; ``transform`` applies it to other readings unchanged."""

    dropped: tuple[str, ...]
    medians: DataFrame
    columns: tuple[str, ...]


@dataclass(frozen=True)
class Preprocessed:
    clean: DataFrame
    fences: DataFrame
    outliers: DataFrame
    scores: DataFrame
    split: DataFrame
    state: CleaningState


def _regular(df: DataFrame, columns: Sequence[str], s: Settings) -> DataFrame:
    series = dedupe.keep_first(df.select("station", "date", *columns), [])
    return fill.forward_fill(
        grid.resample(series, columns, s.step), columns, fill.SHORT_GAP, s.timeline
    )


def fit_clean(
    validated: DataFrame, s: Settings = Settings(), fit_on: Column | None = None
) -> tuple[DataFrame, CleaningState]:
    """Clean and learn. Statistics come from the rows that satisfy ``fit_on``, by default all."""
    columns = [c for c in NUMERIC if c in validated.columns]
    regular = _regular(validated, columns, s)
    basis = regular if fit_on is None else regular.where(fit_on)
    dropped = schema_ops.low_coverage_columns(basis, columns, s.min_valid)
    kept = [c for c in columns if c not in dropped]
    state = CleaningState(tuple(dropped), fill.medians(basis, kept), tuple(kept))
    return _finish(regular, state, s), state


def transform_clean(validated: DataFrame, state: CleaningState, s: Settings = Settings()) -> DataFrame:
    return _finish(_regular(validated, state.columns, s), state, s)


def _finish(regular: DataFrame, state: CleaningState, s: Settings) -> DataFrame:
    kept = list(state.columns)
    filled = fill.impute(
        regular.select("station", "date", *kept), kept, s.strategy, s.axis, state.medians, s.timeline
    )
    return schema_ops.clip_non_negative(filled)


def preprocess(
    raw: DataFrame, s: Settings = Settings(), fit_on: Column | None = None
) -> Preprocessed:
    """Validate, deduplicate, resample, fill, fence, score and split.

    Statistics are fitted on the whole series unless ``fit_on`` narrows them.
    """
    validated = schema_ops.validate(raw)
    clean, state = fit_clean(validated, s, fit_on)
    kept = list(state.columns)
    basis = clean if fit_on is None else clean.where(fit_on)
    learned = fences.learn(basis, kept, s.method, s.threshold)
    treated = fences.apply(clean, learned, kept, s.treatment)
    return Preprocessed(
        clean=treated,
        fences=learned,
        outliers=fences.summary(clean, learned, kept),
        scores=quality.overall_score(treated, kept, s.step),
        split=splits.gap_split(treated, s.test, s.val, s.gap, s.timeline),
        state=state,
    )
