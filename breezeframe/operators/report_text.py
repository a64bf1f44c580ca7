"""Table rows recovered from report text lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..core import schema as S
from ..core.shared import materialise

# --- Fixed values: patterns and month names ---------------------------------
STARTS_WITH_DATE = r"^\d{4}-\d{2}-\d{2}"
IS_DATE = r"^\d{4}-\d{2}-\d{2}$"
MONTHS = (
    "january", "february", "march", "april", "may", "june",
    "july", "august", "september", "october", "november", "december",
)


def parse_lines(lines: DataFrame, text: str = "value") -> DataFrame:
    """Keep lines that begin with an ISO date; ``cells`` holds their tokens without a month name."""
    line = F.trim(F.regexp_replace(F.col(text), r"^\s+|\s+$", ""))
    tokens = F.split(line, r"\s+")
    month_second = (F.size(tokens) > 1) & F.lower(F.get(tokens, F.lit(1))).isin(*MONTHS)
    cells = F.when(
        month_second, F.concat(F.slice(tokens, 1, 1), F.slice(tokens, F.lit(3), F.size(tokens)))
    ).otherwise(tokens)
    blank_to_null = F.transform(cells, lambda c: F.nullif(F.trim(c), F.lit("")))
    return lines.where(line.rlike(STARTS_WITH_DATE)).withColumn("cells", blank_to_null).drop(text)


def is_data_row(cells: Column) -> Column:
    """Exact ISO date first, and at least three further non-blank cells."""
    rest = F.slice(cells, F.lit(2), F.greatest(F.size(cells), F.lit(1)))
    filled = F.size(F.filter(rest, lambda c: c.isNotNull() & (F.trim(c) != "")))
    return F.coalesce(F.get(cells, F.lit(0)).rlike(IS_DATE), F.lit(False)) & (
        filled >= S.MIN_FILLED_CELLS
    )


def layout_of(width: Column) -> Column:
    return F.when(width >= 14, "meteo").when(width >= 10, "annual").otherwise("short")


def detect_layouts(rows: DataFrame, source: str = "source") -> DataFrame:
    """Layout per source from its most frequent width (the narrower one on a tie)."""
    widths = rows.groupBy(source, F.size("cells").alias("width")).agg(F.count(F.lit(1)).alias("n"))
    modal = widths.groupBy(source).agg(
        F.min_by("width", F.struct(-F.col("n"), F.col("width"))).alias("modal_width")
    )
    return modal.withColumn("layout", layout_of(F.col("modal_width")))


def fit_width(cells: Column, width: int) -> Column:
    """Pad with nulls or cut to exactly ``width`` cells."""
    pad = F.array_repeat(F.lit(None).cast("string"), width)
    return F.slice(F.concat(cells, pad), 1, width)


def map_layout(rows: DataFrame, layout: str, keep: Sequence[str] = ()) -> DataFrame:
    """Cells to named text columns; internal columns are dropped."""
    width = S.LAYOUT_WIDTHS[layout]
    fitted = rows.withColumn("cells", fit_width(F.col("cells"), width))
    named = [
        F.get("cells", F.lit(i)).alias(name)
        for i, name in enumerate(S.LAYOUTS[layout])
        if i < width and not name.startswith("_")
    ]
    return fitted.select(*keep, *named)


def recover_rows(lines: DataFrame, source: str = "source", text: str = "value") -> DataFrame:
    """Lines to canonical text columns, each source read with its own layout."""
    rows = parse_lines(lines, text).where(is_data_row(F.col("cells")))
    layouts = materialise(detect_layouts(rows, source).select(source, "layout"), "layouts")
    tagged = rows.join(layouts, source)
    parts = [
        map_layout(tagged.where(F.col("layout") == name), name, keep=[source])
        for name in S.LAYOUTS
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out
