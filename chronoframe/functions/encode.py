"""Season, wind-sector and one-hot encodings over fixed vocabularies.

Vocabularies are fixed so the output schema never depends on the data
(the reference's dummy columns did).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---- fixed values that must match the reference ------------------------------
# month -> season
SEASON_MONTHS = {
    "monsoon": [6, 7, 8, 9],
    "post_monsoon": [10, 11],
    "winter": [12, 1, 2],
}
SEASON_DEFAULT = "summer"
SEASONS = ["monsoon", "post_monsoon", "summer", "winter"]
SEASON_REFERENCE_LEVEL = "monsoon"  # dropped from the one-hot columns
# compass sectors, 45 degrees wide, left-closed, starting at 0
WIND_SECTORS = ["N", "NE", "E", "SE", "S", "SW", "W", "NW"]
# -----------------------------------------------------------------------------


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def season(month_col) -> Column:
    m = _c(month_col)
    expr = None
    for name, months in SEASON_MONTHS.items():
        expr = F.when(m.isin(months), name) if expr is None else expr.when(m.isin(months), name)
    return expr.otherwise(SEASON_DEFAULT)


def season_onehot(df: DataFrame, season_col: str = "season",
                  reference_level: str | None = SEASON_REFERENCE_LEVEL) -> DataFrame:
    """``season_<name>`` int flags; the reference level is left out."""
    cols = {f"season_{s}": (F.col(season_col) == s).cast("int")
            for s in SEASONS if s != reference_level}
    return df.withColumns(cols)


def wind_sector(dir_col) -> Column:
    """Left-closed 45-degree sectors over [0, 360); outside or null -> ``'nan'``."""
    d = _c(dir_col)
    idx = F.floor(d / 45).cast("int") + 1
    inside = (d >= 0) & (d < 360)
    return F.when(inside, F.element_at(F.array(*[F.lit(s) for s in WIND_SECTORS]), idx)).otherwise("nan")


def wind_onehot(df: DataFrame, sector_col: str = "wind_dir_cat", prefix: str = "wdir",
                reference_level: str | None = None, null_level: bool = True) -> DataFrame:
    """Fixed-vocabulary one-hot of the sector.

    ``reference_level='E'`` reproduces ``drop_first`` of the notebook variant;
    ``null_level`` adds ``<prefix>_nan`` for out-of-range or null directions.
    """
    levels = [s for s in WIND_SECTORS if s != reference_level]
    if null_level:
        levels.append("nan")
    return df.withColumns({f"{prefix}_{s}": (F.col(sector_col) == s).cast("int") for s in levels})
