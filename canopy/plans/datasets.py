"""Dataset preparations (D1-D4) and the training-table load.

Each preparation is a function DataFrame -> DataFrame; writing is left to the
caller (``sources.sinks.write_processed``).  Column names are parameters with
the reference datasets' names as defaults, so the same plan runs on the local
stand-in tables.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import (col, fill_null, first_token_lower, lookup_keep, lookup_null,
                                ratio_pct, try_numeric)
from ..operators.clean import replace_rare
from ..operators.folds import assign_folds

# ---- Fixed values (must equal the reference's for the same results) --------
N_FOLDS = 6            # folds 1..5 for cross-validation, fold 6 held out as test
FOLD_SEED = 42
# Auto MPG: manufacturer spelling fixes, applied to the lower-cased first word.
MANUFACTURER_MAP = {
    "chevy": "chevrolet",
    "chevroelt": "chevrolet",
    "toyouta": "toyota",
    "vokswagen": "volkswagen",
    "vw": "volkswagen",
    "maxda": "mazda",
    "hi": "bmw",
}
RARE_MANUFACTURER_THRESHOLD = 10
# Ames: kept as is, turned into percent of living area, kept unconstrained.
AMES_KEEP = ["GrLivArea", "LotArea"]
AMES_RATIO = ["1stFlrSF", "TotalBsmtSF", "GarageArea", "WoodDeckSF", "OpenPorchSF"]
AMES_UNCONSTRAINED = ["YearBuilt", "FullBath", "Fireplaces", "OverallQual", "OverallCond",
                      "ExterQual", "KitchenQual", "BsmtQual"]
AMES_DENOMINATOR = "GrLivArea"
QUALITY_MAP = {"Po": 1, "Fa": 2, "TA": 3, "Gd": 4, "Ex": 5}
BSMT_QUALITY_MAP = {"NA": 0, "Po": 1, "Fa": 2, "TA": 3, "Gd": 4, "Ex": 5}
AMES_QUALITY_COLS = ["ExterQual", "KitchenQual"]
AMES_BSMT_COL = "BsmtQual"
CALIFORNIA_CAP = 500000
# ---------------------------------------------------------------------------


def prepare_simple(df: DataFrame, target: str, key: str, n_folds: int = N_FOLDS,
                   seed: int = FOLD_SEED) -> DataFrame:
    """Folds stratified by target quantiles."""
    return assign_folds(df, key, n_folds, seed, stratify_col=target)


def prepare_auto_mpg(df: DataFrame, key: str, car_col: str = "car_name",
                     hp_col: str = "horsepower", name_map: Mapping[str, str] = MANUFACTURER_MAP,
                     rare_threshold: int = RARE_MANUFACTURER_THRESHOLD,
                     n_folds: int = N_FOLDS, seed: int = FOLD_SEED) -> DataFrame:
    """Manufacturer from the car name (F1), spelling fixes (J2), rare
    manufacturers to 'other' (A1, A2, J1), drop the name (P4), lenient
    horsepower (F2), folds stratified by manufacturer (W3)."""
    out = df.withColumn("manufacturer", lookup_keep(first_token_lower(car_col), name_map))
    out = replace_rare(out, "manufacturer", rare_threshold)
    out = out.drop(car_col).withColumn(hp_col, try_numeric(hp_col))
    return assign_folds(out, key, n_folds, seed, stratify_col="manufacturer")


def prepare_ames(df: DataFrame, key: str, target: str = "SalePrice",
                 keep: Sequence[str] = AMES_KEEP, ratio: Sequence[str] = AMES_RATIO,
                 denominator: str = AMES_DENOMINATOR,
                 unconstrained: Sequence[str] = AMES_UNCONSTRAINED,
                 quality_cols: Sequence[str] = AMES_QUALITY_COLS,
                 bsmt_col: str | None = AMES_BSMT_COL,
                 n_folds: int = N_FOLDS, seed: int = FOLD_SEED) -> DataFrame:
    """D3: ratio features for present columns (P7, F3), ordinal codes (J3;
    F4 then J3 for the basement column), explicit projection (P3), folds."""
    present = set(df.columns)
    out = df
    ratio_cols = []
    for v in ratio:
        if v in present:
            out = out.withColumn(f"{v}_ratio", ratio_pct(v, denominator))
            ratio_cols.append(f"{v}_ratio")
    for q in quality_cols:
        if q in present:
            out = out.withColumn(q, lookup_null(q, QUALITY_MAP, "int"))
    if bsmt_col and bsmt_col in present:
        out = out.withColumn(bsmt_col, lookup_null(fill_null(bsmt_col, "NA"), BSMT_QUALITY_MAP, "int"))
    final = [c for c in [*keep, *ratio_cols, *unconstrained, target] if c in out.columns]
    out = out.select(key, *[col(c).alias(c) for c in final if c != key])
    return assign_folds(out, key, n_folds, seed, stratify_col=target)


def prepare_california(df: DataFrame, key: str, target: str = "median_house_value",
                       cap: float = CALIFORNIA_CAP, n_folds: int = N_FOLDS,
                       seed: int = FOLD_SEED) -> DataFrame:
    """Drop censored targets (P5: keep target <= cap), then folds."""
    return assign_folds(df.where(col(target) <= F.lit(cap)), key, n_folds, seed, stratify_col=target)


def prepare_all(loaders: Mapping[str, Callable[[], DataFrame]],
                write: Callable[[str, DataFrame], None]) -> list[tuple[str, str, str | None]]:
    """Prepares and writes every dataset in the order given; one that fails is
    recorded, not raised.  Returns (dataset, status, error)."""
    status = []
    for name, load in loaders.items():
        try:
            write(name, load())
            status.append((name, "ok", None))
        except Exception as e:  # noqa: BLE001 - isolate one dataset's failure
            status.append((name, "failed", f"{type(e).__name__}: {e}"[:500]))
    return status
