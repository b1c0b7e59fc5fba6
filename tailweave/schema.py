"""Canonical relations and the checks made before a plan is built."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T


def _struct(text: str) -> T.StructType:
    return T.StructType([T.StructField(n, T._parse_datatype_string(k)) for n, k in (x.split(" ", 1) for x in text.split(", "))])


#: relation: columns in order.
RELATIONS = {
    "cube": "t bigint, cell bigint, value double",
    "grid": "cell bigint, i bigint, j bigint, lat double, lon double, is_land boolean",
    "dates": "t bigint, date string",
    "ecdf": "t bigint, cell bigint, u double",
    "edge": "i bigint, j bigint, hits bigint, n bigint, chi double",
    "top_neighbor": "i bigint, j bigint, chi double",
    "path": "i bigint, u double, v double, max_chi double",
    "combo": "station bigint, path array<bigint>, hits bigint, chi double",
    "puzzle": "t bigint, cell bigint, x array<double>, y double",
    "forecast": "cell bigint, t bigint, y_true double, y_pred double",
}


def require(df: DataFrame, relation: str) -> DataFrame:
    """Fail early if a canonical column is missing or of another kind."""
    have = dict(df.dtypes)
    for column in RELATIONS[relation].split(", "):
        name, kind = column.split(" ", 1)
        if name not in have or have[name] != kind:
            raise ValueError(f"{relation} needs {name} {kind}, found {have.get(name, 'nothing')}")
    return df


def check_lag(lag: int) -> None:
    if lag <= 0:
        raise ValueError("lag must be positive")


def check_share(p: float) -> None:
    if not 0 < p < 1:
        raise ValueError("a percentile threshold lies between 0 and 1")


def check_percent(p: float) -> None:
    if not 0 <= p <= 100:
        raise ValueError("a sampling percentile lies between 0 and 100")


def check_lags(lags: list[int], d: int) -> None:
    if len(lags) < d - 1:
        raise ValueError(f"{d} nodes need {d - 1} lags, found {len(lags)}")
    if any(x < 0 for x in lags):
        raise ValueError("lags are not negative")


def window_length(start: int, end: int, used: int) -> int:
    """Steps left of [start, end) after lags of ``used`` in all."""
    n = end - start - used
    if n <= 0:
        raise ValueError(f"the window [{start}, {end}) is too short for lags of {used}")
    return n
