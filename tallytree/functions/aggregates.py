"""Aggregates that exogenous columns may ask for by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BY_NAME: dict[str, Callable[[Column], Column]] = {
    "sum": F.sum,
    "mean": F.avg,
    "min": F.min,
    "max": F.max,
    "std": F.stddev_samp,
    "var": F.var_samp,
    "median": F.median,
    "count": F.count,
    "n_unique": F.count_distinct,
}


def exogenous(spec: dict[str, str | list[str]] | None, columns: list[str]) -> list[Column]:
    """One column ``<name>_<function>`` for each function asked for."""
    found = []
    for name, functions in (spec or {}).items():
        if name not in columns:
            raise ValueError(f"The exogenous column {name!r} is not in the frame.")
        if not isinstance(functions, str | list):
            raise ValueError(f"The functions of {name!r} must be a name or a list of names.")
        for f in [functions] if isinstance(functions, str) else functions:
            if f not in BY_NAME:
                raise ValueError(f"Unknown aggregate {f!r}; known are {sorted(BY_NAME)}.")
            found.append(BY_NAME[f](F.col(f"`{name}`")).alias(f"{name}_{f}"))
    return found
