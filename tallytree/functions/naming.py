"""Names of output columns."""

from __future__ import annotations

import re

INTERVAL = re.compile(r"-(lo|hi)-\d+(\.\d+)?$|-median$")


def is_model(column: str) -> bool:
    """Whether a column holds a model's forecasts and not an interval bound."""
    return not INTERVAL.search(column)


def tick(column: str) -> str:
    return f"`{column.replace('`', '``')}`"


def method_name(kind: str, parameters: dict[str, object]) -> str:
    """``Kind_parameter-value…``; nonnegative shows only when true."""
    shown = [f"{k}-{v}" for k, v in parameters.items() if not (k == "nonnegative" and not v)]
    return "_".join([kind, *shown])


def level_quantiles(levels: list[float]) -> list[float]:
    """The two quantiles of each central level, ascending."""
    return sorted(q for x in levels for q in ((100 - x) / 200, 1 - (100 - x) / 200))


def written(level: float) -> str:
    return str(int(level)) if float(level).is_integer() else str(level)


def level_outputs(levels: list[float]) -> tuple[list[float], list[str]]:
    """Quantiles and name endings: the median, then lower bounds from the widest, then upper ones."""
    levels = sorted(levels)
    lower = [((100 - x) / 200, f"-lo-{written(x)}") for x in reversed(levels)]
    upper = [(1 - (100 - x) / 200, f"-hi-{written(x)}") for x in levels]
    every = [(0.5, "-median"), *lower, *upper]
    return [q for q, _ in every], [n for _, n in every]


def quantile_outputs(quantiles: list[float]) -> tuple[list[float], list[str]]:
    """Quantiles ascending and the endings of the levels whose bounds they are."""
    names = []
    for q in sorted(quantiles):
        if q < 0.5:
            names.append(f"-lo-{written(round(100 - 200 * q, 2))}")
        elif q > 0.5:
            names.append(f"-hi-{written(round(100 - 200 * (1 - q), 2))}")
        else:
            names.append("-median")
    return sorted(quantiles), names
