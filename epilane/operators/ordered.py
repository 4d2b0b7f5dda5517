"""Running aggregates along a genome-like axis.

A window over one chromosome sorts the whole chromosome in one task. Here each
group is cut into tiles of the order axis: a window runs inside each tile, one row
of totals per tile is accumulated over the earlier tiles, and both are combined.
The largest sort is one tile; the totals hold one row per tile.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# One tile spans this many positions of the axis.
TILE = 1 << 18

_FOLD = {
    "sum": (F.sum, lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))),
    "max": (F.max, lambda a, b: F.greatest(a, b)),
    "min": (F.min, lambda a, b: F.least(a, b)),
}


def running(
    df: DataFrame,
    group: list[str],
    order: list[str],
    aggs: dict[str, tuple[str, Column]],
    tile: Column | None = None,
    inclusive: bool = True,
) -> DataFrame:
    """Add running aggregates over ``order`` within ``group``.

    ``aggs`` maps a new column to (``sum``, ``max`` or ``min``, input column).
    ``tile`` must not decrease along ``order``; rows with equal order keys must be
    unique if their sequence matters. ``inclusive=False`` leaves out the row itself.
    """
    if tile is None:
        tile = F.floor(F.col(order[0]) / TILE)
    tiled = df.withColumn("_tile", tile)
    keys = [*group, "_tile"]
    inside = W.partitionBy(*keys).orderBy(*order).rowsBetween(
        W.unboundedPreceding, 0 if inclusive else -1
    )
    earlier = W.partitionBy(*group).orderBy("_tile").rowsBetween(W.unboundedPreceding, -1)

    totals = tiled.groupBy(*keys).agg(
        *[_FOLD[kind][0](col).alias(f"_t_{name}") for name, (kind, col) in aggs.items()]
    )
    carried = totals.select(
        *keys,
        *[
            _FOLD[kind][0](f"_t_{name}").over(earlier).alias(f"_c_{name}")
            for name, (kind, _) in aggs.items()
        ],
    )
    # Tiles with nothing before them need no carry; with many small groups that is
    # nearly all of them.
    carried = carried.filter(
        reduce(or_, [F.col(f"_c_{name}").isNotNull() for name in aggs])
    )
    local = tiled.withColumns(
        {f"_l_{name}": _FOLD[kind][0](col).over(inside) for name, (kind, col) in aggs.items()}
    )
    merged = local.join(carried, keys, "left")
    return merged.select(
        *df.columns,
        *[
            _FOLD[kind][1](F.col(f"_l_{name}"), F.col(f"_c_{name}")).alias(name)
            for name, (kind, _) in aggs.items()
        ],
    )


def exact_quantiles(
    df: DataFrame, group: str, value: str, probabilities: list[float], ranges: int = 4096
) -> dict[str, list[float]]:
    """Quantiles of ``value`` per ``group``, interpolated between ranks like ``percentile``.

    No task gathers a group: values are counted in ``ranges`` equal ranges, then only the
    range that holds a rank is counted in finer ones, until it holds one value. Each step
    is one grouped count; the driver sees up to ``ranges`` rows for each rank sought, so
    groups must be few. Nulls, NaN and infinite values are left out; a group without values
    is missing.
    """
    data = df.select(F.col(group).alias("g"), F.col(value).cast("double").alias("v")).filter(
        F.col("g").isNotNull() & F.col("v").isNotNull() & ~F.isnan("v") & (F.abs("v") < float("inf"))
    )
    sizes = {
        r["g"]: r for r in data.groupBy("g").agg(F.count("v").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()
    }
    places = {g: [p * (r["n"] - 1) for p in probabilities] for g, r in sizes.items()}
    # (group, rank) to (low, high, values below low) until low and high are one value.
    open_ = {
        (g, k): (sizes[g]["lo"], sizes[g]["hi"], 0)
        for g, at in places.items()
        for k in {f(x) for x in at for f in (math.floor, math.ceil)}
    }
    known = {}
    while open_:
        for key in [key for key, (lo, hi, _) in open_.items() if lo == hi]:
            known[key] = open_.pop(key)[0]
        if not open_:
            break
        spans = sorted({(g, lo, hi) for (g, _), (lo, hi, _) in open_.items()})
        table = F.broadcast(  # a row for each rank sought at most
            df.sparkSession.createDataFrame(
                [(i, g, lo, hi) for i, (g, lo, hi) in enumerate(spans)], f"span int, g {dict(data.dtypes)['g']}, lo double, hi double"
            )
        )
        # Halves keep the width finite; rounding is monotone, so ranges keep the order.
        part = F.floor((F.col("v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2) * ranges)
        counted = (
            data.join(table, "g")
            .filter("v between lo and hi")
            .groupBy("span", F.least(part, F.lit(ranges - 1)).alias("part"))
            .agg(F.count("v").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
            .collect()
        )
        by_span = {}
        for r in sorted(counted, key=lambda r: (r["span"], r["part"])):
            by_span.setdefault(spans[r["span"]], []).append(r)
        for (g, k), (lo, hi, below) in list(open_.items()):
            for r in by_span[g, lo, hi]:
                if k < below + r["n"]:
                    open_[g, k] = (r["lo"], r["hi"], below)
                    break
                below += r["n"]
    out = {}
    for g, at in places.items():
        out[g] = []
        for x in at:
            low, high = math.floor(x), math.ceil(x)
            a, b = known[g, low], known[g, high]
            out[g].append(a if a == b else (high - x) * a + (x - low) * b)
    return out
