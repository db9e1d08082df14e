"""Rounding and binning that give the same answer on every engine and every rerun."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Share of the last kept digit by which a tie may be off. The order of a distributed sum
# moves its last bit, so an exact half would otherwise round either way from run to run.
_TIE_SLACK = 1e-6


def round_to(c: Column, digits: int) -> Column:
    scale = float(10**digits)
    return F.floor(c * F.lit(scale) + F.lit(0.5 + _TIE_SLACK)) / F.lit(scale)


def ratio(top: Column, bottom: Column) -> Column:
    """Double division; null when the divisor is 0 or null."""
    return top.cast("double") / F.nullif(bottom.cast("double"), F.lit(0.0))


def bin_by_edges(c: Column, edges: Sequence[float]) -> Column:
    """0-based bin of ``c`` among literal edges; the last bin is closed, outside is null."""
    last = len(edges) - 2
    index = None
    for i in range(last + 1):
        upper = c <= F.lit(edges[i + 1]) if i == last else c < F.lit(edges[i + 1])
        hit = (c >= F.lit(edges[i])) & upper
        index = F.when(hit, F.lit(i)) if index is None else index.when(hit, F.lit(i))
    return index


def even_edges(bins: int) -> list[float]:
    """Edges of ``bins`` equal bins on [0, 1], as i * (1 / bins) in floating point."""
    step = 1.0 / bins
    return [i * step for i in range(bins)] + [1.0]
