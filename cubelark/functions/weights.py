"""Weights of grid cells."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def cosine_weight(y: Column) -> Column:
    """Cosine of the latitude."""
    return F.cos(F.radians(y))


def bounds(centres: np.ndarray, low: float | None = None, high: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Cell edges half-way between neighbouring centres, clipped."""
    centres = np.asarray(centres, float)
    if len(centres) == 1:
        edges = np.array([centres[0] - 0.5, centres[0] + 0.5])
    else:
        middle = (centres[1:] + centres[:-1]) / 2
        edges = np.r_[2 * centres[0] - middle[0], middle, 2 * centres[-1] - middle[-1]]
    edges = np.clip(edges, low, high) if low is not None or high is not None else edges
    return edges[:-1], edges[1:]


def area_weight(y: Column, y_low: Column, y_high: Column, x_low: Column, x_high: Column) -> Column:
    """Area on the sphere between the edges of a cell, up to a factor."""
    return (F.sin(F.radians(y_high)) - F.sin(F.radians(y_low))) * (x_high - x_low)
