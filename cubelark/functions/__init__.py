"""Column functions: calendar fields, weights and null-safe arithmetic."""

from cubelark.functions.calendar import bin_item, cycle_bin, season, season_year
from cubelark.functions.combine import OPERATIONS, combine, fold
from cubelark.functions.weights import area_weight, cosine_weight

__all__ = ["OPERATIONS", "area_weight", "bin_item", "combine", "cosine_weight", "cycle_bin", "fold", "season", "season_year"]
