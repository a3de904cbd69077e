"""Score bands: numeric score to a level name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from terrascore.functions.cleaning import ColumnOrName, _col

# Lower bound of each level, best first; the last name is the rest.
FIVE_BANDS = ((80, "Excellent"), (60, "Bon"), (40, "Moyen"), (20, "Faible"))
SIX_BANDS = ((80, "Excellent"), (70, "Bon"), (60, "Modéré"), (50, "À améliorer"), (40, "Insuffisant"))
LOWEST = "Critique"
# Limits of the three counters of a score sheet.
CRITICAL_BELOW, GOOD_FROM = 40, 70


def band(score: ColumnOrName, bands=FIVE_BANDS, lowest: str = LOWEST) -> Column:
    """Name of the first band whose bound the score reaches."""
    (bound, name), *rest = bands
    expr = F.when(_col(score) >= bound, name)
    for bound, name in rest:
        expr = expr.when(_col(score) >= bound, name)
    return expr.otherwise(lowest)
