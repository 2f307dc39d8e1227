"""Reading of the two skew measures (documented bands; each is closed on the right)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Upper edges of the bands.
CV_BANDS = [(0.2, "Excellent"), (0.5, "Acceptable"), (1.0, "High skew")]
PAR_BANDS = [(1.0, "Balanced"), (1.1, "Safe margin"), (1.5, "Bottleneck")]


def _band(value: Column, bands: list, beyond: str) -> Column:
    result = None
    for edge, name in bands:
        hit = value <= edge
        result = F.when(hit, name) if result is None else result.when(hit, name)
    return result.otherwise(beyond)


def cv_band(cv: Column) -> Column:
    return _band(cv, CV_BANDS, "Critical skew")


def par_band(par: Column) -> Column:
    return _band(par, PAR_BANDS, "Severe hotspot")


def skew_diagnosis(cv: Column, par: Column) -> Column:
    """Both measures together. The source gives examples, not limits: we call a Cv up to
    0.5 low, and a PAR above 2.0 high."""
    spread_out = cv > 0.5
    return (
        F.when(spread_out, "Widespread skew")
        .when(par > 2.0, "Localized hotspot")
        .otherwise("Ideal")
    )
