"""Speed limits from ``maxspeed`` texts, by the rules of the street-network tools.

These rules differ from the unit conversion of ``operators.units``: a text is one
limit or several joined by "|", and its parts are averaged.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Implied limits in km/h by zone code.
IMPLICIT_KPH = {
    "AR:rural": 110.0, "AR:urban": 40.0, "AR:urban:primary": 60.0, "AR:urban:secondary": 60.0, "AT:bicycle_road": 30.0, "AT:motorway": 130.0,
    "AT:rural": 100.0, "AT:trunk": 100.0, "AT:urban": 50.0, "BE-BRU:rural": 70.0, "BE-BRU:urban": 30.0, "BE-VLG:rural": 70.0, "BE-VLG:urban": 50.0,
    "BE-WAL:rural": 90.0, "BE-WAL:urban": 50.0, "BE:cyclestreet": 30.0, "BE:living_street": 20.0, "BE:motorway": 120.0, "BE:trunk": 120.0,
    "BE:zone30": 30.0, "BG:living_street": 20.0, "BG:motorway": 140.0, "BG:rural": 90.0, "BG:trunk": 120.0, "BG:urban": 50.0,
    "BY:living_street": 20.0, "BY:motorway": 110.0, "BY:rural": 90.0, "BY:urban": 60.0, "CA-AB:rural": 90.0, "CA-AB:urban": 65.0, "CA-BC:rural": 80.0,
    "CA-BC:urban": 50.0, "CA-MB:rural": 90.0, "CA-MB:urban": 50.0, "CA-ON:rural": 80.0, "CA-ON:urban": 50.0, "CA-QC:motorway": 100.0,
    "CA-QC:rural": 75.0, "CA-QC:urban": 50.0, "CA-SK:nsl": 80.0, "CH:motorway": 120.0, "CH:rural": 80.0, "CH:trunk": 100.0, "CH:urban": 50.0,
    "CZ:living_street": 20.0, "CZ:motorway": 130.0, "CZ:pedestrian_zone": 20.0, "CZ:rural": 90.0, "CZ:trunk": 110.0, "CZ:urban": 50.0,
    "CZ:urban_motorway": 80.0, "CZ:urban_trunk": 80.0, "DE:bicycle_road": 30.0, "DE:living_street": 15.0, "DE:motorway": 120.0, "DE:rural": 80.0,
    "DE:urban": 50.0, "DK:motorway": 130.0, "DK:rural": 80.0, "DK:urban": 50.0, "EE:rural": 90.0, "EE:urban": 50.0, "ES:living_street": 20.0,
    "ES:motorway": 120.0, "ES:rural": 90.0, "ES:trunk": 90.0, "ES:urban": 50.0, "ES:zone30": 30.0, "FI:motorway": 120.0, "FI:rural": 80.0,
    "FI:trunk": 100.0, "FI:urban": 50.0, "FR:motorway": 120.0, "FR:rural": 80.0, "FR:urban": 50.0, "FR:zone30": 30.0, "GB:nsl_restricted": 48.28,
    "GR:motorway": 130.0, "GR:rural": 90.0, "GR:trunk": 110.0, "GR:urban": 50.0, "HU:living_street": 20.0, "HU:motorway": 130.0, "HU:rural": 90.0,
    "HU:trunk": 110.0, "HU:urban": 50.0, "IT:motorway": 130.0, "IT:rural": 90.0, "IT:trunk": 110.0, "IT:urban": 50.0, "JP:express": 100.0,
    "JP:nsl": 60.0, "LT:rural": 90.0, "LT:urban": 50.0, "NO:rural": 80.0, "NO:urban": 50.0, "PH:express": 100.0, "PH:rural": 80.0, "PH:urban": 30.0,
    "PT:motorway": 120.0, "PT:rural": 90.0, "PT:trunk": 100.0, "PT:urban": 50.0, "RO:motorway": 130.0, "RO:rural": 90.0, "RO:trunk": 100.0,
    "RO:urban": 50.0, "RS:living_street": 10.0, "RS:motorway": 130.0, "RS:rural": 80.0, "RS:trunk": 100.0, "RS:urban": 50.0, "RU:living_street": 20.0,
    "RU:motorway": 110.0, "RU:rural": 90.0, "RU:urban": 60.0, "SE:rural": 70.0, "SE:urban": 50.0, "SI:motorway": 130.0, "SI:rural": 90.0,
    "SI:trunk": 110.0, "SI:urban": 50.0, "SK:living_street": 20.0, "SK:motorway": 130.0, "SK:motorway_urban": 90.0, "SK:rural": 90.0,
    "SK:trunk": 90.0, "SK:urban": 50.0, "TR:living_street": 20.0, "TR:motorway": 130.0, "TR:rural": 90.0, "TR:trunk": 110.0, "TR:urban": 50.0,
    "TR:zone30": 30.0, "UA:living_street": 20.0, "UA:motorway": 130.0, "UA:rural": 90.0, "UA:trunk": 110.0, "UA:urban": 50.0, "UK:motorway": 112.65,
    "UK:nsl_dual": 112.65, "UK:nsl_single": 96.56, "UZ:living_street": 30.0, "UZ:motorway": 110.0, "UZ:rural": 100.0, "UZ:urban": 70.0,
}
KPH_PER_MPH = 1.60934  # fixed value
#: Units that may follow a number, with one blank or none before them.
_UNITS = ("km/h", "kmh", "kph", "mph", "knots")


def _limit(part: Column) -> Column:
    """The number that a part starts with, a comma read as a point, if nothing but a unit follows; else null."""
    digits = F.regexp_extract(part, "^[0-9][0-9.,]*", 0)
    rest = F.substring(part, F.length(digits) + 1, F.length(part))
    return F.when(rest.isin("", *_UNITS, *[f" {u}" for u in _UNITS]), F.replace(digits, F.lit(","), F.lit(".")).try_cast("double"))


def clean_maxspeed(text: Column, convert_mph: bool = True, agg: Callable[[Column], Column] | None = None) -> Column:
    """Mean (or ``agg`` over the array) of the parts in km/h; the implied limit of a zone code; null for any other text.

    "mph" anywhere converts all parts; "knots" is read as it stands.
    """
    values = F.transform(F.split(text, r"\|"), _limit)
    good = ~F.exists(values, lambda v: v.isNull())
    one = F.aggregate(values, F.lit(0.0), lambda a, v: a + v) / F.size(values) if agg is None else agg(values)
    factor = F.when(text.contains("mph"), KPH_PER_MPH).otherwise(1.0) if convert_mph else F.lit(1.0)
    implied = F.create_map(*[F.lit(x) for k, v in IMPLICIT_KPH.items() for x in (k, v)])
    return F.when(good, one * factor).otherwise(F.try_element_at(implied, text))


def collapse_maxspeeds(texts: Column, agg: Callable[[Column], Column] | None = None) -> Column:
    """One limit from an array of texts: the mean (or ``agg`` over the array) of those that can be read; null if none can."""
    values = F.filter(F.transform(texts, lambda t: clean_maxspeed(t)), lambda v: v.isNotNull())
    if agg is not None:
        return F.when(F.size(values) > 0, agg(values))
    return F.when(F.size(values) > 0, F.aggregate(values, F.lit(0.0), lambda a, v: a + v) / F.size(values))
