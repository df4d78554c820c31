"""Way and feature predicates over tag maps."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_ACTIVE = "abandoned|construction|no|planned|platform|proposed|raceway|razed|rest_area|services"
# What each preset asks of a way's tags; {access} is the default access clause.
PRESETS = {
    "drive": '["highway"]["area"!~"yes"]{access}["highway"!~"abandoned|bridleway|bus_guideway|construction|corridor|cycleway|elevator|escalator|footway|no|path|pedestrian|planned|platform|proposed|raceway|razed|rest_area|service|services|steps|track"]["motor_vehicle"!~"no"]["motorcar"!~"no"]["service"!~"alley|driveway|emergency_access|parking|parking_aisle|private"]',
    "drive_service": '["highway"]["area"!~"yes"]{access}["highway"!~"abandoned|bridleway|bus_guideway|construction|corridor|cycleway|elevator|escalator|footway|no|path|pedestrian|planned|platform|proposed|raceway|razed|rest_area|services|steps|track"]["motor_vehicle"!~"no"]["motorcar"!~"no"]["service"!~"emergency_access|parking|parking_aisle|private"]',
    "walk": '["highway"]["area"!~"yes"]{access}["highway"!~"abandoned|bus_guideway|construction|cycleway|motor|no|planned|platform|proposed|raceway|razed|rest_area|services"]["foot"!~"no"]["service"!~"private"]["sidewalk"!~"separate"]["sidewalk:both"!~"separate"]["sidewalk:left"!~"separate"]["sidewalk:right"!~"separate"]',
    "bike": '["highway"]["area"!~"yes"]{access}["highway"!~"abandoned|bus_guideway|construction|corridor|elevator|escalator|footway|motor|no|planned|platform|proposed|raceway|razed|rest_area|services|steps"]["bicycle"!~"no"]["service"!~"private"]',
    "all_public": '["highway"]["area"!~"yes"]{access}["highway"!~"' + _ACTIVE + '"]["service"!~"private"]',
    "all": '["highway"]["area"!~"yes"]["highway"!~"' + _ACTIVE + '"]',
}
DEFAULT_ACCESS = '["access"!~"private"]'
_CLAUSE = re.compile(r'\[\s*"((?:[^"\\]|\\.)*)"\s*(?:(!~|~|!=|=)\s*"((?:[^"\\]|\\.)*)"\s*)?\]')


def network_filter(network_type: str, access: str = DEFAULT_ACCESS) -> str:
    """Clause text of a preset."""
    if network_type not in PRESETS:
        raise ValueError(f"unknown network type {network_type!r}; one of {sorted(PRESETS)}")
    return PRESETS[network_type].format(access=access)


def parse_clauses(text: str) -> list[tuple[str, str | None, str | None]]:
    """``(key, operator, value)`` of each bracket clause."""
    found = [m.groups() for m in _CLAUSE.finditer(text)]
    if not found or _CLAUSE.sub("", text).strip():
        raise ValueError(f"not a list of bracket clauses: {text!r}")
    return found


def clause_predicate(text: str, tags: str = "tags") -> Column:
    """All clauses hold. A pattern matches anywhere in the value; a negated one also holds where the key is absent."""
    tests = []
    for key, op, value in parse_clauses(text):
        tag = F.col(tags)[key]
        tests.append({None: lambda: tag.isNotNull(), "=": lambda: F.coalesce(tag == value, F.lit(False)),
                      "!=": lambda: F.coalesce(tag != value, F.lit(True)),
                      "~": lambda: F.coalesce(tag.rlike(value), F.lit(False)),
                      "!~": lambda: ~F.coalesce(tag.rlike(value), F.lit(False))}[op]())
    return reduce(lambda a, b: a & b, tests)


def way_predicate(network_type: str = "all", custom_filter: str | list[str] | None = None, access: str = DEFAULT_ACCESS, tags: str = "tags") -> Column:
    """A preset, or custom clauses; a list of custom filters is a union."""
    filters = [network_filter(network_type, access)] if custom_filter is None else [custom_filter] if isinstance(custom_filter, str) else custom_filter
    return reduce(lambda a, b: a | b, [clause_predicate(f, tags) for f in filters])


def tag_predicate(query: dict[str, bool | str | list[str]], tags: str = "tags") -> Column:
    """Any of the tags fits: true means present, a text means equal, a list means one of; false fits nothing."""
    tests = [F.lit(False)]
    for key, wanted in query.items():
        tag = F.col(tags)[key]
        if wanted is True:
            tests.append(tag.isNotNull())
        elif isinstance(wanted, str):
            tests.append(F.coalesce(tag == wanted, F.lit(False)))
        elif isinstance(wanted, (list, tuple, set)):
            tests.append(F.coalesce(tag.isin(*wanted), F.lit(False)))
        elif wanted is not False:
            raise TypeError(f"tag {key!r} must be true, false, text or a list of texts")
    return reduce(lambda a, b: a | b, tests)
