"""Value objects and errors shared by all operators.

A graph is two DataFrames and a small dict. ``nodes`` is keyed by ``osmid``,
``edges`` by ``(u, v, key)``; nothing is ever held as Python objects per row.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame

EARTH_RADIUS_M = 6_371_009.0

#: Tag names promoted to columns when elements are read (fixed values).
NODE_TAGS = ("highway", "junction", "railway", "ref")
WAY_TAGS = ("access", "area", "bridge", "est_width", "highway", "junction", "landuse", "lanes",
            "maxspeed", "name", "oneway", "ref", "service", "tunnel", "width")


class ValidationError(ValueError):
    """Input breaks a rule that an operator relies on."""


class GraphSimplificationError(ValueError):
    """A graph was to be simplified or consolidated twice."""


class InsufficientResponseError(ValueError):
    """A source held no row for the request."""


class ResponseStatusCodeError(ValueError):
    """A stored answer carries a failing status."""


@dataclass(frozen=True)
class Settings:
    """Options an operator gets passed; executors never see module globals."""

    all_oneway: bool = False
    bidirectional_network_types: tuple[str, ...] = ("walk",)
    default_access: str = '["access"!~"private"]'
    requests_timeout: int = 180
    overpass_memory: int | None = None


@dataclass(frozen=True)
class StreetGraph:
    """``nodes(osmid, x, y, ...)``, ``edges(u, v, key, length, ...)`` and graph attributes."""

    nodes: DataFrame
    edges: DataFrame
    attrs: dict[str, Any] = field(default_factory=lambda: {"crs": 4326})

    def with_(self, **changes: Any) -> "StreetGraph":
        return replace(self, **changes)

    @property
    def projected(self) -> bool:
        return self.attrs.get("crs", 4326) != 4326
