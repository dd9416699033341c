"""How elements map to DataFrame columns.

An *element* is one version of a keyed fact: a key, an ordering (``seq``), core labels that hold for the whole
element, and points. A point has perimeter labels and one number. Two shapes are in use:

* nested: one row per element, points in an ``array<struct<perimeter..., value>>`` column;
* flat: one row per point, as produced by :func:`tallygrid.operators.elements.flatten`.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Layout:
    """Column roles. ``core`` comes before ``perimeter`` in the attribute order."""

    core: tuple[str, ...] = ()
    perimeter: tuple[str, ...] = ()
    key: str = "invariant_key"
    seq: tuple[str, ...] = ("seq",)
    value: str = "value"
    pos: str = "pos"
    points: str = "points"

    @property
    def attributes(self) -> tuple[str, ...]:
        return self.core + self.perimeter

    def position(self, name: str) -> int:
        """Index of an attribute, -1 when there is no such attribute."""
        return self.attributes.index(name) if name in self.attributes else -1

    def is_core(self, name: str) -> bool:
        """True below the core count. An unknown name counts as core, its index being -1."""
        return self.position(name) < len(self.core)

    def is_nested(self, df: DataFrame) -> bool:
        return self.points in df.columns

    def with_(self, **changes) -> Layout:
        return replace(self, **changes)

    def fingerprint(self):
        """A 64-bit hash of the ordered attribute names, as a literal-only Column."""
        return F.xxhash64(*[F.lit(n) for n in self.attributes]) if self.attributes else F.xxhash64(F.lit(""))
