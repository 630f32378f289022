"""What is known of a cube besides its rows."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from .errors import DimensionNotAvailable

ROLES = ("temporal", "bands", "x", "y", "geometry", "other")


@dataclass(frozen=True)
class Dim:
    """A dimension: the column's name, its role, and its labels in order where they are known."""

    name: str
    role: str = "other"
    labels: tuple | None = None


@dataclass(frozen=True)
class CubeSchema:
    """Dimensions in order, the column of values, the coordinate system, and the cube's kind."""

    dims: tuple[Dim, ...] = ()
    value: str = "value"
    crs: str | None = None
    kind: str = "raster"
    geometry: tuple[str, ...] = field(default=())

    @property
    def names(self) -> list[str]:
        return [d.name for d in self.dims]

    def dim(self, name: str) -> Dim:
        for d in self.dims:
            if d.name == name:
                return d
        raise DimensionNotAvailable(f"no dimension {name!r}; there are {self.names}")

    def others(self, *names: str) -> list[str]:
        return [n for n in self.names if n not in names]

    def without(self, *names: str) -> CubeSchema:
        return replace(self, dims=tuple(d for d in self.dims if d.name not in names))

    def with_dim(self, dim: Dim) -> CubeSchema:
        """The same with a dimension replaced, or added as the last."""
        if dim.name in self.names:
            return replace(self, dims=tuple(dim if d.name == dim.name else d for d in self.dims))
        return replace(self, dims=(*self.dims, dim))
