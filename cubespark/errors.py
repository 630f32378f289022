"""Exceptions that cube operators raise while a plan is built."""


class CubeError(Exception):
    """Base of the named exceptions."""


class NirBandAmbiguous(CubeError):
    """The near-infrared band cannot be told."""


class RedBandAmbiguous(CubeError):
    """The red band cannot be told."""


class DimensionAmbiguous(CubeError):
    """No dimension holds bands."""


class BandExists(CubeError):
    """A band of the target's name is there already."""


class DimensionNotAvailable(CubeError):
    """The cube has no such dimension."""


class DimensionLabelCountMismatch(CubeError):
    """The dimension has more or fewer than one label."""


class ArrayElementNotAvailable(CubeError):
    """The array has no such element."""


class ArrayElementParameterMissing(CubeError):
    """Neither an index nor a label is given."""


class ArrayElementParameterConflict(CubeError):
    """Both an index and a label are given."""


class ArrayNotLabeled(CubeError):
    """The array has no labels."""


class UnitMismatch(CubeError):
    """The unit of the coordinates does not fit the operation."""


class IncompatibleDataCubes(CubeError):
    """Two cubes cannot be combined."""


class KernelDimensionsUneven(CubeError):
    """A kernel needs an odd number of rows and of columns."""
