"""Where cubes come from and go to: table catalogues, STAC items, GeoJSON, and result files."""

from .collection import CollectionLoader, ParquetCollectionLoader, load_collection, resolve_bands
from .geojson import GeoJsonLoader, load_geojson
from .sink import save_result
from .stac import StacLoader, load_stac

__all__ = ["CollectionLoader", "GeoJsonLoader", "ParquetCollectionLoader", "StacLoader", "load_collection", "load_geojson", "load_stac", "resolve_bands", "save_result"]
