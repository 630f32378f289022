"""Descriptions of the processes."""

from __future__ import annotations

_SPECS = {
    "aggregate_spatial": ("Reduce space, whole or by zones", "data geometries? reducer?", "aggregate cubes", ""),
    "aggregate_temporal_period": ("Reduce values by calendar periods", "data period reducer dimension?", "aggregate cubes", "DimensionNotAvailable"),
    "apply": ("Apply a function to each value", "data process context?", "cubes", ""),
    "apply_kernel": ("Convolve slices with a kernel", "data kernel factor? border? replace_invalid?", "cubes math", "KernelDimensionsUneven"),
    "array_element": ("Pick an element of an array", "data index? label? return_nodata?", "arrays reducer", "ArrayElementNotAvailable ArrayElementParameterMissing ArrayElementParameterConflict ArrayNotLabeled"),
    "array_interpolate_linear": ("Fill gaps between known values", "data dimension?", "arrays math", "DimensionNotAvailable"),
    "cloud_detection": ("Find clouds in optical images", "data method? options?", "cubes optical", ""),
    "drop_dimension": ("Remove a dimension of one label", "data name", "cubes", "DimensionLabelCountMismatch DimensionNotAvailable"),
    "eq": ("Whether two values are the same", "x y delta? case_sensitive?", "comparison texts", ""),
    "filter_bbox": ("Keep what lies in a box", "data west south east north", "cubes filter", ""),
    "filter_temporal": ("Keep a closed interval of time", "data extent dimension?", "cubes filter", "DimensionNotAvailable"),
    "filter_vector": ("Keep features by a relation to polygons", "data geometries relation?", "cubes filter vector", ""),
    "load_collection": ("Open a collection of cells", "id spatial_extent temporal_extent bands? properties?", "cubes import", ""),
    "load_geojson": ("Open GeoJSON as a vector cube", "data crs?", "import vector", ""),
    "load_stac": ("Open tables that STAC items name", "url spatial_extent? temporal_extent? assets?", "cubes import", ""),
    "load_stac_ml": ("Open a saved model", "uri model_asset? input_index? output_index?", "machine-learning import", ""),
    "mask": ("Replace cells by another cube's say", "data mask replacement?", "cubes masks", "IncompatibleDataCubes"),
    "mask_polygon": ("Replace cells outside or inside polygons", "data mask replacement? inside?", "cubes masks", ""),
    "median": ("The middle of an array's numbers", "data ignore_nodata?", "math reducer", ""),
    "ml_fit": ("Train a model", "model training_set target", "machine-learning", ""),
    "ml_predict": ("Predict with a model", "data model", "machine-learning", ""),
    "mlm_class_lighttae": ("A light attention encoder for series", "epochs? batch_size? optimizer? learning_rate? epsilon? weight_decay? lr_decay_epochs? lr_decay_rate? seed?", "machine-learning", ""),
    "mlm_class_random_forest": ("A forest of decision trees", "max_variables num_trees? seed?", "machine-learning", ""),
    "mlm_class_tempcnn": ("A convolutional network over series", "cnn_layers cnn_kernels cnn_dropout_rates dense_layer_nodes dense_layer_dropout_rate epochs? batch_size? optimizer? learning_rate? seed?", "machine-learning", ""),
    "mlm_class_xgboost": ("Boosted decision trees", "learning_rate? max_depth? min_child_weight? subsample? min_split_loss? seed?", "machine-learning", ""),
    "mlm_regr_random_forest": ("A forest of regression trees", "max_variables num_trees? seed?", "machine-learning", ""),
    "ndvi": ("The vegetation index of two bands", "data nir? red? target_band?", "cubes indices", "NirBandAmbiguous RedBandAmbiguous DimensionAmbiguous BandExists"),
    "or": ("Disjunction with three values", "x y", "logic", ""),
    "reduce_dimension": ("Reduce a dimension to one value", "data reducer dimension context?", "cubes reducer", "DimensionNotAvailable"),
    "resample_spatial": ("Change resolution or projection", "data resolution? projection? method? align?", "cubes reproject", ""),
    "save_ml_model": ("Store a model with its metadata", "data name options?", "machine-learning export", ""),
    "save_result": ("Write a cube", "data format options?", "cubes export", ""),
    "vector_buffer": ("Grow or shrink geometries", "geometries distance", "vector", "UnitMismatch"),
    "vector_reproject": ("Change geometries' coordinate system", "data projection dimension?", "vector reproject", "DimensionNotAvailable"),
}


class ProcessRegistry:
    """Descriptions by id."""

    def __init__(self):
        self._specs = {
            k: {
                "id": k,
                "description": d,
                "parameters": [{"name": p.rstrip("?"), "optional": p.endswith("?")} for p in params.split()],
                "categories": cats.split(),
                "exceptions": errors.split(),
            }
            for k, (d, params, cats, errors) in _SPECS.items()
        }

    def list_processes(self) -> list[str]:
        return sorted(self._specs)

    def get_process(self, name: str) -> dict:
        if name not in self._specs:
            raise KeyError(f"no process {name!r}")
        return self._specs[name]

    def search(self, text: str) -> list[dict]:
        t = text.lower()
        return [s for k, s in sorted(self._specs.items()) if t in k.lower() or t in s["description"].lower()]
