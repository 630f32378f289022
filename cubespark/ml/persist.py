"""Models as files: the estimator, and a STAC item beside it."""

from __future__ import annotations

import importlib
import json
import os
import pickle

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException

from .metadata import MLModel
from .nets import NetClassifier

DIMENSION, CLASSES = "cube:dimension", "cube:classes"


def save_ml_model(model: MLModel, name: str, options: dict | None = None) -> bool:
    """Writes ``<directory>/<name>/model`` and ``<directory>/<name>.stac.json``; whether that worked."""
    try:
        if not model.trained:
            return False
        folder = (options or {}).get("directory", ".")
        os.makedirs(os.path.join(folder, name), exist_ok=True)
        path = os.path.join(folder, name, "model")
        if isinstance(model.fitted, NetClassifier):
            path += ".pkl"
            with open(path, "wb") as f:
                pickle.dump(model.fitted, f)
        else:
            model.fitted.write().overwrite().save("file:" + os.path.abspath(path))
        item = model.to_stac_item(name, f"./{name}/{os.path.basename(path)}")
        item["properties"] |= {DIMENSION: model.dimension, CLASSES: model.classes}
        with open(os.path.join(folder, f"{name}.stac.json"), "w") as f:
            json.dump(item, f, indent=1)
        return True
    except (OSError, pickle.PicklingError, Py4JError, PySparkException):  # the contract is a flag where it cannot be written
        return False


def _load(href: str, framework: str):
    if framework == "numpy":
        with open(href, "rb") as f:
            return pickle.load(f)
    from pyspark.ml.util import DefaultParamsReader
    from pyspark.sql import SparkSession

    path = "file:" + os.path.abspath(href)
    meta = DefaultParamsReader.loadMetadata(path, SparkSession.builder.getOrCreate())
    module, _, kind = meta["class"].replace("org.apache.spark", "pyspark").rpartition(".")
    return getattr(importlib.import_module(module), kind).load(path)


def load_stac_ml(uri: str, *, model_asset: str | None = None, input_index: int = 0, output_index: int = 0) -> MLModel:
    """The model of a STAC item: of its one asset with the role, or of the asset named."""
    with open(uri) as f:
        item = json.load(f)
    assets = {k: a for k, a in item.get("assets", {}).items() if "mlm:model" in a.get("roles", [])}
    if model_asset is not None:
        if model_asset not in assets:
            raise ValueError(f"no model asset {model_asset!r}; there are {sorted(assets)}")
        asset = assets[model_asset]
    elif len(assets) != 1:
        raise ValueError(f"one asset with the role mlm:model is needed, or its name; there are {sorted(assets)}")
    else:
        asset = next(iter(assets.values()))
    p = item["properties"]
    m = MLModel.from_stac_properties(p)
    href = asset["href"]
    m.fitted = _load(href if os.path.isabs(href) else os.path.join(os.path.dirname(uri), href), m.framework)
    m.dimension, m.classes = p.get(DIMENSION, ["bands"]), p.get(CLASSES)
    if not m.inputs or not 0 <= input_index < len(m.inputs) or not 0 <= output_index < len(m.outputs):
        raise ValueError("the item has no such input or output")
    m.feature_names = m.inputs[input_index].bands
    m.bbox = item.get("bbox")
    return m
