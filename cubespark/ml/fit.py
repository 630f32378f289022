"""Training and prediction."""

from __future__ import annotations

import copy
import dataclasses
import warnings
from array import array
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..cube import DataCube
from ..functions import geometry as G
from ..operators.reshape import stack_to_samples
from ..schema import Dim
from .metadata import MLModel, ModelInput, ModelOutput, Structure
from .nets import NetClassifier, StoredRows

#: Rows that a network, which is trained on the driver, is given at most; forests train on the cluster.
NET_ROWS = 2_000_000


def ml_fit(model: MLModel, training_set, target: str) -> MLModel:
    """A trained copy; the model given is not changed.

    Features: the numeric columns but the target, in order.  Rows with a missing feature or target are left out.
    """
    if not isinstance(training_set, DataCube) or not training_set.is_vector:
        raise TypeError("a vector cube is needed as training set")
    df = training_set.df
    if target not in df.columns:
        raise ValueError(f"no column {target!r}; there are {df.columns}")
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name != target]
    if not names:
        raise ValueError("no numeric column to learn from")
    rows = df.select(F.array(*[F.col(f"`{n}`").cast("double") for n in names]).alias("x"), F.col(f"`{target}`").alias("y"))
    rows = rows.where(F.col("y").isNotNull() & ~F.exists("x", lambda v: v.isNull() | F.isnan(v)))
    classes = None
    if "classification" in model.tasks:
        classes = sorted(r[0] for r in rows.select("y").distinct().collect())
    if isinstance(model.estimator, NetClassifier):
        if rows.count() > NET_ROWS:
            raise ValueError(f"a network is trained on at most {NET_ROWS} rows")
        fitted = copy.deepcopy(model.estimator).fit(*_stored(rows, len(names), classes), classes)
        parameters = fitted.parameters
    else:
        label = F.col("y").cast("double")
        if classes is not None:
            label = F.create_map(*[F.lit(v) for i, c in enumerate(classes) for v in (c, float(i))])[F.col("y")]
        table = rows.select(array_to_vector("x").alias("features"), label.alias("label"))
        fitted, parameters = _train(model, table, classes)
    new = dataclasses.replace(model, fitted=fitted, feature_names=names, classes=classes, parameters=parameters)
    new.inputs = [ModelInput("features", names, Structure([-1, len(names)], ["batch", "features"]))]
    new.outputs = [ModelOutput("predictions", model.tasks, Structure([-1], ["batch"]), None if classes is None else [{"value": i, "name": str(c)} for i, c in enumerate(classes)])]
    if training_set.schema.geometry:
        g = F.col(training_set.schema.geometry[0])
        b = G.bbox(g)
        low = df.where(g.isNotNull()).agg(F.min(b["xmin"]), F.min(b["ymin"]), F.max(b["xmax"]), F.max(b["ymax"])).first()
        if low[0] is not None:
            new.bbox = list(low)
            x0, y0, x1, y1 = low
            # the hull of a geometry's corners in 32 directions: a bounded set for the driver
            v = F.explode(G.vertices(g))
            pts = df.where(g.isNotNull()).select(v.alias("p")).select("p.x", "p.y")
            turns = [np.pi * i / 16 for i in range(32)]
            best = pts.agg(*[F.max_by(F.struct("x", "y"), F.col("x") * float(np.cos(a)) + F.col("y") * float(np.sin(a))) for a in turns]).first()
            new.hull = G.hull((p[0], p[1]) for p in best)
    return new


def _stored(rows, width: int, classes: list) -> tuple[StoredRows, np.ndarray]:
    """The features in a file of the driver, a part of the table at a time, and the place of each label among the classes."""
    at = {c: i for i, c in enumerate(classes)}
    x, y = StoredRows(width), array("i")
    found = rows.toLocalIterator()
    while part := list(islice(found, 1000)):
        x.append([r["x"] for r in part])
        y.extend(at[r["y"]] for r in part)
    if not len(x):
        raise ValueError("no row to learn from")
    return x, np.frombuffer(y, dtype=np.int32)


def _train(model: MLModel, table, classes):
    from pyspark.ml.classification import GBTClassifier, OneVsRest

    e = model.estimator
    if isinstance(e, GBTClassifier) and classes is not None and len(classes) > 2:
        fitted = OneVsRest(classifier=e.copy()).fit(table)
        return fitted, sum(t.totalNumNodes for t in fitted.models)
    fitted = e.fit(table)
    return fitted, getattr(fitted, "totalNumNodes", None)


def ml_predict(data: DataCube, model: MLModel, feature_dim=None) -> DataCube:
    """Predictions for each sample of a raster cube, with a dimension ``predictions`` of one label.

    Features come in the order of the model's names where the cube has these names, else in the order of the model's
    dimensions.  A sample with a missing feature gets no-data.
    """
    if not model.trained:
        raise RuntimeError("the model is not trained")
    if feature_dim is not None:
        warnings.warn("feature_dim is given by the model's dimension", DeprecationWarning, stacklevel=2)
        dims = [feature_dim] if isinstance(feature_dim, str) else list(feature_dim)
    else:
        dims = model.dimension
    if not dims:
        raise ValueError("a feature dimension is needed")
    samples, names = stack_to_samples(data, dims)
    if len(names) != model.n_features:
        raise ValueError(f"the model has {model.n_features} features, the cube {len(names)}")
    x = F.col("features")
    if set(names) == set(model.feature_names) and names != model.feature_names:
        x = F.array(*[F.get(x, F.lit(names.index(n))) for n in model.feature_names])
    keys, value = data.schema.others(*dims), data.schema.value
    whole = ~F.exists("__x", lambda v: v.isNull() | F.isnan(v))
    rows = samples.select(*keys, x.alias("__x")).withColumn("__ok", whole)
    if isinstance(model.fitted, NetClassifier):
        net = rows.sparkSession.sparkContext.broadcast(model.fitted)
        kinds = ", ".join([f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys] + [f"`{value}` double"])

        def work(parts):
            for p in parts:
                good = p[p["__ok"]]
                out = pd.Series(np.nan, index=p.index)
                if len(good):
                    out[good.index] = np.asarray(net.value.predict(np.stack(good["__x"].to_numpy())), dtype=float)
                yield p[keys].assign(**{value: out})

        out = rows.mapInPandas(work, kinds).withColumn(value, F.when(~F.isnan(value), F.col(value)))
    else:
        filled = F.when(F.col("__ok"), F.col("__x")).otherwise(F.array(*[F.lit(0.0)] * model.n_features))
        done = model.fitted.transform(rows.withColumn("features", array_to_vector(filled)))
        p = F.col("prediction")
        if model.classes is not None:
            p = F.get(F.array(*[F.lit(c) for c in model.classes]), p.cast("int"))
        out = done.select(*keys, F.when(F.col("__ok"), p).alias(value))
    schema = data.schema.without(*dims).with_dim(Dim("predictions", "other", ("0",)))
    return data.of(out.withColumn("predictions", F.lit("0")).select(*schema.names, value), schema)
