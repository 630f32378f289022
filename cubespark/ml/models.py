"""Untrained models."""

from __future__ import annotations

import pyspark

from .metadata import MLModel
from .nets import OPTIMIZERS, LightTAE, NetClassifier, TempCNN


def check_dimension(dimension, default: list[str]) -> list[str]:
    if dimension is None:
        return list(default)
    if isinstance(dimension, str) or not isinstance(dimension, (list, tuple)):
        raise TypeError("a list of dimension names is needed")
    if not dimension or not all(isinstance(d, str) and d for d in dimension):
        raise ValueError("a list of dimension names, not empty, is needed")
    return list(dimension)


def _subset(max_variables) -> str:
    if isinstance(max_variables, bool) or not isinstance(max_variables, (int, str)):
        raise ValueError(f"max_variables is a number or a name, not {max_variables!r}")
    if isinstance(max_variables, int):
        if max_variables < 1:
            raise ValueError("max_variables is 1 at least")
        return str(max_variables)
    if max_variables not in ("all", "sqrt", "log2", "onethird"):
        raise ValueError(f"unknown max_variables {max_variables!r}")
    return max_variables


def _seed(seed) -> dict:
    return {} if seed is None else {"seed": seed}


def mlm_class_random_forest(max_variables="sqrt", num_trees: int = 100, seed: int | None = None, dimension=None) -> MLModel:
    from pyspark.ml.classification import RandomForestClassifier

    e = RandomForestClassifier(numTrees=num_trees, featureSubsetStrategy=_subset(max_variables), maxDepth=20, labelCol="label", featuresCol="features", **_seed(seed))
    return MLModel("random_forest_classifier", "Random Forest", ["classification"], "pyspark.ml", pyspark.__version__, e, dimension=check_dimension(dimension, ["bands"]), hyperparameters={"max_variables": max_variables, "num_trees": num_trees, "seed": seed})


def mlm_regr_random_forest(max_variables="onethird", num_trees: int = 100, seed: int | None = None, dimension=None) -> MLModel:
    from pyspark.ml.regression import RandomForestRegressor

    e = RandomForestRegressor(numTrees=num_trees, featureSubsetStrategy=_subset(max_variables), maxDepth=20, labelCol="label", featuresCol="features", **_seed(seed))
    return MLModel("random_forest_regressor", "Random Forest", ["regression"], "pyspark.ml", pyspark.__version__, e, dimension=check_dimension(dimension, ["bands"]), hyperparameters={"max_variables": max_variables, "num_trees": num_trees, "seed": seed})


def mlm_class_xgboost(learning_rate=0.15, max_depth=5, min_child_weight=1, subsample=0.8, min_split_loss=1, seed=None, dimension=None, rounds: int = 100) -> MLModel:
    """Gradient-boosted trees, one against the rest for more than two classes.

    ``min_split_loss`` is stored but not applied: the loss here is a gain for each row, on another scale.
    """
    from pyspark.ml.classification import GBTClassifier

    e = GBTClassifier(stepSize=learning_rate, maxDepth=max_depth, minInstancesPerNode=max(1, int(min_child_weight)), subsamplingRate=subsample, maxIter=rounds, labelCol="label", featuresCol="features", **_seed(seed))
    h = {"learning_rate": learning_rate, "max_depth": max_depth, "min_child_weight": min_child_weight, "subsample": subsample, "min_split_loss": min_split_loss, "seed": seed, "rounds": rounds}
    return MLModel("gradient_boosting_classifier", "Gradient Boosted Trees", ["classification"], "pyspark.ml", pyspark.__version__, e, dimension=check_dimension(dimension, ["bands"]), hyperparameters=h)


def _net(name: str, architecture: str, net, h: dict, dimension) -> MLModel:
    if h["optimizer"] not in OPTIMIZERS:
        raise ValueError(f"unknown optimizer {h['optimizer']!r}; there are {sorted(OPTIMIZERS)}")
    keys = ("epochs", "batch_size", "optimizer", "learning_rate", "seed", "epsilon", "weight_decay", "lr_decay_epochs", "lr_decay_rate")
    e = NetClassifier(net, **{k: h[k] for k in keys if k in h})
    return MLModel(name, architecture, ["classification"], "numpy", "", e, dimension=check_dimension(dimension, ["bands", "t"]), hyperparameters=h)


def mlm_class_tempcnn(cnn_layers=(256, 256, 256), cnn_kernels=(7, 7, 7), cnn_dropout_rates=(0.2, 0.2, 0.2), dense_layer_nodes=256, dense_layer_dropout_rate=0.5, epochs=100, batch_size=64, optimizer="adam", learning_rate=0.001, seed=None, dimension=None) -> MLModel:
    h = {"cnn_layers": list(cnn_layers), "cnn_kernels": list(cnn_kernels), "cnn_dropout_rates": list(cnn_dropout_rates), "dense_layer_nodes": dense_layer_nodes, "dense_layer_dropout_rate": dense_layer_dropout_rate, "epochs": epochs, "batch_size": batch_size, "optimizer": optimizer, "learning_rate": learning_rate, "seed": seed}
    if not len(cnn_layers) == len(cnn_kernels) == len(cnn_dropout_rates):
        raise ValueError("layers, kernels and dropout rates need the same length")
    net = TempCNN(list(cnn_layers), list(cnn_kernels), list(cnn_dropout_rates), dense_layer_nodes, dense_layer_dropout_rate)
    return _net("tempcnn", "TempCNN", net, h, dimension)


def mlm_class_lighttae(epochs=150, batch_size=128, optimizer="adam", learning_rate=0.0005, epsilon=1e-8, weight_decay=0.0007, lr_decay_epochs=50, lr_decay_rate=1.0, seed=None, dimension=None) -> MLModel:
    h = {"epochs": epochs, "batch_size": batch_size, "optimizer": optimizer, "learning_rate": learning_rate, "epsilon": epsilon, "weight_decay": weight_decay, "lr_decay_epochs": lr_decay_epochs, "lr_decay_rate": lr_decay_rate, "seed": seed}
    return _net("lighttae", "LightTAE", LightTAE(), h, dimension)


class Model:
    """The same by shorter names."""

    random_forest = staticmethod(mlm_class_random_forest)
    random_forest_regressor = staticmethod(mlm_regr_random_forest)
    xgboost_classifier = staticmethod(mlm_class_xgboost)
    tempcnn = staticmethod(mlm_class_tempcnn)
    lighttae = staticmethod(mlm_class_lighttae)
