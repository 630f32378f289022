import copy
import json

import numpy as np
import pytest

from cubespark import ml
from cubespark.cube import DataCube
from cubespark.functions import geometry as G
from cubespark.ml import nets
from cubespark.schema import CubeSchema, Dim


def training(spark, names, n=50, rule=lambda v: int(v[0] > 0.5)):
    x = np.random.default_rng(0).random((n, len(names)))
    rows = [(*map(float, v), rule(v), ("Point", [[[(float(i), 1.0)]]])) for i, v in enumerate(x)]
    kind = "double" if isinstance(rows[0][len(names)], float) else "int"
    df = spark.createDataFrame(rows, ", ".join(f"{k} double" for k in names) + f", label {kind}, geometry {G.TYPE}")
    return DataCube(df, CubeSchema((Dim("geometry", "geometry"),), kind="vector", geometry=("geometry",)))


def raster(spark, bands, t=(0,), missing=False):
    rng = np.random.default_rng(1)
    rows = [(float(i), b, float(x), None if missing and x == 0 else float(rng.random())) for i in t for b in bands for x in range(3)]
    return DataCube(spark.createDataFrame(rows, "t double, bands string, x double, value double"), CubeSchema((Dim("t"), Dim("bands", "bands", tuple(bands)), Dim("x"))))


@pytest.mark.parametrize("make", [lambda: ml.mlm_class_random_forest(num_trees=10, seed=1), lambda: ml.mlm_class_xgboost(seed=1, rounds=3, max_depth=3)])
def test_trees(spark, tmp_path, make):
    model = make()
    fitted = ml.ml_fit(model, training(spark, ["b1", "b2", "b3"]), "label")
    assert fitted.trained and not model.trained and fitted.feature_names == ["b1", "b2", "b3"] and fitted.parameters > 0
    assert fitted.bbox == [0, 1, 49, 1] and fitted.classes == [0, 1]
    cube = raster(spark, ["b1", "b2", "b3"], missing=True)
    out = ml.ml_predict(cube, fitted)
    got = {r.x: r.value for r in out.df.collect()}
    first = {r.x: r.value for r in cube.df.where("bands = 'b1'").collect()}
    assert out.schema.names == ["t", "x", "predictions"] and got[0.0] is None
    assert all(got[x] == (first[x] > 0.5) for x in (1.0, 2.0) if abs(first[x] - 0.5) > 0.1)
    assert ml.save_ml_model(fitted, "m", {"directory": str(tmp_path)})
    back = ml.load_stac_ml(str(tmp_path / "m.stac.json"))
    assert {r.x: r.value for r in ml.ml_predict(cube, back).df.collect()} == got
    assert json.loads((tmp_path / "m.stac.json").read_text())["id"] == "m"


def test_regression(spark):
    m = ml.ml_fit(ml.mlm_regr_random_forest(num_trees=10, seed=1), training(spark, ["f1", "f2"], rule=lambda v: float(2 * v[0] + v[1])), "label")
    assert ml.ml_predict(raster(spark, ["f1", "f2"]), m).df.where("value between 0 and 3").count() == 3


@pytest.mark.parametrize("make", [
    lambda: ml.mlm_class_tempcnn(cnn_layers=[4], cnn_kernels=[3], cnn_dropout_rates=[0.0], dense_layer_nodes=8, dense_layer_dropout_rate=0.0, epochs=8, seed=1),
    lambda: ml.mlm_class_lighttae(epochs=3, batch_size=16, seed=1),
])
def test_nets(spark, tmp_path, make):
    bands, t = ["f0", "f1"], (0, 1)
    fitted = ml.ml_fit(make(), training(spark, ["a", "b", "c", "d"]), "label")
    losses = fitted.fitted.losses
    assert losses[-1] < losses[0]
    cube = raster(spark, bands, t)
    out = {r.x: r.value for r in ml.ml_predict(cube, fitted).df.collect()}
    assert set(out.values()) <= {0.0, 1.0} and len(out) == 3
    assert ml.save_ml_model(fitted, "net", {"directory": str(tmp_path)})
    assert {r.x: r.value for r in ml.ml_predict(cube, ml.load_stac_ml(str(tmp_path / "net.stac.json"))).df.collect()} == out


@pytest.mark.parametrize("net", [nets.TempCNN([3, 3], [3, 5], [0.0, 0.0], 5, 0.0), nets.LightTAE(8, 2, 1)])
def test_gradients(net):
    rng = np.random.default_rng(0)
    net.build(6, 3, rng)
    if isinstance(net, nets.LightTAE):
        net.drop = lambda x, rate, training: x
    x, y = rng.random((4, 6)), np.array([0, 1, 2, 1])

    def loss():
        t = {k: nets.Tensor(v) for k, v in net.p.items()}
        return net.forward(x, t, True).cross_entropy(y), t

    out, t = loss()
    out.backward()
    for k in net.p:
        i = tuple(rng.integers(0, n) for n in net.p[k].shape)
        net.p[k][i] += 1e-6
        up = loss()[0].data
        net.p[k][i] -= 2e-6
        down = loss()[0].data
        net.p[k][i] += 1e-6
        assert t[k].grad[i] == pytest.approx((up - down) / 2e-6, abs=1e-5), k


@pytest.mark.parametrize("name", sorted(nets.OPTIMIZERS))
def test_optimizers(name):
    rng = np.random.default_rng(0)
    x = rng.random((60, 4))
    c = nets.NetClassifier(nets.TempCNN([4], [3], [0.0], 8, 0.0), epochs=6, optimizer=name, learning_rate=0.01, seed=0).fit(x, x[:, 0] > 0.5)
    assert c.losses[-1] < c.losses[0] + 0.05 and np.isfinite(c.losses).all()


def test_errors(spark, tmp_path):
    m = ml.mlm_class_random_forest()
    with pytest.raises(RuntimeError):
        ml.ml_predict(raster(spark, ["b1"]), m)
    with pytest.raises(TypeError):
        ml.ml_fit(m, raster(spark, ["b1"]), "label")
    with pytest.raises(ValueError):
        ml.ml_fit(m, training(spark, ["b1"]), "none")
    with pytest.raises(ValueError):
        ml.mlm_class_random_forest(dimension=[])
    with pytest.raises(TypeError):
        ml.mlm_class_random_forest(dimension="bands")
    with pytest.raises(ValueError):
        ml.mlm_class_random_forest(max_variables="some")
    with pytest.raises(ValueError):
        ml.mlm_class_tempcnn(optimizer="none")
    assert not ml.save_ml_model(m, "x", {"directory": str(tmp_path)})
    fitted = ml.ml_fit(ml.mlm_class_random_forest(num_trees=2, seed=1), training(spark, ["b1", "b2"]), "label")
    with pytest.raises(ValueError):
        ml.ml_predict(raster(spark, ["b1"]), fitted)
    with pytest.warns(DeprecationWarning):
        ml.ml_predict(raster(spark, ["b1", "b2"]), fitted, feature_dim="bands")
    (tmp_path / "i.json").write_text(json.dumps({"assets": {}, "properties": {}}))
    with pytest.raises(ValueError):
        ml.load_stac_ml(str(tmp_path / "i.json"))


def test_memory_of_a_net():
    """The tape of a batch goes as gradients come, and neither weights of attention nor predictions are made for all rows at once."""
    import gc
    import tracemalloc

    rng = np.random.default_rng(0)
    x = rng.random((384, 64))
    c = nets.NetClassifier(nets.LightTAE(), epochs=1, batch_size=128, seed=0)
    gc.collect()
    gc.disable()  # nothing may wait for it
    tracemalloc.start()
    try:
        c.fit(x, x[:, 0] > 0.5)
        assert tracemalloc.get_traced_memory()[1] < 250e6
        tracemalloc.reset_peak()
        c.predict(x)
        assert tracemalloc.get_traced_memory()[1] < 60e6
    finally:
        tracemalloc.stop()
        gc.enable()


def test_attention(monkeypatch):
    """The same some rows at a time as by plain tensors, values and gradients."""
    rng = np.random.default_rng(0)
    q, v, w, mask = rng.random((5, 2, 6, 4)), rng.random((5, 2, 6, 4)), rng.random((5, 2, 6, 4)), (rng.random((5, 2, 6, 6)) > 0.3) / 0.7
    monkeypatch.setattr(nets, "CELLS", 4 * 2 * 72)
    at = iter([0, 2, 4])

    def drop(a):
        i = next(at)
        return a * mask[i : i + 2]

    def loss(q, v):
        z = q @ np.swapaxes(q, 2, 3) / 2
        p = np.exp(z) / np.exp(z).sum(axis=-1, keepdims=True)
        return (p * mask) @ v

    tq, tv = nets.Tensor(q), nets.Tensor(v)
    out = tq.attend(tv, drop)
    np.testing.assert_allclose(out.data, loss(q, v), rtol=1e-12)
    out._back(w)
    for t, i in ((tq, 0), (tv, 1)):
        for c in ((0, 0, 1, 2), (3, 1, 5, 0), (4, 0, 2, 3)):
            d = np.zeros_like(q)
            d[c] = 1e-6
            up, down = loss(*(a + d * (j == i) for j, a in enumerate((q, v)))), loss(*(a - d * (j == i) for j, a in enumerate((q, v))))
            assert t.grad[c] == pytest.approx((w * (up - down)).sum() / 2e-6, abs=1e-6)


def test_training_rows_stay_in_a_file(spark, monkeypatch):
    """A net learns the same from a file of rows as from an array; the table is never one frame of the driver."""
    table = training(spark, ["a", "b", "c", "d"])
    pdf = table.df.toPandas()
    monkeypatch.setattr(type(table.df), "toPandas", None)
    make = lambda: ml.mlm_class_lighttae(epochs=2, batch_size=16, seed=1)
    got = ml.ml_fit(make(), table, "label").fitted
    want = copy.deepcopy(make().estimator).fit(pdf[["a", "b", "c", "d"]].to_numpy(), pdf["label"].to_numpy())
    assert got.classes == want.classes and got.losses == want.losses
    assert all((got.net.p[k] == want.net.p[k]).all() for k in want.net.p)
