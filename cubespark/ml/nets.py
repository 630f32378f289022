"""Small networks in NumPy: a tape of gradients, two architectures, and their training."""

from __future__ import annotations

import copy
import os
import tempfile

import numpy as np


#: Numbers that one array of a forward pass has at most, where it can be made for some rows at a time.
CELLS = 1 << 20


class Tensor:
    """An array that remembers what it was made of, for gradients; one made of constants alone remembers nothing."""

    def __init__(self, data, parents=(), back=None, constant=False):
        self.data = np.asarray(data, dtype=float)
        self._grad = None
        self.constant = all(p.constant for p in parents) if parents else constant
        self._parents, self._back = ((), None) if self.constant else (parents, back)

    @staticmethod
    def of(o) -> Tensor:
        return o if isinstance(o, Tensor) else Tensor(o, constant=True)

    @property
    def grad(self) -> np.ndarray:
        return np.zeros_like(self.data) if self._grad is None else self._grad

    def add(self, g) -> None:
        """Adds to the gradient; ``g`` may be another tensor's too, so it is never added to in place."""
        self._grad = g if self._grad is None else self._grad + g

    @staticmethod
    def _fit(grad, shape):
        """Sums a gradient over the axes that were broadcast."""
        while grad.ndim > len(shape):
            grad = grad.sum(axis=0)
        for i, n in enumerate(shape):
            if n == 1 and grad.shape[i] != 1:
                grad = grad.sum(axis=i, keepdims=True)
        return grad

    def __add__(self, o):
        o = Tensor.of(o)

        def back(g):
            for t in (self, o):
                if not t.constant:
                    t.add(Tensor._fit(g, t.data.shape))

        return Tensor(self.data + o.data, (self, o), back)

    def __mul__(self, o):
        o = Tensor.of(o)

        def back(g):
            for t, other in ((self, o), (o, self)):
                if not t.constant:
                    t.add(Tensor._fit(g * other.data, t.data.shape))

        return Tensor(self.data * o.data, (self, o), back)

    def __sub__(self, o):
        return self + Tensor.of(o) * -1.0

    def __matmul__(self, o):
        def back(g):
            if not self.constant:
                self.add(Tensor._fit(g @ np.swapaxes(o.data, -1, -2), self.data.shape))
            if not o.constant:
                o.add(Tensor._fit(np.swapaxes(self.data, -1, -2) @ g, o.data.shape))

        return Tensor(self.data @ o.data, (self, o), back)

    def linear(self, w: Tensor, b: Tensor):
        """``self @ w + b`` in one array."""

        def back(g):
            if not self.constant:
                self.add(Tensor._fit(g @ np.swapaxes(w.data, -1, -2), self.data.shape))
            w.add(Tensor._fit(np.swapaxes(self.data, -1, -2) @ g, w.data.shape))
            b.add(Tensor._fit(g, b.data.shape))

        out = self.data @ w.data
        out += b.data
        return Tensor(out, (self, w, b), back)

    def power(self, p: float):
        def back(g):
            self.add(g * p * self.data ** (p - 1))

        return Tensor(self.data**p, (self,), back)

    def relu(self):
        def back(g):
            self.add(g * (self.data > 0))

        return Tensor(np.maximum(self.data, 0), (self,), back)

    def gelu(self):
        x, c = self.data, np.sqrt(2 / np.pi)
        t = np.tanh(c * (x + 0.044715 * (x * x * x)))  # a power of 3 takes many times as long

        def back(g):
            self.add(g * (0.5 * (1 + t) + 0.5 * x * (1 - t**2) * c * (1 + 3 * 0.044715 * x**2)))

        return Tensor(0.5 * x * (1 + t), (self,), back)

    def attend(self, v: Tensor, drop):
        """Attention with ``self``, (n, heads, places, k), as queries and keys: its weights, through ``drop``, times ``v``.

        The weights, of which there are places x places, exist for some rows at a time, and are made again for the
        gradients; of ``drop`` a bit each is kept.
        """
        n, heads, s, k = self.data.shape
        parts = [slice(i, i + max(1, CELLS // 4 // (heads * s * s))) for i in range(0, n, max(1, CELLS // 4 // (heads * s * s)))]
        scale, masks, out = 1 / np.sqrt(k), [], np.empty(v.data.shape)

        def weights(i):
            z = self.data[i] @ np.swapaxes(self.data[i], 2, 3)
            z *= scale
            z -= z.max(axis=-1, keepdims=True)
            np.exp(z, out=z)
            z /= z.sum(axis=-1, keepdims=True)
            return z

        for i in parts:
            a = weights(i)
            if drop is not None:
                m = drop(Tensor(np.ones(a.shape), constant=True)).data
                masks.append((m != 0, m.max()))
                a *= m
            np.matmul(a, v.data[i], out=out[i])

        def back(g):
            gq, gv = np.empty_like(self.data), np.empty_like(v.data)
            for j, i in enumerate(parts):
                p, x = weights(i), self.data[i]
                ga = g[i] @ np.swapaxes(v.data[i], 2, 3)
                if masks:
                    m = masks[j][0] * masks[j][1]
                    np.matmul(np.swapaxes(p * m, 2, 3), g[i], out=gv[i])
                    ga *= m
                else:
                    np.matmul(np.swapaxes(p, 2, 3), g[i], out=gv[i])
                ga -= (ga * p).sum(axis=-1, keepdims=True)
                ga *= p
                ga *= scale
                np.matmul(ga, x, out=gq[i])
                gq[i] += np.swapaxes(np.swapaxes(x, 2, 3) @ ga, 2, 3)
            self.add(gq)
            v.add(gv)

        return Tensor(out, (self, v), back)

    def layer_norm(self, gain: Tensor, bias: Tensor):
        """Over the last axis; kept are the differences from the mean."""
        n = self.data.shape[-1]
        d = self.data - self.data.mean(axis=-1, keepdims=True)
        v = (d * d).mean(axis=-1, keepdims=True) + 1e-5
        r = v**-0.5

        def back(g):
            bias.add(Tensor._fit(g, bias.data.shape))
            gain.add(Tensor._fit(g * (d * r), gain.data.shape))
            g = g * gain.data
            q = (g * d).sum(axis=-1, keepdims=True) * -0.5 * v**-1.5 / n * d
            g *= r
            g += q
            g += q
            self.add(g - g.sum(axis=-1, keepdims=True) / n)

        out = d * r
        out *= gain.data
        out += bias.data
        return Tensor(out, (self, gain, bias), back)

    def mean(self, axis):
        n = np.prod([self.data.shape[a] for a in np.atleast_1d(axis)])

        def back(g):
            self.add(np.broadcast_to(g, self.data.shape) / n)

        return Tensor(self.data.mean(axis=axis, keepdims=True), (self,), back)

    def reshape(self, *shape):
        def back(g):
            self.add(g.reshape(self.data.shape))

        return Tensor(self.data.reshape(shape), (self,), back)

    def swap(self, a: int, b: int):
        def back(g):
            self.add(np.swapaxes(g, a, b))

        return Tensor(np.swapaxes(self.data, a, b), (self,), back)

    def conv(self, w: Tensor):
        """(n, in, length) with (out, in, k), as many places as before."""
        k, pad = w.data.shape[2], w.data.shape[2] // 2
        length = self.data.shape[2]
        x = np.pad(self.data, ((0, 0), (0, 0), (pad, pad)))
        view = np.lib.stride_tricks.sliding_window_view(x, k, axis=2)[:, :, :length]
        out = np.einsum("nilk,oik->nol", view, w.data, optimize=True)

        def back(g):
            w.add(np.einsum("nol,nilk->oik", g, view, optimize=True))
            if self.constant:
                return
            gx = np.zeros_like(x)
            for j in range(k):
                gx[:, :, j : j + length] += np.einsum("nol,oi->nil", g, w.data[:, :, j], optimize=True)
            self.add(gx[:, :, pad : pad + length])

        return Tensor(out, (self, w), back)

    def cross_entropy(self, y):
        """Mean loss of logits."""
        z = self.data - self.data.max(axis=1, keepdims=True)
        p = np.exp(z)
        p /= p.sum(axis=1, keepdims=True)
        rows = np.arange(len(y))

        def back(g):
            d = p.copy()
            d[rows, y] -= 1
            self.add(g * d / len(y))

        return Tensor(-np.log(np.maximum(p[rows, y], 1e-300)).mean(), (self,), back)

    def backward(self):
        """Gradients of all it was made of.  What lies between is given back on the way, without waiting for a collector of cycles."""
        order, seen, path = [], {id(self)}, [(self, iter(self._parents))]
        while path:
            t, rest = path[-1]
            q = next(rest, None)
            if q is None:
                order.append(path.pop()[0])
            elif id(q) not in seen:
                seen.add(id(q))
                path.append((q, iter(q._parents)))
        self._grad = np.ones_like(self.data)
        t = q = None
        while order:
            t = order.pop()
            if t._back is not None:
                t._back(t._grad)
                t._grad, t._back, t._parents = None, None, ()


class Net:
    """Parameters by name, running statistics, and dropout while it trains."""

    def __init__(self):
        self.p: dict[str, np.ndarray] = {}
        self.stats: dict[str, np.ndarray] = {}

    def uniform(self, name, fan_in, *shape):
        b = 1 / np.sqrt(max(1, fan_in))
        self.p[name] = self.rng.uniform(-b, b, shape)

    def normed(self, name, n):
        self.p[f"{name}.g"], self.p[f"{name}.b"] = np.ones(n), np.zeros(n)

    def cells(self, n_features: int) -> int:
        """Numbers in the largest array that a forward pass makes of one row."""
        raise NotImplementedError

    def drop(self, x: Tensor, rate: float, training: bool) -> Tensor:
        return x * ((self.rng.random(x.data.shape) >= rate) / (1 - rate)) if training and rate > 0 else x

    def layer_norm(self, x: Tensor, t: dict, name: str) -> Tensor:
        return x.layer_norm(t[f"{name}.g"], t[f"{name}.b"])

    def batch_norm(self, x: Tensor, t: dict, name: str, training: bool) -> Tensor:
        n = x.data.shape[1]
        g, b = t[f"{name}.g"].reshape(1, n, 1), t[f"{name}.b"].reshape(1, n, 1)
        if not training:
            m, v = self.stats[f"{name}.m"].reshape(1, n, 1), self.stats[f"{name}.v"].reshape(1, n, 1)
            return (x - m) * (1 / np.sqrt(v + 1e-5)) * g + b
        m = x.mean((0, 2))
        d = x - m
        v = (d * d).mean((0, 2))
        for k, now in (("m", m), ("v", v)):
            self.stats[f"{name}.{k}"] = 0.9 * self.stats[f"{name}.{k}"] + 0.1 * now.data.reshape(-1)
        return d * (v + 1e-5).power(-0.5) * g + b


class TempCNN(Net):
    """Convolutions with batch norm, ReLU and dropout over all features as one series, a mean pool, a dense head."""

    def __init__(self, layers, kernels, rates, nodes: int, rate: float):
        super().__init__()
        self.layers, self.kernels, self.rates, self.nodes, self.rate = layers, kernels, rates, nodes, rate

    def build(self, n_features: int, classes: int, rng):
        self.rng, before = rng, 1
        for i, (n, k) in enumerate(zip(self.layers, self.kernels, strict=True)):
            self.uniform(f"c{i}", before * k, n, before, k)
            self.uniform(f"cb{i}", before * k, n)
            self.normed(f"n{i}", n)
            self.stats[f"n{i}.m"], self.stats[f"n{i}.v"] = np.zeros(n), np.ones(n)
            before = n
        self.uniform("d", before, before, self.nodes)
        self.uniform("db", before, self.nodes)
        self.uniform("o", self.nodes, self.nodes, classes)
        self.uniform("ob", self.nodes, classes)

    def cells(self, n_features: int) -> int:
        return n_features * max(i * k for i, k in zip((1, *self.layers), (*self.kernels, 1), strict=True))

    def forward(self, x: np.ndarray, t: dict, training: bool) -> Tensor:
        h = Tensor(x[:, None, :], constant=True)
        for i, n in enumerate(self.layers):
            h = h.conv(t[f"c{i}"]) + t[f"cb{i}"].reshape(1, n, 1)
            h = self.drop(self.batch_norm(h, t, f"n{i}", training).relu(), self.rates[i], training)
        h = h.mean(2).reshape(len(x), -1)
        h = self.drop((h @ t["d"] + t["db"]).relu(), self.rate, training)
        return h @ t["o"] + t["ob"]


class LightTAE(Net):
    """A linear embedding with learned places, two layers of attention with one projection for queries and keys."""

    def __init__(self, width: int = 64, heads: int = 4, layers: int = 2):
        super().__init__()
        self.width, self.heads, self.layers = width, heads, layers

    def build(self, n_features: int, classes: int, rng):
        self.rng, w = rng, self.width
        self.uniform("e", 1, 1, w)
        self.uniform("eb", 1, w)
        self.p["pos"] = rng.normal(0, 0.02, (1, n_features, w))
        for i in range(self.layers):
            for name, a, b in (("qk", w, w), ("v", w, w), ("out", w, w), ("f1", w, 2 * w), ("f2", 2 * w, w)):
                self.uniform(f"{name}{i}", a, a, b)
                self.uniform(f"{name}b{i}", a, b)
            self.normed(f"a{i}", w)
            self.normed(f"z{i}", w)
        self.uniform("d", w, w, w)
        self.uniform("db", w, w)
        self.uniform("o", w, w, classes)
        self.uniform("ob", w, classes)

    def cells(self, n_features: int) -> int:
        return 2 * self.width * n_features

    def forward(self, x: np.ndarray, t: dict, training: bool) -> Tensor:
        n, s = x.shape
        h = Tensor(x[:, :, None], constant=True).linear(t["e"], t["eb"]) + t["pos"]
        k = self.width // self.heads
        drop = (lambda a: self.drop(a, 0.1, True)) if training else None
        for i in range(self.layers):
            lin = lambda v, name: v.linear(t[f"{name}{i}"], t[f"{name}b{i}"])  # noqa: B023, E731
            split = lambda v: v.reshape(n, s, self.heads, k).swap(1, 2)
            q, v = split(lin(h, "qk")), split(lin(h, "v"))
            h = self.layer_norm(h + lin(q.attend(v, drop).swap(1, 2).reshape(n, s, self.width), "out"), t, f"a{i}")
            h = self.layer_norm(h + lin(lin(h, "f1").gelu(), "f2"), t, f"z{i}")
        h = h.mean(1).reshape(n, self.width)
        return (h @ t["d"] + t["db"]).relu() @ t["o"] + t["ob"]


class _Adaptive:
    """Adam and its kin: each ``kind`` bends the step of the two moments."""

    def __init__(self, kind: str, lr: float, eps: float = 1e-8, decay: float = 0.0):
        self.kind, self.lr, self.eps, self.decay, self.t = kind, lr, eps, decay, 0
        self.m: dict[str, np.ndarray] = {}
        self.v: dict[str, np.ndarray] = {}
        self.x0: dict[str, np.ndarray] = {}
        self.sgd = False

    def step(self, p: dict[str, np.ndarray], grads: dict[str, np.ndarray]) -> None:
        self.t += 1
        t, b1, b2 = self.t, 0.9, 0.999
        for k, g in grads.items():
            if self.decay:
                g = g + self.decay * p[k]
            m = self.m.setdefault(k, np.zeros_like(g))
            v = self.v.setdefault(k, np.zeros_like(g))
            if self.kind == "madgrad":
                x0 = self.x0.setdefault(k, p[k].copy())
                lam = self.lr * np.sqrt(t)
                m += lam * g
                v += lam * g * g
                z = x0 - m / (np.cbrt(v) + self.eps)
                p[k] += 0.1 * (z - p[k])
                continue
            m *= b1
            m += (1 - b1) * g
            if self.kind == "adabelief":
                v *= b2
                v += (1 - b2) * (g - m) ** 2 + self.eps
            elif self.kind == "yogi":
                v -= (1 - b2) * np.sign(v - g * g) * g * g
            else:
                v *= b2
                v += (1 - b2) * g * g
            mh, vh = m / (1 - b1**t), v / (1 - b2**t)
            if self.kind == "nadam":
                mh = b1 * mh + (1 - b1) * g / (1 - b1**t)
            elif self.kind == "qhadam":
                mh, vh = 0.3 * g + 0.7 * mh, vh
            step = self.lr * mh / (np.sqrt(vh) + self.eps)
            if self.kind == "radam":
                most = 2 / (1 - b2) - 1
                rho = most - 2 * t * b2**t / (1 - b2**t)
                if rho > 5:
                    step = step * np.sqrt((rho - 4) * (rho - 2) * most / ((most - 4) * (most - 2) * rho))
                else:
                    step = self.lr * mh
            elif self.kind == "adabound":
                low, high = 0.1 * (1 - 1 / (1e-3 * t + 1)), 0.1 * (1 + 1 / (1e-3 * t))
                step = np.clip(self.lr / (np.sqrt(vh) + self.eps), low, high) * mh
            elif self.kind == "swats" and t > 1000:
                step = self.lr * 10 * m
            p[k] -= step


#: Names of optimizers; "madagrad" is an older spelling.
OPTIMIZERS = {k: ("madgrad" if k == "madagrad" else k) for k in ("adam", "nadam", "radam", "adabound", "adabelief", "madgrad", "madagrad", "qhadam", "swats", "yogi")}


class StoredRows:
    """Rows of doubles in a temporary file: in memory are those that are asked for."""

    def __init__(self, width: int):
        self.shape = (0, width)
        self.file = tempfile.TemporaryFile()

    def __len__(self) -> int:
        return self.shape[0]

    def append(self, rows) -> None:
        a = np.asarray(rows, dtype=float).reshape(-1, self.shape[1])
        self.file.write(a.tobytes())
        self.file.flush()
        self.shape = (len(self) + len(a), self.shape[1])

    def __getitem__(self, rows) -> np.ndarray:
        n = 8 * self.shape[1]
        return np.frombuffer(b"".join(os.pread(self.file.fileno(), n, int(i) * n) for i in rows)).reshape(-1, self.shape[1])


class NetClassifier:
    """fit(X, y) and predict(X) around a network that is built when it sees the data."""

    def __init__(self, net: Net, *, epochs=100, batch_size=64, optimizer="adam", learning_rate=1e-3, seed=None, epsilon=1e-8, weight_decay=0.0, lr_decay_epochs=0, lr_decay_rate=1.0):
        self.template, self.epochs, self.batch_size, self.optimizer, self.learning_rate = net, epochs, batch_size, optimizer, learning_rate
        self.seed, self.epsilon, self.weight_decay, self.lr_decay_epochs, self.lr_decay_rate = seed, epsilon, weight_decay, lr_decay_epochs, lr_decay_rate
        self.net: Net | None = None
        self.classes: list = []
        self.losses: list[float] = []

    def fit(self, x: np.ndarray | StoredRows, y, classes: list | None = None) -> NetClassifier:
        """With ``classes``, ``y`` are places among them."""
        rng = np.random.default_rng(self.seed)
        if classes is None:
            y = np.asarray(y).tolist()
            classes = sorted(set(y))
            at = {c: i for i, c in enumerate(classes)}
            y = [at[v] for v in y]
        x = x if isinstance(x, StoredRows) else np.asarray(x, dtype=float)
        self.classes, labels = list(classes), np.asarray(y)
        self.net = copy.deepcopy(self.template)
        self.net.build(x.shape[1], len(self.classes), rng)
        opt = _Adaptive(OPTIMIZERS[self.optimizer], self.learning_rate, self.epsilon, self.weight_decay)
        self.losses = []
        for epoch in range(self.epochs):
            if self.lr_decay_epochs and epoch and epoch % self.lr_decay_epochs == 0:
                opt.lr *= self.lr_decay_rate
            order, total = rng.permutation(len(x)), 0.0
            for i in range(0, len(x), self.batch_size):
                rows = order[i : i + self.batch_size]
                t = {k: Tensor(v) for k, v in self.net.p.items()}
                loss = self.net.forward(x[rows], t, True).cross_entropy(labels[rows])
                loss.backward()
                opt.step(self.net.p, {k: v.grad for k, v in t.items()})
                total += float(loss.data) * len(rows)
            self.losses.append(total / max(1, len(x)))
        return self

    def predict(self, x: np.ndarray) -> list:
        if self.net is None:
            raise RuntimeError("the network is not trained")
        x, out = np.asarray(x, dtype=float), []
        t = {k: Tensor(v, constant=True) for k, v in self.net.p.items()}
        n = min(4096, max(1, CELLS // self.net.cells(x.shape[1])))
        for i in range(0, len(x), n):
            out += self.net.forward(x[i : i + n], t, False).data.argmax(axis=1).tolist()
        return [self.classes[i] for i in out]

    @property
    def parameters(self) -> int:
        return sum(v.size for v in self.net.p.values()) if self.net else 0
