"""Lookups and the hidden layer against their plain forms."""

import numpy as np

from weftspark.llm import lm


def vocabulary(keys):
    count = np.ones(len(keys) + 512)
    return lm.Vocabulary(keys, count, count, count).classed(np.random.default_rng(3).standard_normal((len(count), 2)))


def test_known_keys():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 1000):
        keys = np.unique(rng.integers(0, 2**64, n, np.uint64))
        asked = np.concatenate((keys, keys + np.uint64(1), rng.integers(0, 2**64, 500, np.uint64), np.array([0, 2**64 - 1], np.uint64)))
        at = {k: i for i, k in enumerate(keys.tolist())}
        assert vocabulary(keys).known(asked).tolist() == [at.get(k, -1) for k in asked.tolist()]
    close = np.arange(2**64 - 50, 2**64, dtype=np.uint64)
    assert vocabulary(close).known(close).tolist() == list(range(50))


def test_hidden_values():
    net = lm.Network(vocabulary(np.arange(20, dtype=np.uint64)))
    net.weights[2] += np.float32(0.3)
    at = np.random.default_rng(2).integers(0, net.held.beyond + 1, (30, len(lm.WINDOW)))
    x, h = net.hidden(at)
    want = np.tanh(sum(net.weights[0][at[:, k]].astype(float) @ net.weights[1][k] for k in range(len(lm.WINDOW))) + net.weights[2])
    assert np.allclose(h[:, : lm.HIDDEN], want, atol=1e-5) and (h[:, lm.HIDDEN] == 1).all() and x.shape == (30, len(lm.WINDOW) * lm.EMBEDDED)
