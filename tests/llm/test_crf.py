import itertools

import numpy as np

from parley.llm import crf


def brute(model, emit):
    n, labels = emit.shape
    paths = list(itertools.product(range(labels), repeat=n))
    score = np.array([model.start[p[0]] + sum(emit[k, p[k]] for k in range(n)) + sum(model.trans[p[k - 1], p[k]] for k in range(1, n)) for p in paths])
    weight = np.exp(score - score.max())
    out = np.zeros((n, labels))
    for p, w in zip(paths, weight):
        out[np.arange(n), p] += w
    return out / weight.sum(), paths[int(score.argmax())]


def test_marginals_and_viterbi_equal_all_paths():
    rng = np.random.default_rng(3)
    model = crf.Chain(np.zeros((1, 3)), rng.normal(size=(3, 3)), rng.normal(size=3))
    sizes = [0, 1, 7, 5, 0, 6, 2]
    at = np.concatenate([[0], np.cumsum(sizes)])
    emit = rng.normal(size=(at[-1], 3)) * 2
    for most in (1, 2, 3, 128):
        got, path = crf.marginals(model, emit, at, most), crf.viterbi(model, emit, at, most)
        for a, b in zip(at, at[1:]):
            if b > a:
                want, best = brute(model, emit[a:b])
                np.testing.assert_allclose(got[a:b], want, atol=1e-9)
                np.testing.assert_allclose(crf.forward_backward(model, emit, at)[a:b], want, atol=1e-9)
                assert tuple(path[a:b]) == best


def test_training_learns_a_context():
    # label 1 exactly for feature 2 after feature 1
    rng = np.random.default_rng(0)
    f = rng.integers(0, 3, 3000)
    before = np.concatenate([[0], f[:-1]])
    label = ((f == 2) & (before == 1)).astype(int)
    features = np.stack([f, 3 + before], axis=1)
    at = np.arange(0, 3001, 30)
    features[at[:-1], 1], label[at[:-1]] = 3, 0
    model = crf.train(features, label, at, 6, 2, rounds=200, l2=0.0)
    assert (crf.viterbi(model, crf.scores(model, features), at) == label).mean() > 0.99
