"""Linear-chain conditional random fields in numpy, over many sequences at once.

An item (a token) has a fixed number of feature ids; its score for each label is the sum of their weight rows. Labels
of neighbours add a transition score, the first item of a sequence a start score. Sequences are sorted by length, so
that one step of each recursion treats the k-th item of all sequences that have one: a batch costs as many array steps
as its longest sequence has items.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Chain:
    weights: np.ndarray  # features x labels
    trans: np.ndarray  # label of the item before x label
    start: np.ndarray  # label


class Layout:
    """Which items of the flat arrays are k-th in their sequences, for each k."""

    def __init__(self, at: np.ndarray):
        length = np.diff(at)
        order = np.argsort(-length, kind="stable")
        self.first = at[:-1][order]
        longest = int(length[order[0]]) if len(order) else 0
        # sequences that are longer than k, for each k
        self.alive = np.searchsorted(-length[order], -np.arange(longest), "left")

    def steps(self):
        for k, n in enumerate(self.alive):
            yield k, self.first[:n] + k


def scores(model: Chain, features: np.ndarray) -> np.ndarray:
    out = model.weights[features[:, 0]].copy()
    for k in range(1, features.shape[1]):
        out += model.weights[features[:, k]]
    return out


def forward_backward(model: Chain, emit: np.ndarray, at: np.ndarray, pairs: bool = False):
    """Marginal probabilities of the labels of all items; with pairs, also the expected transitions, summed, and the
    log partition of all sequences."""
    layout, n_labels = Layout(at), emit.shape[1]
    top = emit.max(axis=1, keepdims=True)
    local = np.exp(emit - top)
    move, begin = np.exp(model.trans), np.exp(model.start)
    ahead = np.empty_like(local)
    scale = np.ones(len(emit), local.dtype)
    for k, items in layout.steps():
        a = local[items] * (begin if k == 0 else ahead[items - 1] @ move)
        z = a.sum(axis=1)
        ahead[items], scale[items] = a / z[:, None], z
    back = np.ones_like(local)
    for k in range(len(layout.alive) - 2, -1, -1):
        later = layout.first[: layout.alive[k + 1]] + k + 1
        back[later - 1] = ((local[later] * back[later]) @ move.T) / scale[later][:, None]
    marginal = ahead * back
    marginal /= marginal.sum(axis=1, keepdims=True)
    if not pairs:
        return marginal
    inner = np.ones(len(emit), bool)
    inner[at[:-1][np.diff(at) > 0]] = False
    later = np.flatnonzero(inner)
    right = local[later] * back[later] / scale[later][:, None]
    expected = (ahead[later - 1].T @ right) * move
    return marginal, expected, float(np.log(scale).sum() + top.sum())


class Segments:
    """Sequences cut into runs of at most `most` items, so that steps within all runs go side by side.

    Between the runs of one sequence the recursions need one step for each run: their transfer matrices are known by then.
    """

    def __init__(self, at: np.ndarray, most: int):
        runs = -(-np.diff(at) // most)
        self.run_at = np.concatenate([[0], np.cumsum(runs)])
        owner = np.repeat(np.arange(len(runs)), runs)
        place = np.arange(len(owner)) - self.run_at[:-1][owner]
        self.first = at[:-1][owner] + place * most
        self.size = np.minimum(at[1:][owner] - self.first, most)
        self.heads = place == 0
        self.order = np.argsort(-self.size, kind="stable")
        longest = int(self.size.max()) if len(self.size) else 0
        self.alive = np.searchsorted(-self.size[self.order], -np.arange(longest), "left")
        self.between = Layout(self.run_at)

    def steps(self, back: bool = False):
        """(k, runs, items): the runs that have a k-th item, and those items."""
        for k in range(len(self.alive) - 1, -1, -1) if back else range(len(self.alive)):
            runs = self.order[: self.alive[k]]
            yield k, runs, self.first[runs] + k


def marginals(model: Chain, emit: np.ndarray, at: np.ndarray, most: int = 128) -> np.ndarray:
    """Marginal probabilities as forward_backward() has them, in fewer and wider steps."""
    seg, n_labels = Segments(at, most), emit.shape[1]
    local = np.exp(emit - emit.max(axis=1, keepdims=True))
    move, begin = np.exp(model.trans), np.exp(model.start)
    ones = np.ones(n_labels)

    def matrices(k, runs, items):
        out = move * local[items][:, None, :]
        if k == 0:
            heads = seg.heads[runs]
            out[heads] = (begin * local[items][heads])[:, None, :]
        return out

    product = np.tile(np.eye(n_labels), (len(seg.first), 1, 1))
    for k, runs, items in seg.steps():
        left, right = product[runs], matrices(k, runs, items)
        m = sum(left[:, :, j, None] * right[:, j, None, :] for j in range(n_labels))
        product[runs] = m / m.reshape(len(m), -1).max(axis=1)[:, None, None]
    into, after = np.tile(ones, (len(seg.first), 1)), np.tile(ones, (len(seg.first), 1))
    for k, runs in seg.between.steps():
        if k:
            v = (into[runs - 1][:, None, :] @ product[runs - 1])[:, 0]
            into[runs] = v / v.sum(axis=1, keepdims=True)
    for k in range(len(seg.between.alive) - 2, -1, -1):
        later = seg.between.first[: seg.between.alive[k + 1]] + k + 1
        v = (product[later] @ after[later][:, :, None])[:, :, 0]
        after[later - 1] = v / v.sum(axis=1, keepdims=True)
    ahead = np.empty_like(local)
    for k, runs, items in seg.steps():
        if k == 0:
            v = (into[runs][:, None, :] @ matrices(0, runs, items))[:, 0]
        else:
            v = (ahead[items - 1] @ move) * local[items]
        ahead[items] = v / v.sum(axis=1, keepdims=True)
    back = after
    for k, runs, items in seg.steps(back=True):
        ahead[items] *= back[runs]
        if k:
            v = (local[items] * back[runs]) @ move.T
            back[runs] = v / v.sum(axis=1, keepdims=True)
    return ahead / ahead.sum(axis=1, keepdims=True)


def viterbi(model: Chain, emit: np.ndarray, at: np.ndarray, most: int = 128) -> np.ndarray:
    """The likeliest labels of all sequences."""
    seg, n_labels = Segments(at, most), emit.shape[1]
    n = len(seg.first)

    def gains(k, runs, items):
        out = model.trans + emit[items][:, None, :]
        if k == 0:
            heads = seg.heads[runs]
            out[heads] = (model.start + emit[items][heads])[:, None, :]
        return out

    free = np.where(np.eye(n_labels, dtype=bool), 0.0, -1e30)
    product = np.tile(free, (n, 1, 1))
    for k, runs, items in seg.steps():
        product[runs] = (product[runs][:, :, :, None] + gains(k, runs, items)[:, None, :, :]).max(axis=2)
    into = np.zeros((n, n_labels))
    for k, runs in seg.between.steps():
        if k:
            into[runs] = (into[runs - 1][:, :, None] + product[runs - 1]).max(axis=1)
    came = np.zeros((len(emit), n_labels), np.int8)
    best = into
    for k, runs, items in seg.steps():
        paths = best[runs][:, :, None] + gains(k, runs, items)
        came[items], best[runs] = paths.argmax(axis=1), paths.max(axis=1)
    # the label before each run, for each label at its end
    entry = np.tile(np.arange(n_labels), (n, 1))
    for _, runs, items in seg.steps(back=True):
        entry[runs] = np.take_along_axis(came[items], entry[runs], axis=1)
    ended = best.argmax(axis=1)
    for k in range(len(seg.between.alive) - 2, -1, -1):
        later = seg.between.first[: seg.between.alive[k + 1]] + k + 1
        ended[later - 1] = entry[later, ended[later]]
    out = np.zeros(len(emit), np.int8)
    for _, runs, items in seg.steps(back=True):
        out[items] = ended[runs]
        ended[runs] = came[items, ended[runs]]
    return out


def train(features: np.ndarray, labels: np.ndarray, at: np.ndarray, n_features: int, n_labels: int, rounds: int = 60, rate: float = 0.5, l2: float = 1e-4) -> Chain:
    """Maximum conditional likelihood by full-batch steps with one step size for each weight (AdaGrad)."""
    model = Chain(np.zeros((n_features, n_labels)), np.zeros((n_labels, n_labels)), np.zeros(n_labels))
    used, local = np.unique(features, return_inverse=True)
    local = local.astype(np.int32).reshape(features.shape)
    weights = np.zeros((len(used), n_labels))
    seen = [np.full_like(x, 1e-8) for x in (weights, model.trans, model.start)]
    inner = np.ones(len(labels), bool)
    first = at[:-1][np.diff(at) > 0]
    inner[first] = False
    later = np.flatnonzero(inner)
    true_pairs = np.zeros_like(model.trans)
    np.add.at(true_pairs, (labels[later - 1], labels[later]), 1)
    gold = np.zeros((len(labels), n_labels))
    gold[np.arange(len(labels)), labels] = 1
    n = max(1, len(labels))
    for _ in range(rounds):
        now = Chain(weights, model.trans, model.start)
        marginal, expected, _ = forward_backward(now, scores(now, local), at, pairs=True)
        off = gold - marginal
        slope = np.stack([sum(np.bincount(local[:, k], off[:, j], len(used)) for k in range(local.shape[1])) for j in range(n_labels)], axis=1)
        for x, g, s in ((weights, slope, seen[0]), (model.trans, true_pairs - expected, seen[1]), (model.start, off[first].sum(axis=0), seen[2])):
            g = g / n - l2 * x / max(1, len(used)) ** 0.5
            s += g * g
            x += rate * g / np.sqrt(s)
    model.weights[used] = weights
    return model
