"""A skip-chain conditional random field: node potentials from hashed features, chain potentials between neighbours, skip potentials between like tokens.

Trained by pseudo-likelihood (each label given its neighbours' labels), which is concave; decoded by loopy belief propagation over the whole graph.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

#: Buckets of hashed features.
FEATURES = 1024
#: Skip potential of equal labels before training: of two nodes outside entities, and of two in entities of one kind.
SKIP_OUTSIDE, SKIP_ALIKE = 1.0, 4.0
#: Most rounds of messages, the largest change of a message at which they end, and the part of an old message that stays.
ROUNDS, STILL, DAMPING = 50, 1e-3, 0.3
STEPS, RATE, DECAY, DROPPED = 200, 0.05, 1e-3, 0.3


@dataclass
class Graph:
    """Nodes with features (feature[k] belongs to node owner[k]), directed chain links and skip links, and labels that are known (-1: not)."""

    n: int = 0
    feature: list[int] | np.ndarray = field(default_factory=list)
    owner: list[int] | np.ndarray = field(default_factory=list)
    chain: list[tuple[int, int]] | np.ndarray = field(default_factory=list)
    skip: list[tuple[int, int]] | np.ndarray = field(default_factory=list)
    label: list[int] | np.ndarray = field(default_factory=list)

    def links(self, name: str) -> np.ndarray:
        return np.array(getattr(self, name), np.int64).reshape(-1, 2).T


@dataclass
class Model:
    node: np.ndarray
    chain: np.ndarray
    skip: np.ndarray

    @classmethod
    def untrained(cls, labels: int) -> Model:
        skip = SKIP_ALIKE * np.eye(labels)
        skip[0, 0] = SKIP_OUTSIDE
        return cls(np.zeros((FEATURES, labels)), np.zeros((labels, labels)), skip)


def _sums(at: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Rows added up by place."""
    return np.column_stack([np.bincount(at, rows[:, c], n) for c in range(rows.shape[1])]) if len(at) else np.zeros((n, rows.shape[1]))


def _normal(x: np.ndarray, axis: int = -1) -> np.ndarray:
    """Log of the sum of exponents along an axis, which is kept."""
    top = x.max(axis, keepdims=True)
    return top + np.log(np.exp(x - top).sum(axis, keepdims=True))


def train(g: Graph, labels: int, seed: int = 0) -> Model:
    """Pseudo-likelihood with the untrained model as the prior's mean. Nodes outside entities that a skip link joins to an entity are unlabelled: they and
    their links teach nothing, as they may be what the labels miss."""
    model, prior = Model.untrained(labels), Model.untrained(labels)
    if not g.n:
        return model
    y, feature, owner = np.array(g.label), np.array(g.feature, np.int64), np.array(g.owner, np.int64)
    chain, skip = g.links("chain"), g.links("skip")
    unsure = np.zeros(g.n, bool)
    for a, b in (skip, skip[::-1]):
        unsure[a[(y[a] == 0) & (y[b] > 0)]] = True
    sure = ~unsure
    chain, skip = (x[:, sure[x[0]] & sure[x[1]]] for x in (chain, skip))
    one, rng = np.eye(labels), np.random.default_rng(seed)
    values = [model.node, model.chain, model.skip]
    means, moments, squares = [prior.node, prior.chain, prior.skip], [0.0] * 3, [0.0] * 3
    for step in range(1, STEPS + 1):
        keep = rng.random(len(feature)) >= DROPPED
        f, o = feature[keep], owner[keep]
        logits = _sums(o, values[0][f], g.n)
        logits += _sums(chain[1], values[1][y[chain[0]]], g.n) + _sums(chain[0], values[1].T[y[chain[1]]], g.n)
        logits += _sums(skip[1], values[2][y[skip[0]]], g.n) + _sums(skip[0], values[2][y[skip[1]]], g.n)
        error = (one[y] - np.exp(logits - _normal(logits))) * sure[:, None]
        skips = one[y[skip[0]]].T @ error[skip[1]] + one[y[skip[1]]].T @ error[skip[0]]
        slopes = [_sums(f, error[o], FEATURES), one[y[chain[0]]].T @ error[chain[1]] + error[chain[0]].T @ one[y[chain[1]]], (skips + skips.T) / 2]
        for k, slope in enumerate(slopes):
            slope = slope / sure.sum().clip(1) - DECAY * (values[k] - means[k])
            moments[k] = 0.9 * moments[k] + 0.1 * slope
            squares[k] = 0.99 * squares[k] + 0.01 * slope * slope
            values[k] += RATE * (moments[k] / (1 - 0.9**step)) / (np.sqrt(squares[k] / (1 - 0.99**step)) + 1e-6)
    return model


def marginals(g: Graph, model: Model) -> np.ndarray:
    """Probability of each label of each node, by messages over chain and skip links; known labels are evidence."""
    feature, owner = np.array(g.feature, np.int64), np.array(g.owner, np.int64)
    node, known = _sums(owner, model.node[feature], g.n), np.array(g.label, np.int64)
    at = np.flatnonzero(known >= 0)
    node[at] = -50.0
    node[at, known[at]] = 0.0
    chain, skip = g.links("chain"), g.links("skip")
    source, target = np.concatenate([chain[0], chain[1], skip[0], skip[1]]), np.concatenate([chain[1], chain[0], skip[1], skip[0]])
    c, s = chain.shape[1], skip.shape[1]
    back = np.concatenate([np.arange(c, 2 * c), np.arange(c), 2 * c + np.arange(s, 2 * s), 2 * c + np.arange(s)])
    tables = np.stack([model.chain, model.chain.T, model.skip])
    kind = np.repeat([0, 1, 2], [c, c, 2 * s])
    message = np.zeros((len(source), node.shape[1]))
    for _ in range(ROUNDS if len(source) else 0):
        belief = node + _sums(target, message, g.n)
        new = _normal((belief[source] - message[back])[:, :, None] + tables[kind], axis=1)[:, 0]
        new -= _normal(new)
        change = np.abs(new - message).max()
        message = new if change < STILL else DAMPING * message + (1 - DAMPING) * new
        if change < STILL:
            break
    belief = node + _sums(target, message, g.n)
    return np.exp(belief - _normal(belief))
