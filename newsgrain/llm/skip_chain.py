"""A skip-chain conditional random field for names, with vectorised training and loopy belief propagation.

Nodes are the tokens that can be part of a name; chain edges join neighbours in the text, skip edges join repeated
tokens of one document however far apart, and similar ones (another ending of one word), so that clear evidence at one
place decides the unclear ones. All documents of a batch form one graph, and every step of message passing is a few
array operations over all its edges. Nodes with equal features share a row of them, so that scores are looked up and
errors are scattered once a row.

Training: node weights begin as a softmax regression over hashed features and potentials as the label pairs seen on
edges; then all of them are trained together, by the gradient of the likelihood whose marginals message passing gives.
Every step is a sum over all graphs, so they may stand anywhere. The regression needs only how often each row of features
has each label; messages of the training are in single precision, sums over them in double.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np

O, GIVEN, FAMILY = 0, 1, 2
LABELS = 3
FEATURE_BITS = 16
ROUNDS = 6
#: Steps of the regression and of the common training, and the bounds of the potentials at its start.
STEPS, JOINT_STEPS, BOUNDS = 8, 10, (4.0, 2.0, 2.0)


@dataclass
class Model:
    weights: np.ndarray  # features x labels
    potentials: list[np.ndarray]  # chain (left x right label), repeated tokens, similar tokens
    given: frozenset[str] = field(default_factory=frozenset)  # given names the features know


def empty_model() -> Model:
    return Model(np.zeros((1 << FEATURE_BITS, LABELS)), [np.zeros((LABELS, LABELS)) for _ in BOUNDS])


def _log_normal(x: np.ndarray) -> np.ndarray:
    x = x - x.max(axis=1, keepdims=True)
    return x - np.log(np.exp(x).sum(axis=1, keepdims=True))


def _edge_potential(told: np.ndarray, bound: float) -> np.ndarray:
    """Log of how much more often label pairs stand on an edge than by chance."""
    joint = told + 1
    joint /= joint.sum()
    return np.clip(np.log(joint / (joint.sum(axis=1, keepdims=True) * joint.sum(axis=0, keepdims=True))), -bound, bound)


def _scattered(features: np.ndarray, error: np.ndarray, size: int) -> np.ndarray:
    """Sum of the rows of `error` over the features of their nodes."""
    flat, width = features.ravel(), features.shape[1]
    return np.stack([np.bincount(flat, weights=np.repeat(error[:, k], width), minlength=size) for k in range(LABELS)], axis=1)


@dataclass
class Graph:
    features: np.ndarray  # distinct rows x F feature numbers
    told: np.ndarray  # distinct rows x labels: of how many nodes
    rows: np.ndarray  # n: the row of each node
    edges: Sequence[np.ndarray]  # chain, repeated and similar ones, each m x 2 node numbers
    pairs: Sequence[np.ndarray]  # label x label: of how many edges of each kind


def graph_of(features: np.ndarray, rows: np.ndarray, labels: np.ndarray, edges: Sequence[np.ndarray]) -> Graph:
    """The graph of labelled nodes."""
    told = np.bincount(rows * LABELS + labels, minlength=LABELS * len(features)).reshape(-1, LABELS)
    pairs = [np.bincount(labels[e[:, 0]] * LABELS + labels[e[:, 1]], minlength=LABELS * LABELS).reshape(LABELS, LABELS) for e in edges]
    return Graph(features, told, rows, edges, pairs)


def label_counts(graph: Graph) -> list[np.ndarray]:
    """How many nodes have each label, and how many edges of each kind each pair of labels."""
    return [graph.told.sum(axis=0).astype(float), *(p.astype(float) for p in graph.pairs)]


def gradient(model: Model, graph: Graph, joint: bool) -> list[np.ndarray]:
    """Sums over a graph: the errors of the nodes by feature and, if `joint`, the beliefs of label pairs of every kind of edge."""
    belief, pairs = _node_scores(model, graph.features), []
    if joint:
        belief, pairs = propagate(belief.astype(np.float32)[:, graph.rows], graph.edges, model.potentials)
        belief = np.exp(belief)
        expected = np.stack([np.bincount(graph.rows, weights=x, minlength=len(graph.features)) for x in belief], axis=1)
    else:
        expected = np.exp(belief).T * graph.told.sum(axis=1, keepdims=True)
    return [_scattered(graph.features, expected - graph.told, len(model.weights)), *(p.sum(axis=0, dtype=float) for p in pairs)]


def train(summed: Callable[[Callable[[Graph], list[np.ndarray]], bool], list[np.ndarray]], steps: int = STEPS, joint_steps: int = JOINT_STEPS, rate: float = 0.3) -> Model:
    """summed: adds up, over all graphs wherever they stand, the arrays that a function makes of one; told if it needs nodes and edges."""
    model = empty_model()
    nodes, *told = summed(label_counts, False)
    if not nodes.sum():
        return model
    seen = np.full((1 << FEATURE_BITS, 1), 1e-6)

    def step(g: np.ndarray, rate: float, decay: float) -> None:
        nonlocal seen
        g = g / nodes.sum() + decay * model.weights
        seen = seen + (g * g).sum(axis=1, keepdims=True)
        model.weights = model.weights - rate * g / np.sqrt(seen)

    for _ in range(steps):
        step(summed(lambda graph: gradient(model, graph, False), False)[0], rate, 1e-5)
    model.potentials = [_edge_potential(t, b) for t, b in zip(told, BOUNDS)]
    moved = [np.full((LABELS, LABELS), 1e-6) for _ in told]
    for _ in range(joint_steps):
        g, *pairs = summed(lambda graph: gradient(model, graph, True), True)
        step(g, 0.3 * rate, 1e-6)
        for k, (p, t) in enumerate(zip(pairs, told)):
            if not t.sum():
                continue
            g = (p - t) / t.sum() + 1e-3 * model.potentials[k]
            moved[k] += g * g
            model.potentials[k] = model.potentials[k] - 0.3 * rate * g / np.sqrt(moved[k])
    return model


def _normal(x: np.ndarray) -> np.ndarray:
    """Log-normalised over the labels, which are the rows."""
    top = np.maximum(np.maximum(x[0], x[1]), x[2])
    x = x - top
    e = np.exp(x)
    return x - np.log(e[0] + e[1] + e[2])


def _node_scores(model: Model, features: np.ndarray) -> np.ndarray:
    return _normal(np.ascontiguousarray(sum(model.weights[features[:, k]] for k in range(features.shape[1])).T))


def propagate(node: np.ndarray, edges: Sequence[np.ndarray], potentials: Sequence[np.ndarray], with_pairs: bool = True) -> tuple[np.ndarray, list[np.ndarray]]:
    """(log beliefs, labels x n; per kind of edge the beliefs of label pairs, m x labels x labels) by loopy sum-product with damping."""
    n = node.shape[1]
    every = np.concatenate(edges)
    m = len(every)
    if not m:
        return node, [np.zeros((0, LABELS, LABELS)) for _ in edges]
    cuts = np.cumsum([0, *(len(e) for e in edges)])
    kind = node.dtype
    odds = [np.exp(p).astype(kind) for p in potentials]
    kinds = [(slice(a, b), p) for a, b, p in zip(cuts, cuts[1:], odds)] + [(slice(m + a, m + b), p.T) for a, b, p in zip(cuts, cuts[1:], odds)]
    # exponents that neither precision overflows at
    most = 80 if kind == np.float32 else 300
    src, dst = np.concatenate((every[:, 0], every[:, 1])), np.concatenate((every[:, 1], every[:, 0]))
    # scores and messages are logs against the first label: two numbers each
    own = node[1:] - node[0]
    message = np.zeros((LABELS - 1, 2 * m), kind)

    def gathered() -> np.ndarray:
        return own + np.stack([np.bincount(dst, weights=x, minlength=n) for x in message]).astype(kind)

    def without(total: np.ndarray) -> np.ndarray:
        """What a node knows but for its neighbour on the edge."""
        out = np.stack([x.take(src) for x in total])
        out[:, :m] -= message[:, m:]
        out[:, m:] -= message[:, :m]
        return np.exp(np.clip(out, -most, most, out=out), out=out)

    for _ in range(ROUNDS):
        out = without(gathered())
        for part, p in kinds:
            x, y = out[0, part], out[1, part]
            first = p[0, 0] + p[1, 0] * x + p[2, 0] * y
            for k in range(1, LABELS):
                told = np.log((p[0, k] + p[1, k] * x + p[2, k] * y) / first)
                told += message[k - 1, part]
                np.multiply(told, kind.type(0.5), out=message[k - 1, part])
    total = gathered()
    pairs = []
    if with_pairs:
        out = np.concatenate((np.ones((1, 2 * m), kind), without(total)))
        out /= out.sum(axis=0)
        for part, p in kinds[: len(edges)]:
            x = out[:, None, part] * out[None, :, m + part.start : m + part.stop] * p[:, :, None]
            pairs.append((x / x.sum(axis=(0, 1))).transpose(2, 0, 1))
    return _normal(np.concatenate((np.zeros((1, n), kind), total))), pairs


def decode(model: Model, features: np.ndarray, rows: np.ndarray, edges: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(most probable label of every node, its probability); rows: the row of features of every node."""
    if not len(rows):
        return np.empty(0, dtype=np.int64), np.empty(0)
    belief, _ = propagate(_node_scores(model, features)[:, rows], edges, model.potentials, with_pairs=False)
    return belief.argmax(axis=0), np.exp(belief.max(axis=0))
