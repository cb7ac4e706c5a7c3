"""A linear-chain conditional random field over sparse features, fitted with numpy on a bounded sample."""

from __future__ import annotations

import numpy as np


def _logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def fit(sequences: list[list[list[int]]], tags: list[list[int]], free: np.ndarray, rounds: int = 40, rate: float = 0.3, ridge: float = 1e-6, most: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Weights of features (features x labels) and of transitions, by Adam on the mean log-likelihood with a ridge.

    A sequence is a list of positions, each a list of the features it has; ``free`` (features x labels) says which weights may differ from 0. Sequences of over ``most``
    positions are cut into several, so none is left out and padding stays small.
    """
    n_features, n_labels = free.shape
    parts = [(s[i : i + most], y[i : i + most]) for s, y in zip(sequences, tags, strict=True) for i in range(0, len(s), most)]
    n, t = len(parts), max(len(s) for s, _ in parts)
    live = np.arange(t)[None, :] < np.array([len(s) for s, _ in parts])[:, None]
    cell = np.flatnonzero(live.ravel())
    held = [ids for s, _ in parts for ids in s]
    sizes = np.array([len(ids) for ids in held])
    feature = np.fromiter((f for ids in held for f in ids), dtype=np.int64)
    place = np.repeat(cell, sizes)
    # Sums over the features of a cell and over the cells of a feature, each over stretches of one sorted list.
    filled, cell_starts = cell[sizes > 0], np.r_[0, sizes[sizes > 0].cumsum()[:-1]]
    by_feature = np.argsort(feature, kind="stable")
    used, feature_starts = np.unique(feature[by_feature], return_index=True)
    place_by_feature = place[by_feature]
    y = np.zeros((n * t, n_labels))
    y[cell, np.array([v for _, ys in parts for v in ys])] = 1
    y = y.reshape(n, t, n_labels)
    pairs = np.einsum("nti,ntj->ij", y[:, :-1], y[:, 1:])
    w, tr = np.zeros((n_features, n_labels)), np.zeros((n_labels, n_labels))
    moment = [np.zeros_like(w), np.zeros_like(tr)], [np.zeros_like(w), np.zeros_like(tr)]
    for step in range(1, rounds + 1):
        e = np.zeros((n * t, n_labels))
        e[filled] = np.add.reduceat(w[feature], cell_starts, axis=0)
        e = e.reshape(n, t, n_labels)
        alpha, beta = np.zeros((n, t, n_labels)), np.zeros((n, t, n_labels))
        alpha[:, 0] = e[:, 0]
        for k in range(1, t):
            alpha[:, k] = np.where(live[:, k, None], e[:, k] + _logsumexp(alpha[:, k - 1, :, None] + tr[None], axis=1), alpha[:, k - 1])
        for k in range(t - 2, -1, -1):
            beta[:, k] = np.where(live[:, k + 1, None], _logsumexp(tr[None] + (e[:, k + 1] + beta[:, k + 1])[:, None, :], axis=2), 0.0)
        z = _logsumexp(alpha[:, -1], axis=1)
        node = np.where(live[..., None], np.exp(alpha + beta - z[:, None, None]), 0.0)
        miss = (y - node).reshape(n * t, n_labels)
        gw = np.zeros_like(w)
        gw[used] = np.add.reduceat(miss[place_by_feature], feature_starts, axis=0)
        gw = gw / n * free - ridge * w
        edge = alpha[:, :-1, :, None] + tr[None, None] + (e + beta)[:, 1:, None, :] - z[:, None, None, None]
        edge = np.where(live[:, 1:, None, None], np.exp(np.minimum(edge, 0)), 0.0).sum(axis=(0, 1))
        gt = (pairs - edge) / n - ridge * tr
        for p, (value, g) in enumerate(((w, gw), (tr, gt))):
            moment[0][p][:] = 0.9 * moment[0][p] + 0.1 * g
            moment[1][p][:] = 0.99 * moment[1][p] + 0.01 * g * g
            value += rate / (1 + 3 * step / rounds) * (moment[0][p] / (1 - 0.9**step)) / (np.sqrt(moment[1][p] / (1 - 0.99**step)) + 1e-8)
    return w, tr


def decode(positions: list[list[int]], w: np.ndarray, tr: np.ndarray) -> list[int]:
    """The likeliest labels of one sequence."""
    score, back = None, []
    for ids in positions:
        own = w[ids].sum(axis=0)
        if score is None:
            score = own
            continue
        both = score[:, None] + tr
        back.append(both.argmax(axis=0))
        score = both.max(axis=0) + own
    path = [int(score.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1]
