"""Gradient boosting of one fold within a task: the trees of Spark's GBTRegressor, without a job per tree level."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

# Rounds end when none of the last PATIENCE has an error on the held-out tenth that is lower by more than TOLERANCE
# than the one before them; those up to the smallest error are kept.
PATIENCE, TOLERANCE = 10, 1e-7
MAX_BINS, DEPTH, STEP, LEAST_ROWS = 255, 6, 0.08, 5
EPSILON = np.finfo(float).eps
# In a leaf every bin goes to the left.
ALL = MAX_BINS


def chosen_rounds(errors: list[float], patience: int = PATIENCE, tolerance: float = TOLERANCE) -> int | None:
    """Rounds to keep by the stop rule; None if the errors end before it holds."""
    for last in range(patience, len(errors)):
        if min(errors[last - patience + 1 : last + 1]) >= errors[last - patience] - tolerance:
            return errors.index(min(errors[: last + 1])) + 1
    return None


def edges(values: np.ndarray, weights: np.ndarray, most: int = MAX_BINS) -> np.ndarray:
    """Split points of a feature: between all its values, or at even steps of weight where it has more than bins."""
    found, at = np.unique(values, return_inverse=True)
    splits = min(most, len(values)) - 1
    middle = (found[:-1] + found[1:]) / 2
    if len(middle) <= splits:
        return middle
    count = np.cumsum(np.bincount(at, weights))
    stride = target = weights.sum() / (splits + 1)
    kept = []
    for i in range(len(middle)):
        if abs(count[i] - target) < abs(count[i + 1] - target):
            kept.append(middle[i])
            target += stride
    return np.array(kept)


def binned(values: np.ndarray, points: list[np.ndarray]) -> np.ndarray:
    """Bins of features (rows of ``values``); a value at a split point lies to its left."""
    return np.stack([np.searchsorted(p, v, "left") for p, v in zip(points, values)]).astype(np.uint8)


def _impurity(weight: np.ndarray, total: np.ndarray, squares: np.ndarray) -> np.ndarray:
    return (squares - total * total / weight) / weight


def grown(bins: np.ndarray, widths: list[int], y: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A regression tree by variance, level by level: feature, last bin to the left and value of the nodes, node ``p`` above
    ``2 p + 1`` and ``2 p + 2``. Of equal gains the first feature and split is taken."""
    nodes = 2 ** (DEPTH + 1) - 1
    feature, split, value = np.zeros(nodes, np.int64), np.full(nodes, ALL), np.zeros(nodes)
    moments = (weights, weights * y, weights * y * y)
    place, stats = np.zeros(1, np.int64), np.array([[m.sum()] for m in moments])
    value[0] = stats[1, 0] / stats[0, 0]
    rows, node = np.arange(len(y)), np.zeros(len(y), np.int64)
    for _ in range(DEPTH):
        k = len(place)
        if not k:
            break
        each, own = np.arange(k), [m[rows] for m in moments]
        gain, best, cut = np.zeros(k), np.full(k, -1), np.zeros(k, np.int64)
        left, right = np.zeros((3, k)), np.zeros((3, k))
        impurity = _impurity(*stats)[:, None]
        for f, width in enumerate(widths):
            if width < 2:
                continue
            at = node * width + bins[f, rows]
            n, *sums = (np.cumsum(np.bincount(at, m, k * width).reshape(k, width), axis=1) for m in (None, *own))
            low, high = [s[:, :-1] for s in sums], [s[:, -1:] - s[:, :-1] for s in sums]
            some = (n[:, :-1] >= LEAST_ROWS) & (n[:, -1:] - n[:, :-1] >= LEAST_ROWS)
            with np.errstate(divide="ignore", invalid="ignore"):
                whole = low[0] + high[0]
                got = impurity - low[0] / whole * _impurity(*low) - high[0] / whole * _impurity(*high)
            got = np.where(some, got, -np.inf)
            first = got.argmax(axis=1)
            more = np.flatnonzero(got[each, first] > gain)
            gain[more], best[more], cut[more] = got[more, first[more]], f, first[more]
            for i in range(3):
                left[i, more], right[i, more] = low[i][more, first[more]], high[i][more, first[more]]
        parted = best >= 0
        feature[place[parted]], split[place[parted]] = best[parted], cut[parted]
        below = np.stack([2 * place + 1, 2 * place + 2], axis=1)
        stats = np.stack([left, right], axis=2)  # moment, node, side
        with np.errstate(divide="ignore", invalid="ignore"):
            value[below[parted]] = stats[1, parted] / stats[0, parted]
            opened = parted[:, None] & (np.abs(_impurity(*stats)) >= EPSILON)
        number = np.cumsum(opened).reshape(opened.shape) - 1
        side = (bins[best[node], rows] > cut[node]).astype(np.int64)
        stay = opened[node, side]
        rows, node = rows[stay], number[node, side][stay]
        place, stats = below[opened], stats[:, opened]
    for p in np.flatnonzero(split[: nodes // 2] == ALL):  # what ends early hands its value down
        value[2 * p + 1] = value[p]
    return feature, split, value


def fallen(tree: tuple[np.ndarray, np.ndarray, np.ndarray], bins: np.ndarray) -> np.ndarray:
    """The value of the leaf of every row."""
    feature, split, value = tree
    at, rows = np.zeros(bins.shape[1], np.int64), np.arange(bins.shape[1])
    for _ in range(DEPTH):
        at = 2 * at + 1 + (bins[feature[at], rows] > split[at])
    return value[at]


def boosted(train: np.ndarray, y: np.ndarray, weights: np.ndarray, others: np.ndarray, rounds: int) -> Iterator[np.ndarray]:
    """Predictions of the rows of ``others`` after each round. Features are the first axis of both.

    The first tree is taken whole, the others, which are fitted to twice the residuals, by STEP.
    """
    points = [edges(v, weights) for v in train]
    bins, asked, widths = binned(train, points), binned(others, points), [len(p) + 1 for p in points]
    own, found = np.zeros(len(y)), np.zeros(others.shape[1])
    for k in range(rounds):
        tree = grown(bins, widths, 2 * (y - own) if k else y, weights)
        step = STEP if k else 1.0
        own, found = own + step * fallen(tree, bins), found + step * fallen(tree, asked)
        yield found


def fitted(features: np.ndarray, y: np.ndarray, weights: np.ndarray, held: np.ndarray, rounds: int) -> np.ndarray:
    """Predictions of all rows by boosting of those with a weight, by the rule of ``models.fit_risk``."""
    known = weights > 0
    fit, judged = known & ~held, known & held
    kept = min(rounds, PATIENCE)
    if fit.any() and judged.any():
        errors, kept = [], None
        for found in boosted(features[:, fit], y[fit], weights[fit], features[:, judged], rounds):
            errors.append(float(np.average((y[judged] - found) ** 2, weights=weights[judged])))
            kept = chosen_rounds(errors)
            if kept:
                break
        kept = kept or errors.index(min(errors)) + 1
    for found in boosted(features[:, known], y[known], weights[known], features, kept):
        pass
    return found
