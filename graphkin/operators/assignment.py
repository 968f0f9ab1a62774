"""Optimal and greedy one-to-one assignment on the distance matrix of each block."""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.distance import LIMB
from ..functions.schema import FeatureVector

LARGEST = 10_240  # distinct vectors of a side up to which a task keeps the whole matrix; beyond, it computes rows when it needs them
SPARE = 300  # of so many columns one may be left over for paths to start from all rows at once


def flows(cost: np.ndarray | Costs, rows: np.ndarray, cols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, units) of the least total cost, where row i has rows[i] units and column j takes cols[j]; all units of the smaller side are placed.

    Shortest paths from all rows with units left at once, until half of them have
    a way to a free column; each way that is still open then carries as many units
    as its ends and the flows that it turns back allow.  Columns that no row needs
    go to one more row, which costs nothing; where they are many, it would be in
    every way, and paths start from one row at a time instead.
    """
    if rows.sum() > cols.sum():
        c, r, k = flows(cost.T, cols, rows)
        return r, c, k
    n, m = cost.shape
    u, v, nothing, spare = np.zeros(n + 1), np.zeros(m), np.zeros(m), int(cols.sum() - rows.sum())
    few = spare * SPARE <= cols.sum()
    left, free = [*rows.tolist(), spare if few else 0], cols.tolist()
    at: list[dict[int, int]] = [{} for _ in range(m)]  # units by row at each column
    for i in range(n):
        line = cost[i]
        j = int(np.argmin(line))
        u[i], k = line[j], min(left[i], free[j])
        if k:
            at[j][i] = k
            left[i], free[j] = left[i] - k, free[j] - k
    for j in range(m):
        if k := min(left[n], free[j]):
            at[j][n] = k
            left[n], free[j] = left[n] - k, free[j] - k
    while starts := [i for i, k in enumerate(left) if k][: None if few else 1]:
        near, came, open_ = np.full(m, np.inf), np.zeros(m, dtype=int), v.copy()
        reached, root, settled, ends, ready, fresh, far = dict.fromkeys(starts, (0.0, -1)), {i: i for i in starts}, [], [], set(), starts, 0.0
        while len(settled) < m and 2 * len(ready) < len(starts):
            for r in fresh:
                d = (cost[r] if r < n else nothing) - open_
                d += far - u[r]
                better = np.flatnonzero(d < near)
                near[better] = d[better]
                came[better] = r
            j = int(np.argmin(near))
            far, near[j], open_[j] = near[j], np.inf, -np.inf
            settled.append((j, far))
            own = root[int(came[j])]
            if free[j]:
                ends.append(j)
                ready.add(own)
            fresh = [r for r in at[j] if r not in reached]
            reached |= dict.fromkeys(fresh, (far, j))
            root |= dict.fromkeys(fresh, own)
        for j in ends:
            steps, k, c = [], free[j], j
            while c >= 0:
                r = int(came[c])
                steps.append((r, c))
                c = reached[r][1]
                k = min(k, left[r] if c < 0 else at[c].get(r, 0))
            if not k:
                continue
            for r, c in steps:
                at[c][r] = at[c].get(r, 0) + k
                back = reached[r][1]
                if back >= 0:
                    at[back][r] -= k
                    if not at[back][r]:
                        del at[back][r]
            left[r], free[j] = left[r] - k, free[j] - k
        for r, (d, _) in reached.items():
            u[r] += far - d
        for c, d in settled:
            v[c] -= far - d
    found = np.array(sorted((r, c, k) for c, own in enumerate(at) for r, k in own.items() if r < n), dtype=int).reshape(-1, 3)
    return found[:, 0], found[:, 1], found[:, 2]


def solve(cost: np.ndarray | Costs, row_class: np.ndarray | None = None, column_class: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(rows, columns) of the assignment of the smaller side with the least total cost.

    With classes, cost is that of each pair of classes, and rows of a class are alike: they are placed together.
    """
    row_class, column_class = _classes(cost, row_class, column_class)
    a, b = _members(row_class, cost.shape[0]), _members(column_class, cost.shape[1])
    used, taken, rows, columns = [0] * len(a), [0] * len(b), [], []
    for i, j, k in zip(*(x.tolist() for x in flows(cost, np.array([len(x) for x in a]), np.array([len(x) for x in b]))), strict=True):
        rows.append(a[i][used[i] : used[i] + k])
        columns.append(b[j][taken[j] : taken[j] + k])
        used[i], taken[j] = used[i] + k, taken[j] + k
    rows, columns = np.concatenate([*rows, np.zeros(0, int)]), np.concatenate([*columns, np.zeros(0, int)])
    order = np.argsort(rows)
    return rows[order], columns[order]


def greedy(cost: np.ndarray | Costs, row_class: np.ndarray | None = None, column_class: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Row by row, the column (not yet taken) of the least cost among those with no smaller cost to their right in the row or below in the column.

    The least cost of a row and those below changes only after the last row of a class.
    It is kept for one stretch of these ends at a time, and for the starts of all stretches.
    Of each column class the largest place that is not taken says what is to the right.
    Costs are looked at from the least on; those with a smaller one to their right leave.
    """
    row_class, column_class = _classes(cost, row_class, column_class)
    last = np.array([x[-1] for x in _members(row_class, cost.shape[0])])
    order = np.argsort(last)
    n, width = len(order), max(1, int(np.sqrt(len(order))))
    starts, least, after = range(0, n, width), np.full(cost.shape[1], np.inf), {}
    for a in reversed(starts):
        after[a] = least
        least = np.minimum(least, _lines(cost, order[a : a + width]).min(0))
    left = [x.tolist() for x in _members(column_class, cost.shape[1])]
    top, rows, columns, end, held = np.array([x[-1] for x in left]), [], [], 0, -1
    for i, c in enumerate(row_class.tolist()):
        while last[order[end]] < i:
            end += 1
        if end // width != held:
            held, lines, below = end // width, None, None  # give back the memory first
            own = order[held * width : (held + 1) * width]
            lines = _lines(cost, own)
            below, least = np.empty_like(lines), after.pop(held * width)
            for k in reversed(range(len(own))):
                least = np.minimum(least, lines[k], out=below[k])
        line = lines[end - held * width] if order[end] == c else cost[c]
        may = np.flatnonzero((line <= below[end - held * width]) & (top >= 0))
        while len(may):
            least = line[may].min()
            right = top[line < least].max(initial=-1)  # the largest place of a smaller cost
            may = may[top[may] > right]
            if not len(may):
                break
            near = may[line[may] == least]
            if len(near):
                j, x = min((left[x][bisect_right(left[x], right)], x) for x in near.tolist())
                rows.append(i)
                columns.append(j)
                left[x].remove(j)
                top[x] = left[x][-1] if left[x] else -1
                break
    return np.array(rows, dtype=int), np.array(columns, dtype=int)


def _lines(cost: np.ndarray | Costs, rows: np.ndarray) -> np.ndarray:
    """Several rows of the matrix."""
    return cost[rows] if isinstance(cost, np.ndarray) else cost.block(rows)


def _classes(cost: np.ndarray | Costs, rows: np.ndarray | None, columns: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    return np.arange(cost.shape[0]) if rows is None else rows, np.arange(cost.shape[1]) if columns is None else columns


def _members(classes: np.ndarray, n: int) -> list[np.ndarray]:
    """The places of each class, ascending."""
    return np.split(np.argsort(classes, kind="stable"), np.cumsum(np.bincount(classes, minlength=n))[:-1])


def _alike(rows: pd.DataFrame, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(class of each row, first row of each class): rows of equal vectors."""
    seen: dict[tuple, int] = {}
    plain = lambda v: v if v is None or np.isscalar(v) else tuple(v)
    classes = np.array([seen.setdefault(key, len(seen)) for key in zip(*(map(plain, rows[c]) for c in names), strict=True)], dtype=int)
    return classes, np.unique(classes, return_index=True)[1]


def _number(limbs) -> int:
    return sum(int(x) << (LIMB * k) for k, x in enumerate(limbs if limbs is not None else ()))


class Costs:
    """The matrix of the mean of the features' distances for every pair of rows, of which each row is computed when it is asked for."""

    def __init__(self, parts: list[tuple], shape: tuple[int, int]) -> None:
        self.parts, self.shape = parts, shape

    @classmethod
    def of(cls, left: pd.DataFrame, right: pd.DataFrame, vector: FeatureVector) -> Costs:
        def column(values: pd.Series, metric: str) -> tuple:
            if metric == "point":
                return values.to_numpy(float), None
            if metric == "euclid":
                x = np.array(values.tolist(), float).reshape(len(values), -1)
                return x, np.sqrt((x * x).sum(1))
            return [_number(v) for v in values], None

        for f in vector.features:
            if f.measure and not f.among:
                raise ValueError(f"feature {f.name} has a distance of its own; assignment needs it among values, too")
        parts = [(f.among, (left[f.name].tolist(), None), (right[f.name].tolist(), None)) if f.among else (f.metric, column(left[f.name], f.metric), column(right[f.name], f.metric)) for f in vector.features]
        return cls(parts, (len(left), len(right)))

    @property
    def T(self) -> Costs:  # noqa: N802
        return Costs([(metric, b, a) for metric, a, b in self.parts], self.shape[::-1])

    def __getitem__(self, i: int) -> np.ndarray:
        total = np.zeros(self.shape[1])
        for metric, (x, x_size), (y, y_size) in self.parts:
            if callable(metric):
                total += metric(x[i], y)
                continue
            if metric == "point":
                top, gap = np.maximum(x[i], y), np.abs(x[i] - y)
            elif metric == "euclid":
                top, gap = np.maximum(x_size[i], y_size), np.sqrt(((x[i] - y) ** 2).sum(1))
            else:
                d = [x[i] ^ q for q in y]
                gap, top = np.array([v.bit_count() for v in d], float), np.array([v.bit_length() for v in d], float)
            total += np.divide(gap, top, out=np.zeros_like(total), where=top != 0)
        return total / len(self.parts)

    def block(self, rows: np.ndarray) -> np.ndarray:
        """Several rows.  Squares of whole numbers are taken by products of matrices, which are as exact."""
        out = np.zeros((len(rows), self.shape[1]))
        whole = [metric == "euclid" and all(np.all(z == np.rint(z)) and np.abs(z).max(initial=0) < 1 << 22 for z in (x, y)) for metric, (x, _), (y, _) in self.parts]
        if not all(w or metric == "point" for w, (metric, _, _) in zip(whole, self.parts, strict=True)):
            for k, i in enumerate(rows):
                out[k] = self[i]
            return out
        for start in range(0, len(rows), 8):  # what fits the cache
            own, total = rows[start : start + 8], out[start : start + 8]
            for metric, (x, x_size), (y, y_size) in self.parts:
                if metric == "point":
                    gap = np.subtract(x[own, None], y)
                    np.abs(gap, out=gap)
                    top = np.maximum(x[own, None], y)
                else:
                    gap = x[own] @ y.T
                    gap *= -2.0
                    gap += (x[own] * x[own]).sum(1)[:, None] + (y * y).sum(1)
                    np.sqrt(gap, out=gap)
                    top = np.maximum(x_size[own, None], y_size)
                if top.min(initial=1.0) > 0:
                    gap /= top
                else:
                    gap = np.divide(gap, top, out=np.zeros_like(gap), where=top != 0)
                total += gap
            total /= len(self.parts)
        return out

    def between(self, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
        """The cost of each of these pairs."""
        total = np.zeros(len(rows))
        for metric, (x, x_size), (y, y_size) in self.parts:
            if callable(metric):
                total += np.array([metric(x[i], [y[j]])[0] for i, j in zip(rows.tolist(), columns.tolist(), strict=True)], float)
                continue
            if metric == "point":
                top, gap = np.maximum(x[rows], y[columns]), np.abs(x[rows] - y[columns])
            elif metric == "euclid":
                top, gap = np.maximum(x_size[rows], y_size[columns]), np.sqrt(((x[rows] - y[columns]) ** 2).sum(1))
            else:
                d = [x[i] ^ y[j] for i, j in zip(rows.tolist(), columns.tolist(), strict=True)]
                gap, top = np.array([v.bit_count() for v in d], float), np.array([v.bit_length() for v in d], float)
            total += np.divide(gap, top, out=np.zeros_like(total), where=top != 0)
        return total / len(self.parts)

    def whole(self) -> np.ndarray:
        out = np.empty(self.shape)
        for i in range(self.shape[0]):
            out[i] = self[i]
        return out


def distances(left: pd.DataFrame, right: pd.DataFrame, vector: FeatureVector) -> np.ndarray:
    """The mean of the features' distances for every pair of rows."""
    return Costs.of(left, right, vector).whole()


def pairs(left: pd.DataFrame, right: pd.DataFrame, vector: FeatureVector, *, how: str = "optimal", largest: int = LARGEST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, columns, distances) of the assignment of one block; rows of equal vectors are one row of the matrix."""
    (a, a_first), (b, b_first) = _alike(left, vector.names), _alike(right, vector.names)
    cost = Costs.of(left.iloc[a_first], right.iloc[b_first], vector)
    if max(cost.shape) <= largest:
        cost = cost.T.whole().T if how == "optimal" and len(a) > len(b) else cost.whole()  # solved by rows of the smaller side
    r, c = (solve if how == "optimal" else greedy)(cost, a, b)
    d = cost[a[r], b[c]] if isinstance(cost, np.ndarray) else cost.between(a[r], b[c])
    return r, c, d


def assign(left: DataFrame, right: DataFrame, vector: FeatureVector, *, how: str = "optimal", largest: int = LARGEST) -> DataFrame:
    """block, lhs_pk, rhs_pk, distance.  left and right: block (string), pk (bigint), the vector's columns.

    Every block is assigned as a whole, in one task.  Up to ``largest`` distinct
    vectors on each side the task keeps the block's matrix; beyond, it computes rows
    of it again and again, which takes longer and gives the same result.
    """
    names = ["block", "pk", *vector.names]
    a, b = left.select(*names), right.select(*names)

    def run(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if x.empty or y.empty:
            return pd.DataFrame({"block": [], "lhs_pk": [], "rhs_pk": [], "distance": []}).astype({"block": object, "lhs_pk": "int64", "rhs_pk": "int64", "distance": float})
        x, y = x.sort_values("pk", ignore_index=True), y.rename(columns=lambda c: c.removeprefix("r_")).sort_values("pk", ignore_index=True)
        r, c, d = pairs(x, y, vector, how=how, largest=largest)
        return pd.DataFrame({"block": x["block"].iloc[0], "lhs_pk": x["pk"].to_numpy()[r], "rhs_pk": y["pk"].to_numpy()[c], "distance": d}).astype({"distance": float})

    b = b.select(*(F.col(c).alias(f"r_{c}") for c in b.columns))  # both sides may be one table
    return a.groupBy("block").cogroup(b.groupBy("r_block")).applyInPandas(run, "block string, lhs_pk bigint, rhs_pk bigint, distance double")
