"""One regression tree in heap layout (root 0, children 2i+1 and 2i+2).

Rows are routed on their bin ids: numeric split ``bin <= split_bin`` goes
left (equivalently ``x < threshold``), a categorical split sends the codes in
its left set left, a missing value (bin -1) follows ``default_left``.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

#: Trees of up to so many splits above a level are met split by split, all rows at once, larger ones row by row.
FEW_SPLITS = 31


@dataclass
class Tree:
    depth: int
    feature: np.ndarray = field(default=None)       # int32, -1 = leaf / unused
    split_bin: np.ndarray = field(default=None)     # int32
    default_left: np.ndarray = field(default=None)  # bool
    is_cat: np.ndarray = field(default=None)        # bool
    value: np.ndarray = field(default=None)         # float64, leaf output (learning rate applied)
    weight: np.ndarray = field(default=None)        # float64, raw node weight (bounded)
    gain: np.ndarray = field(default=None)          # float64, split loss change
    cover: np.ndarray = field(default=None)         # float64, hessian sum
    count: np.ndarray = field(default=None)         # int64, rows
    lower: np.ndarray = field(default=None)
    upper: np.ndarray = field(default=None)
    used: np.ndarray = field(default=None)          # bool, node exists
    cat_left: dict = field(default_factory=dict)    # node -> sorted int array of left codes
    _cat_matrix: tuple | None = field(default=None, repr=False)

    @classmethod
    def empty(cls, depth: int) -> "Tree":
        h = 2 ** (depth + 1) - 1
        return cls(depth=depth,
                   feature=np.full(h, -1, np.int32), split_bin=np.zeros(h, np.int32),
                   default_left=np.zeros(h, bool), is_cat=np.zeros(h, bool),
                   value=np.zeros(h), weight=np.zeros(h), gain=np.zeros(h), cover=np.zeros(h),
                   count=np.zeros(h, np.int64), lower=np.full(h, -np.inf),
                   upper=np.full(h, np.inf), used=np.zeros(h, bool))

    def cat_matrix(self) -> tuple[np.ndarray, np.ndarray] | None:
        """(row of each node, rows of left codes as flags); only categorical nodes have a row of their own."""
        if not self.cat_left:
            return None
        if self._cat_matrix is None:
            width = 1 + max((int(v.max()) if len(v) else 0) for v in self.cat_left.values())
            at = np.zeros(len(self.feature), np.int64)
            m = np.zeros((1 + len(self.cat_left), width), bool)
            for k, (node, codes) in enumerate(self.cat_left.items(), 1):
                at[node] = k
                m[k, codes] = True
            self._cat_matrix = at, m
        return self._cat_matrix

    def route(self, bins: np.ndarray, levels: int | None = None) -> np.ndarray:
        """Node reached by each row after ``levels`` levels (default: to a leaf)."""
        n = bins.shape[0]
        if self._few_splits(levels):
            return self._picked(bins, np.arange(len(self.feature)), levels)
        node = np.zeros(n, np.int64)
        rows = np.arange(n)
        catm = self.cat_matrix()
        for _ in range(self.depth if levels is None else levels):
            f = self.feature[node]
            internal = f >= 0
            if not internal.any():
                break
            b = bins[rows, np.where(internal, f, 0)]
            left = b <= self.split_bin[node]
            if catm is not None:
                at, flags = catm
                w = flags.shape[1]
                in_set = flags[at[node], np.clip(b, 0, w - 1)] & (b >= 0) & (b < w)
                left = np.where(self.is_cat[node], in_set, left)
            left = np.where(b < 0, self.default_left[node], left)
            node = np.where(internal, 2 * node + 2 - left.astype(np.int64), node)
        return node

    def predict(self, bins: np.ndarray) -> np.ndarray:
        if self._few_splits():
            return self._picked(bins, self.value)
        return self.value[self.route(bins)]

    def _few_splits(self, levels: int | None = None) -> bool:
        levels = self.depth if levels is None else levels
        return int((self.feature[:(1 << min(levels, 40)) - 1] >= 0).sum()) <= FEW_SPLITS

    def _picked(self, bins: np.ndarray, of_node: np.ndarray, levels: int | None = None) -> np.ndarray:
        """``of_node`` at the node that each row reaches after ``levels`` levels."""
        levels = self.depth if levels is None else levels

        def at(node: int, d: int):
            f = int(self.feature[node])
            if d == levels or f < 0:
                return of_node[node]
            went, left, right = self._goes_left(node, bins[:, f]), at(2 * node + 1, d + 1), at(2 * node + 2, d + 1)
            if isinstance(left, np.ndarray) or isinstance(right, np.ndarray):
                return np.where(went, left, right)
            return np.array([right, left]).take(went.view(np.int8), mode="clip")

        found = at(0, 0)
        return found if isinstance(found, np.ndarray) else np.full(len(bins), found)

    def routing(self) -> "Tree":
        """What routes and scores rows, without the rest, in narrow types: the form that travels to tasks."""
        last = int(np.flatnonzero(self.used).max(initial=0)) + 1 if self.used is not None else len(self.feature)
        last = max(last, 1 + int(np.flatnonzero(self.feature >= 0).max(initial=-1)))
        end = min(len(self.feature), 2 * last + 1)     # children of the last split are there
        return Tree(depth=self.depth, feature=self.feature[:end].astype(np.int32), split_bin=self.split_bin[:end],
                    default_left=self.default_left[:end], is_cat=self.is_cat[:end], value=self.value[:end],
                    cat_left={n: c.astype(np.int32) for n, c in self.cat_left.items() if n < end})

    def _goes_left(self, node: int, b: np.ndarray) -> np.ndarray:
        if self.is_cat[node]:
            codes = np.asarray(self.cat_left.get(node, ()), np.int64)
            flags = np.zeros(2 + int(codes.max(initial=-1)) + 1, bool)     # missing, the codes, all above
            flags[0], flags[codes + 1] = self.default_left[node], True
            return flags[np.minimum(b.astype(np.int64) + 1, len(flags) - 1)]
        left = b <= self.split_bin[node]
        return left if self.default_left[node] else left & (b >= 0)

    def reach(self, bins: np.ndarray, free: int, counts: np.ndarray) -> None:
        """Adds to ``counts`` the rows at each leaf when splits on feature ``free`` let a row through to both sides."""
        todo = [(0, np.arange(len(bins)))]
        while todo:
            node, rows = todo.pop()
            f = int(self.feature[node])
            if f < 0:
                counts[node] += len(rows)
            elif f == free:
                todo += [(2 * node + 1, rows), (2 * node + 2, rows)]
            else:
                left = self._goes_left(node, bins[rows, f])
                todo += [(2 * node + 1, rows[left]), (2 * node + 2, rows[~left])]

    def leaves_by_bin(self, free: int, bins: list[int]) -> list[tuple[int, list[int]]]:
        """Each leaf with those of ``bins`` that meet the splits on feature ``free`` above it."""
        out, todo = [], [(0, np.array(bins, np.int64))]
        while todo:
            node, met = todo.pop()
            f = int(self.feature[node])
            if f < 0:
                out.append((node, met.tolist()))
                continue
            left = self._goes_left(node, met) if f == free else np.ones(len(met), bool)
            right = ~left if f == free else left
            todo += [(2 * node + 1, met[left]), (2 * node + 2, met[right])]
        return out
