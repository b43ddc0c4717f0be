"""The histogram pass (M6), subsampling (M12) and what rides on it.

A pass is one ``mapInArrow`` over the state's blocks.  Each task routes its rows through the partial
tree of every model being built, turns gradients and hessians into integers (one power of two per
model and tree, from a bound of the values), and adds them per (open node, allowed feature, bin).
Integer sums are exact, so cells and all that follows from them are bit-equal for any
partitioning.  Only non-empty cells leave a task.

Of two sibling nodes only the smaller is built.  A task hands each of its cells on twice, to its
node and, negated, to the sibling; the parent's cells, kept from the level before, are added to the sibling (M7).
What the JVM sums up is then the sibling's own histogram, exactly.

On a tree's first level the pass also sums each model's validation loss and percentage error (exactly,
too) and takes the largest gradient and hessian, which bound those of the next tree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import cache
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...functions.metrics import MAPE_EPS
from . import objectives
from .exact import as_integers, split_sums
from .state import Block, State
from .tree import Tree

#: ``feature`` of rows that are not a feature's cells: a node's totals, sums of metrics.
TOTALS, METRICS = -1, -2
LOSS, APE, ROWS, TOP = range(4)

CELLS = "model int, node int, feature int, bin int, dir int, lower double, upper double, G long, H long, C long"
_NAMES = [c.split()[0] for c in CELLS.split(", ")]
_KINDS = {"int": pa.int32(), "double": pa.float64(), "long": pa.int64()}
_ARROW = pa.schema([(c.split()[0], _KINDS[c.split()[1]]) for c in CELLS.split(", ")])

#: Cells of dense histograms in a task, over all models; beyond it a model keeps only the touched ones.
DENSE_MAX_CELLS = 8_000_000
#: Features whose bins together make up to so many cells are added up as one, and taken apart at a task's end.
BUNDLE_CELLS = 1 << 13
#: Touched cells gathered before they are merged.
SPARSE_MERGE = 1_000_000
#: Trees not yet in the margins are met as one table of up to so many cells, one per way their splits can fall out.
TABLE_CELLS = 1 << 16


def sample_constants(seed: int, tree: int) -> tuple[int, int]:
    """Multiplier (odd) and offset of a tree's row sample."""
    h = hashlib.md5(f"{seed}:{tree}".encode()).hexdigest()
    return int(h[:15], 16) | 1, int(h[15:30], 16)


def sampled(kh: np.ndarray, seed: int, tree: int, share: float) -> np.ndarray:
    """Rows in a tree's sample: (hash * a + b) mod 2**64 below the share of 2**64."""
    a, b = sample_constants(seed, tree)
    with np.errstate(over="ignore"):
        u = kh.astype(np.uint64) * np.uint64(a) + np.uint64(b)
    return u < np.uint64(min(int(share * 2.0**64), 2**64 - 1))


@dataclass
class Builder:
    """One model's tree under construction at one level."""
    model: int
    holdout: int
    tree: Tree
    level: int
    nodes: np.ndarray               # nodes whose histograms are built from rows
    siblings: np.ndarray            # per node the sibling derived from it, -1: none
    lower: np.ndarray               # bounds per node of the heap
    upper: np.ndarray
    features: np.ndarray            # allowed feature ids
    dirs: np.ndarray                # monotone direction per allowed feature
    bits: tuple[int, int]           # scales of gradient and hessian


@dataclass
class PassPlan:
    objective: str
    width: int                      # max bins + 1 (slot 0 is the missing bin)
    widths: list                    # bins + 1 of each feature
    test_fold: int
    subsample: float
    seed: int
    tree_index: int
    bases: list                     # start margin per model
    pending: dict = field(default_factory=dict)     # model -> list[Tree] not yet in the margins
    metrics: list = field(default_factory=list)     # [(model, holdout)]: validation sums
    tops: list = field(default_factory=list)        # [(model, holdout)]: largest gradient and hessian
    builders: list = field(default_factory=list)    # [Builder]
    dense_max_cells: int = DENSE_MAX_CELLS


def margin_of(block: Block, model: int, bases: list, pending: dict) -> np.ndarray:
    m = np.full(len(block.bins), bases[model]) if block.margins is None else block.margins[model].copy()
    for t in pending.get(model, ()):
        m += t.predict(block.bins)
    return m


class Table:
    """A start margin and the trees upon it as one table: a row's place in it is a sum over the features of what its bins
    meet of their splits.  A cell holds what ``margin_of`` adds up for its rows, in the same order."""

    def __init__(self, codes: dict[int, np.ndarray], values: np.ndarray):
        self.codes, self.values = codes, values

    @classmethod
    def of(cls, trees: list, base: float, widths: list) -> "Table | None":
        """None where there is nothing to save: one tree, or more than ``TABLE_CELLS`` cells."""
        if len(trees) < 2:
            return None
        splits: dict[int, list[tuple[Tree, int]]] = {}
        for t in trees:
            for n in np.flatnonzero(t.feature >= 0).tolist():
                splits.setdefault(int(t.feature[n]), []).append((t, n))
        if any(widths[f] > TABLE_CELLS for f in splits):
            return None
        size, codes, firsts = 1, {}, {}
        for f, met in sorted(splits.items()):
            bins = np.arange(-1, widths[f] - 1)
            # Bins that go the same way at every split on the feature share a code.
            went = np.packbits(np.stack([t._goes_left(n, bins) for t, n in met]), axis=0)
            _, first, code = np.unique(went, axis=1, return_index=True, return_inverse=True)
            codes[f], firsts[f] = code.reshape(-1).astype(np.intp) * size, (bins[first], size)
            size *= len(first)
            if size > TABLE_CELLS:
                return None
        met = np.zeros((len(widths), size), np.int32)
        for f, (bins, step) in firsts.items():
            met[f] = bins[np.arange(size) // step % len(bins)]
        values = np.full(size, base)
        for t in trees:
            values += t.predict(met.T)
        return cls(codes, values)

    def margins(self, slots: Callable[[int], np.ndarray], n: int) -> np.ndarray:
        """The rows' margins; ``slots(f)`` are their bins of feature f, plus one."""
        if not self.codes:
            return np.full(n, self.values[0])
        at = None
        for f, code in self.codes.items():
            own = code.take(slots(f), mode="clip")
            at = own if at is None else np.add(at, own, out=at)
        return self.values.take(at, mode="clip")


class _Cells:
    """One model's histogram in a task: dense, or the touched cells, merged as they pile up."""

    def __init__(self, size: int, dense: bool):
        self.dense = dense
        self.sums = [np.zeros(size if dense else 0, np.int64) for _ in range(3)]
        self.at, self.more, self.held = np.zeros(0, np.int64), [], 0

    def add(self, start: int, size: int, cell: np.ndarray, g: np.ndarray, h: np.ndarray | None, n: np.ndarray | None = None) -> None:
        """Adds to ``size`` cells from ``start`` on.  ``g`` and ``h`` hold integers; a block's sums are exact in doubles.
        ``h`` is None where it is the same for all rows (dense cells); ``n``: the cells' rows, if they are known."""
        if self.dense:
            n = np.bincount(cell, None, size) if n is None else n
            self.sums[0][start:start + size] += np.bincount(cell, g, size).astype(np.int64)
            if h is not None:
                self.sums[1][start:start + size] += np.bincount(cell, h, size).astype(np.int64)
            self.sums[2][start:start + size] += n
            return
        u, inv = np.unique(cell, return_inverse=True)
        self.more.append((u + start, *[np.bincount(inv, w, len(u)).astype(np.int64) for w in (g, h, None)]))
        self.held += len(u)
        if self.held > max(SPARSE_MERGE, len(self.at)):
            self._merge()

    def _merge(self) -> None:
        parts = [(self.at, *self.sums), *self.more]
        u, inv = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        sums = []
        for k in (1, 2, 3):
            s = np.zeros(len(u), np.int64)
            np.add.at(s, inv, np.concatenate([p[k] for p in parts]))
            sums.append(s)
        self.at, self.sums, self.more, self.held = u, sums, [], 0

    def touched(self) -> tuple[np.ndarray, list[np.ndarray]]:
        if self.dense:
            at = np.flatnonzero(self.sums[2])
            return at, [s[at] for s in self.sums]
        if self.more:
            self._merge()
        return self.at, self.sums


def _batch(**columns) -> pa.RecordBatch:
    n = max(len(v) for v in columns.values() if not np.isscalar(v))
    full = {c: np.full(n, v) if np.isscalar(v) else v for c, v in columns.items()}
    return pa.RecordBatch.from_arrays(
        [pa.array(np.asarray(full[f.name]), f.type) if f.name in full else pa.nulls(n, f.type) for f in _ARROW], schema=_ARROW)


def bundles(features: np.ndarray, widths: list) -> list[list[int]]:
    """The features in groups of up to ``BUNDLE_CELLS`` cells; a feature of more stands alone."""
    out, size = [], 0
    for f in sorted(features.tolist(), key=lambda f: (widths[f], f)):
        if out and size * widths[f] <= BUNDLE_CELLS:
            out[-1].append(f)
            size *= widths[f]
        else:
            out.append([f])
            size = widths[f]
    return out


class _Rows:
    """A block's rows as the models with the same holdout fold use them, and what they share; ``whole``: the cells of all the
    block's rows, which all holdouts share."""

    def __init__(self, block: Block, holdout: int, plan: PassPlan, whole: dict[tuple, np.ndarray]):
        self.block, self.plan, self.whole = block, plan, whole
        self.rows = np.flatnonzero((block.fold != holdout) & (block.fold != plan.test_fold))
        self.y = block.y[self.rows]
        self.kept = None
        if plan.subsample < 1:
            self.kept = np.flatnonzero(sampled(block.kh[self.rows], plan.seed, plan.tree_index, plan.subsample))
        self.used = self.rows if self.kept is None else self.rows[self.kept]
        self.cells: dict[tuple, np.ndarray] = {}
        self.counts: dict[tuple, np.ndarray] = {}

    def cell(self, bundle: tuple[int, ...]) -> np.ndarray:
        """The bundle's cell of each row in the sample."""
        if bundle not in self.cells:
            if bundle not in self.whole:
                at = np.zeros(len(self.block.bins), np.int64)
                for f in bundle:
                    at *= self.plan.widths[f]
                    at += self.block.bins[:, f]
                    at += 1
                self.whole[bundle] = at
            self.cells[bundle] = self.whole[bundle].take(self.used)
        return self.cells[bundle]

    def count(self, bundle: tuple[int, ...], size: int) -> np.ndarray:
        if bundle not in self.counts:
            self.counts[bundle] = np.bincount(self.cell(bundle), None, size)
        return self.counts[bundle]


class _Histogram:
    """One model's histogram in a task: per bundle of features and node where it is dense, else per feature and node."""

    def __init__(self, b: Builder, plan: PassPlan, share: int):
        self.b, self.width, k = b, plan.width, len(b.nodes)
        self.groups = [tuple(g) for g in bundles(b.features, plan.widths)]
        self.sizes = [int(np.prod([plan.widths[f] for f in g])) for g in self.groups]
        self.dense = k * (sum(self.sizes) + 1) <= share and k * (len(b.features) * plan.width + 1) <= share
        if not self.dense:
            self.groups, self.sizes = [(f,) for f in b.features.tolist()], [plan.width] * len(b.features)
        self.widths = plan.widths
        self.unit = int(as_integers(np.ones(1), b.bits[1])[0]) if plan.objective == "reg:squarederror" else None
        self.cells = _Cells(k * (sum(self.sizes) + 1), self.dense)

    def add(self, shared: _Rows, g: np.ndarray, h: np.ndarray) -> None:
        """Adds a block's rows (with scaled ``g`` and ``h``) to the builder's nodes: cells by bundle, node and
        bin, then one per node for its totals."""
        b, k = self.b, len(self.b.nodes)
        h = None if self.dense and self.unit is not None else h
        some, at = None, 0
        if b.level or k != 1:
            lookup = np.full(len(b.tree.feature), -1, np.int64)
            lookup[b.nodes] = np.arange(k)
            at = lookup[b.tree.route(shared.block.bins, b.level)[shared.used]]
            some = np.flatnonzero(at >= 0)
            if not len(some):
                return
            at, g, h = at[some], g[some], None if h is None else h[some]
        start = 0
        for group, size in zip(self.groups, self.sizes):
            if some is None:
                self.cells.add(start, size, shared.cell(group), g, h, shared.count(group, size) if self.dense else None)
            else:
                self.cells.add(start, k * size, at * size + shared.cell(group)[some], g, h)
            start += k * size
        self.cells.add(start, k, np.zeros(len(g), np.int64) if some is None else at, g, h)

    def touched(self) -> tuple[np.ndarray, list[np.ndarray]]:
        """Cells by feature, node and bin, then the nodes' totals: those with rows, and their sums."""
        if not self.dense:
            return self.cells.touched()
        b, k, width = self.b, len(self.b.nodes), self.width
        G, H, C = self.cells.sums
        sums = [G, C * self.unit if self.unit is not None else H, C]
        own = len(b.features) * k * width
        place = {f: i for i, f in enumerate(b.features.tolist())}
        out = []
        for s in sums:
            full, start = np.zeros(own + k, np.int64), 0
            for group, size in zip(self.groups, self.sizes):
                joint = s[start:start + k * size].reshape(k, *[self.widths[f] for f in group])
                start += k * size
                for axis, f in enumerate(group, 1):
                    i, w = place[f], self.widths[f]
                    one = joint.sum(axis=tuple(x for x in range(1, joint.ndim) if x != axis))
                    full[i * k * width:(i + 1) * k * width].reshape(k, width)[:, :w] = one
            full[own:] = s[start:start + k]
            out.append(full)
        at = np.flatnonzero(out[2])
        return at, [s[at] for s in out]


def _cell_rows(b: Builder, found: _Histogram, width: int) -> Iterator[pa.RecordBatch]:
    at, (G, H, C) = found.touched()
    if not len(at):
        return
    fa, k = len(b.features), len(b.nodes)
    own = at < fa * k * width
    i = np.where(own, at // (k * width), 0)
    node = np.where(own, at // width % k, at - fa * k * width)
    feature = np.where(own, b.features[i] if fa else 0, TOTALS)
    bin_ = np.where(own, at % width - 1, 0)
    dir_ = np.where(own, b.dirs[i] if fa else 0, 0)
    for nodes, sign in ((b.nodes[node], 1), (b.siblings[node], -1)):
        real = nodes >= 0
        if real.any():
            k = nodes[real]
            yield _batch(model=b.model, node=k, feature=feature[real], bin=bin_[real], dir=dir_[real], lower=b.lower[k],
                         upper=b.upper[k], G=sign * G[real], H=sign * H[real], C=sign * C[real])


def run_pass(state: State, plan: PassPlan) -> DataFrame:
    """The tasks' cells and metric sums of one level, not yet summed."""
    obj = objectives.get(plan.objective)
    width, share = plan.width, max(plan.dense_max_cells // max(len(plan.builders), 1), 0)

    def run(blocks: Iterator[Block]) -> Iterator[pa.RecordBatch]:
        made: dict[int, _Histogram] = {}
        sums: dict[tuple, list[int]] = {}
        tops: dict[int, list[float]] = {}
        built = {b.model: b for b in plan.builders}
        measured, topped = dict(plan.metrics), dict(plan.tops)
        told: dict[int, Table | None] = {}
        for block in blocks:
            held: dict[int, tuple] = {}
            slots = cache(lambda f, bins=block.bins: bins[:, f].astype(np.intp) + 1)
            shared: dict[int, _Rows] = {}
            whole: dict[tuple, np.ndarray] = {}
            # A model is done with before the next, so that one model's arrays are held at a time.
            for model in sorted({*built, *measured, *topped}):
                if block.margins is None and model not in told:
                    told[model] = Table.of(plan.pending.get(model, ()), plan.bases[model], plan.widths)
                if block.margins is None and told[model] is not None:
                    m = told[model].margins(slots, len(block.bins))
                else:
                    m = margin_of(block, model, plan.bases, plan.pending)
                if model in measured:
                    holdout = measured[model]
                    if holdout not in held:
                        v = np.flatnonzero(block.fold == holdout)
                        held[holdout] = v, block.y[v], np.maximum(np.abs(block.y[v]), MAPE_EPS)
                    v, y, size = held[holdout]
                    if len(v):
                        own = m.take(v)
                        ape = np.abs(y - obj.predict(own)) / size
                        for kind, values in ((LOSS, obj.loss(own, y)), (APE, ape)):
                            for e, hi, lo in split_sums(values):
                                s = sums.setdefault((model, kind, e), [0, 0, 0])
                                s[0], s[1] = s[0] + hi, s[1] + lo
                        sums.setdefault((model, ROWS, 0), [0, 0, 0])[2] += len(v)
                holdout = built[model].holdout if model in built else topped.get(model)
                if holdout is None:
                    continue
                if holdout not in shared:
                    shared[holdout] = _Rows(block, holdout, plan, whole)
                of = shared[holdout]
                if not len(of.rows):
                    continue
                g, h = obj.grad_hess(m.take(of.rows), of.y)
                if model in topped:
                    top = tops.setdefault(model, [0.0, 0.0])
                    top[0], top[1] = max(top[0], float(g.max()), -float(g.min())), max(top[1], float(h.max()))
                if model in built and len(of.used):
                    b = built[model]
                    if of.kept is not None:
                        g, h = g[of.kept], h[of.kept]
                    if model not in made:
                        made[model] = _Histogram(b, plan, share)
                    made[model].add(of, as_integers(g, b.bits[0]), as_integers(h, b.bits[1]))
        for b in plan.builders:
            if b.model in made:
                yield from _cell_rows(b, made[b.model], width)
        if sums:
            keys = np.array(list(sums), np.int64)
            v = np.array(list(sums.values()), np.int64)
            yield _batch(model=keys[:, 0], node=keys[:, 1], feature=METRICS, bin=keys[:, 2], G=v[:, 0], H=v[:, 1], C=v[:, 2])
        if tops:
            v = np.array(list(tops.values()))
            yield _batch(model=np.array(list(tops)), node=TOP, feature=METRICS, bin=0, lower=v[:, 0], upper=v[:, 1],
                         G=np.zeros(len(v)), H=np.zeros(len(v)), C=np.zeros(len(v)))

    columns = ["fold", "y", "bins"] + (["kh"] if plan.subsample < 1 else [])
    return state.mapped(run, CELLS, *columns)


def level_cells(partials: DataFrame, parents: DataFrame | None = None, derived: list[tuple[int, int, int]] = ()) -> DataFrame:
    """Cells (and metrics) of a level, summed.  ``parents``: the cells of the level before; ``derived``:
    (model, parent node, child node) of the nodes that are a parent less its other child."""
    if derived:
        told = partials.sparkSession.createDataFrame(list(derived), "model int, node int, child int")
        above = parents.where(F.col("feature") > METRICS).join(F.broadcast(told), ["model", "node"])  # a row per open node
        nothing = {c: F.lit(None).cast(t) for c, t in (("dir", "int"), ("lower", "double"), ("upper", "double"))}
        partials = partials.unionByName(above.drop("node").withColumnRenamed("child", "node").withColumns(nothing).select(_NAMES))
    summed = partials.repartition("model", "node", "feature").groupBy("model", "node", "feature", "bin").agg(
        *[F.max(c).alias(c) for c in ("dir", "lower", "upper")], *[F.sum(c).alias(c) for c in "GHC"])
    # Cells that came out empty are kept where they tell a node's bounds and a feature's direction.
    return summed.where((F.col("C") != 0) | F.col("lower").isNotNull() | (F.col("feature") == METRICS))
