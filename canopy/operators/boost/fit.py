"""Batched boosting driver.

Many models train in one set of Spark jobs: every model has a *holdout* fold
and trains on the rows of all other non-test folds.  Cross-validation fold
models (holdout 1..k) and the final model (holdout = test fold, so it trains
on every training row and is scored on the test rows) of one configuration
share each pass; so can many configurations.

Per tree: one pass per level.  A pass is a Spark job - histogram
``mapInArrow`` -> ``groupBy`` sum -> window split search -> collect of one
row per open node.  The driver only ever sees those per-node rows and the
per-model metric sums, never data rows.  Leaves under the last level take
their weights from the parent's split sums, so a depth-D tree costs D passes.
Below the root only the smaller child of a split is built from rows; a level's cells are kept
until the next level has taken the larger child's from them.

All sums are order-free (``exact``, ``histogram``): the trees are bit-equal for any
partitioning of the input and any order of tasks.

Early stopping: the first level of tree t also sums each model's validation
loss after t trees.  A cross-validation model stops ``early_stopping_rounds``
trees after its best round; the final model of a configuration stops when
all its fold models have, and keeps int(median(best rounds)) trees.  The
validation and test errors at the kept round come from the same sums, so CV
and the final test score cost no extra pass.

Models that are the same so far (warm-ups of several sizes, while their features are masked) share their passes and trees.

Margins live in a table of their own (``state``); trees built since the last refresh are
applied on the fly.  Every ``refresh_every`` trees the margins alone are written anew in the
session's checkpoint folder, which cuts the lineage and makes executor loss cheap to recover.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exact, objectives
from .bins import FeatureSpec, feature_spec
from .histogram import APE, LOSS, ROWS, TOP, Builder, PassPlan, level_cells, margin_of, run_pass
from .node_split import best_splits, left_categories, metric_rows
from .state import NO_FOLD, State, small_batches
from .tree import Tree


@dataclass
class BoostParams:
    objective: str = "reg:squarederror"
    learning_rate: float = 0.1
    max_trees: int = 10000
    early_stopping_rounds: int = 50
    subsample: float = 0.8
    colsample_bytree: float = 0.8
    reg_lambda: float = 1.0
    min_child_weight: float = 1.0
    seed: int = 42
    max_bins: int = 256
    test_fold: int = 6
    refresh_every: int = 10


@dataclass
class ModelSpec:
    """One model of a batch.

    ``early_stop``: a cross-validation fold model (stops on its holdout loss).
    Otherwise the model is a final model: it stops with its group's fold
    models, or after ``n_trees`` trees when that is given.
    ``init_trees`` and ``init_base`` (its ``base_margin``) are a model to
    continue.  ``masked`` features are not offered for the first ``mask_trees`` trees
    (warm-up); early stopping looks only at rounds after them.  In a column sample they
    still take their places, as a masked column does; with ``drop_masked`` those trees
    sample from the other features alone.
    """
    name: str
    group: str
    holdout: int
    depth: int
    constraints: dict = field(default_factory=dict)
    masked: list = field(default_factory=list)
    mask_trees: int = 0
    drop_masked: bool = False
    early_stop: bool = True
    n_trees: int | None = None
    init_trees: list = field(default_factory=list)
    init_base: float | None = None


@dataclass
class ModelResult:
    spec: ModelSpec
    trees: list
    curve: dict                 # trees -> (loss sum, ape sum, rows) on the holdout fold
    best_trees: int | None = None
    base_margin: float = 0.0

    def mape_at(self, c: int) -> float | None:
        r = self.curve.get(c)
        return None if r is None or r[2] == 0 else r[1] / r[2]


@dataclass
class BatchResult:
    features: FeatureSpec
    params: BoostParams
    models: list                # ModelResult, in spec order
    groups: dict                # group -> dict(cv_mape, test_mape, n_trees, cv_mapes, cv_trees)


def _clamp(w, lo, hi):
    return min(max(w, lo), hi)


def label_sums(state: State) -> dict[int, dict]:
    """Per fold: rows, labels that are numbers (n), their least and greatest, and their exact sum."""
    def run(blocks):
        for b in blocks:
            for fold in np.unique(b.fold):
                y = b.y[b.fold == fold]
                v = y[~np.isnan(y)]
                parts = [(exact.NOT_FINITE, 0, 0), *exact.split_sums(v)]
                k = len(parts)
                counts = np.zeros((2, k), np.int64)
                counts[:, 0] = len(y), len(v)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(k, fold, np.int32)), *[pa.array(np.array(c, t)) for c, t in zip(zip(*parts), (np.int32, np.int64, np.int64))],
                     pa.array(counts[0]), pa.array(counts[1]), pa.array(np.full(k, v.min() if len(v) else np.inf)),
                     pa.array(np.full(k, v.max() if len(v) else -np.inf))],
                    ["fold", "e", "high_part", "low_part", "rows", "n", "low", "high"])

    told = state.mapped(run, "fold int, e int, high_part long, low_part long, rows long, n long, low double, high double", "fold", "y")
    out: dict[int, dict] = {}
    for r in told.groupBy("fold", "e").agg(*[F.sum(c).alias(c) for c in ("high_part", "low_part", "rows", "n")],
                                           F.min("low").alias("low"), F.max("high").alias("high")).collect():
        f = out.setdefault(None if r["fold"] == NO_FOLD else r["fold"],
                           {"rows": 0, "n": 0, "low": math.inf, "high": -math.inf, "parts": []})
        f["rows"], f["n"] = f["rows"] + r["rows"], f["n"] + r["n"]
        f["low"], f["high"] = min(f["low"], r["low"]), max(f["high"], r["high"])
        f["parts"].append((r["e"], r["high_part"], r["low_part"]))
    return out


class Trainer:
    def __init__(self, df: DataFrame, key: str, fold: str, label: str, features: list[str],
                 models: list[ModelSpec], params: BoostParams, spec: FeatureSpec | None = None, after: Trainer | None = None):
        """``after``: a trainer of the same rows, run with ``keep``, whose binned rows this one goes on with."""
        if len({len(m.init_trees) for m in models}) > 1:
            raise ValueError("models of a batch continue from the same number of trees")
        if spec is None and any(m.init_trees for m in models):
            raise ValueError("warm start needs the cut points of the continued model (spec=)")
        self.spark = df.sparkSession
        self.params = params
        self.obj = objectives.get(params.objective)
        self.models = models
        self.spec = after.spec if after else spec or feature_spec(df, features, params.max_bins)
        self.nf = len(self.spec.names)
        self.fid = {n: i for i, n in enumerate(self.spec.names)}
        self.state = after.state.again(len(models)) if after else State(df, key, fold, label, self.spec, len(models), params.seed,
                                                                           params.subsample < 1)
        try:
            with small_batches(self.spark):
                self.seen = seen = after.seen if after else label_sums(self.state)
            self._check_labels(seen)
        except Exception:
            self.state.close()
            raise
        self.rows = sum(v["rows"] for v in seen.values())
        self.low = min((v["low"] for v in seen.values()), default=0.0)
        self.high = max((v["high"] for v in seen.values()), default=0.0)
        self.base = []
        for m in models:
            own = [v for f, v in seen.items() if f not in (m.holdout, params.test_fold)]
            n = sum(v["n"] for v in own)
            s = exact.total(p for v in own for p in v["parts"])
            # A continued model goes on from its own start, whatever the new rows' mean.
            self.base.append(m.init_base if m.init_trees and m.init_base is not None
                             else self.obj.base_margin(s / n if n else 0.0))
        self.trees = {j: list(m.init_trees) for j, m in enumerate(models)}
        self.pending = {j: list(m.init_trees) for j, m in enumerate(models)}
        # Per model what bounds the next tree's gradients and hessians.
        self.top = {j: self.obj.bounds(self.base[j], self.low, self.high) if self.rows else (0.0, 0.0) for j in range(len(models))}
        self.curves = {j: {} for j in range(len(models))}
        self.best = {}
        self.active = set(range(len(models)))
        # Active models with the same number here have the same holdout and margins.
        starts = [(m.holdout, b, *map(id, m.init_trees)) for m, b in zip(models, self.base)]
        self.same = [starts.index(s) for s in starts]
        self.categorical = [i for i, cat in enumerate(self.spec.is_cat) if cat]
        self.dirs = [np.array([m.constraints.get(n, 0) for n in self.spec.names], np.int32)
                     for m in models]
        self.masked = [np.array([self.fid[c] for c in m.masked if c in self.fid], np.int64)
                       for m in models]

    def _check_labels(self, seen: dict) -> None:
        """Rows without a fold or label, and labels that the link can't take, are
        errors: they would give missing sums and a loss of nothing."""
        if None in seen:
            raise ValueError(f"{seen[None]['rows']} rows have no fold")
        bad = sum(r["rows"] - r["n"] for r in seen.values())
        if bad:
            raise ValueError(f"{bad} rows have no label (NULL or NaN)")
        low = min((r["low"] for r in seen.values()), default=None)
        if low is not None and self.params.objective == "count:poisson" and low < 0:
            raise ValueError(f"count:poisson needs labels of at least 0, found {low}")
        if low is not None and self.params.objective == "reg:gamma" and low <= 0:
            raise ValueError(f"reg:gamma needs labels above 0, found {low}")
        # Margins of a log link are cut there, so such labels could not be reached.
        high = max((r["high"] for r in seen.values()), default=0.0)
        if self.obj.log_link and high > math.exp(objectives.MARGIN_CLIP):
            raise ValueError(f"labels of a log link go up to e^{objectives.MARGIN_CLIP:g}, found {high}")
        if self.params.objective == "reg:gamma" and low is not None and low < math.exp(-objectives.MARGIN_CLIP):
            raise ValueError(f"labels of a log link go down to e^-{objectives.MARGIN_CLIP:g}, found {low}")

    # ---------------------------------------------------------------- passes
    def plan(self, t: int, **more) -> PassPlan:
        p = self.params
        used = {b.model for b in more.get("builders", ())} | {j for of in ("metrics", "tops") for j, _ in more.get(of, ())}
        return PassPlan(objective=p.objective, width=self.spec.max_bins + 1,
                        widths=[self.spec.n_bins(i) + 1 for i in range(self.nf)], test_fold=p.test_fold, subsample=p.subsample,
                        seed=p.seed, tree_index=t, bases=self.base,
                        pending={j: [x.routing() for x in trees] for j, trees in self.pending.items() if j in used and trees},
                        **more)

    def bits(self) -> list[tuple[int, int]]:
        return [tuple(exact.scale_bits(v, self.rows) for v in self.top[j]) for j in range(len(self.models))]

    def root_cells(self, dense_max_cells: int | None = None) -> DataFrame:
        """The summed root histograms of all models, before the first tree."""
        every, bits = np.arange(self.nf), self.bits()
        builders = []
        for j, m in enumerate(self.models):
            tree = Tree.empty(m.depth)
            builders.append(Builder(model=j, holdout=m.holdout, tree=tree, level=0, nodes=np.array([0]), siblings=np.array([-1]),
                                    lower=tree.lower, upper=tree.upper, features=every, dirs=self.dirs[j], bits=bits[j]))
        plan = self.plan(0, builders=builders)
        if dense_max_cells is not None:
            plan.dense_max_cells = dense_max_cells
        return level_cells(run_pass(self.state, plan))

    def _search(self, cells: DataFrame, bits) -> list[dict]:
        """One row per open node: totals and the best split."""
        p = self.params
        rows = [r.asDict() for r in best_splits(cells, bits, self.categorical, p.reg_lambda, p.min_child_weight).collect()]
        chosen = [(r["model"], r["node"], r["feature"], r["pos"]) for r in rows if r["feature"] in self.categorical]
        left = {(r["model"], r["node"]): r["left"] for r in left_categories(
            cells, bits, self.categorical, p.reg_lambda, chosen).collect()} if chosen else {}
        for r in rows:
            r["left_bins"] = left.get((r["model"], r["node"]))
        return rows

    def _read_metrics(self, cells: DataFrame, t: int, twins: dict[int, list[int]] | None = None) -> None:
        """Validation sums after ``t`` trees, and the largest gradients and hessians at them; ``twins``: the models that
        a measured one stands for."""
        parts, counts = {}, {}
        for r in metric_rows(cells).collect():
            if r["node"] == TOP:
                self.top[r["model"]] = (r["lower"], r["upper"])
            elif r["node"] == ROWS:
                counts[r["model"]] = r["C"]
            else:
                parts.setdefault((r["model"], r["node"]), []).append((r["bin"], r["G"], r["H"]))
        for j, n in counts.items():
            self.curves[j][t] = (*[exact.total(parts.get((j, kind), ())) for kind in (LOSS, APE)], n)
        for j, others in (twins or {}).items():
            for i in others:
                self.top[i] = self.top[j]
                if t in self.curves[j]:
                    self.curves[i][t] = self.curves[j][t]

    def _measure(self) -> None:
        """The bounds of a continued model, from its own margins."""
        tops = [(j, m.holdout) for j, m in enumerate(self.models)]
        self._read_metrics(level_cells(run_pass(self.state, self.plan(0, tops=tops))), 0)

    def _alike(self, models: list[int], *keys: Callable[[int], object]) -> dict[int, list[int]]:
        """The first of the models that are the same so far, and in ``keys``, with all of them."""
        found: dict[tuple, list[int]] = {}
        for j in models:
            found.setdefault((self.same[j], *[k(j) for k in keys]), []).append(j)
        return {own[0]: own for own in found.values()}

    def _colsample(self, t: int, dropped: np.ndarray = ()) -> np.ndarray:
        """The features (but for the dropped ones) that come first by md5("seed:tree:name")."""
        p = self.params
        some = [i for i in range(self.nf) if i not in set(dropped)]
        if p.colsample_bytree < 1.0 and some:
            k = max(1, int(math.floor(p.colsample_bytree * len(some))))
            some.sort(key=lambda i: (hashlib.md5(f"{p.seed}:{t}:{self.spec.names[i]}".encode()).hexdigest(), i))
            some = some[:k]
        return np.sort(np.array(some, np.int64))

    def _refresh(self):
        if not any(self.pending[j] for j in self.active):
            return
        bases, pending = self.base, {j: [x.routing() for x in trees] for j, trees in self.pending.items() if trees}
        self.state.refresh(lambda block, j: margin_of(block, j, bases, pending))
        self.pending = {j: [] for j in range(len(self.models))}

    # ---------------------------------------------------------------- stopping
    def _first_eligible(self, j: int) -> int:
        m = self.models[j]
        return len(m.init_trees) + m.mask_trees + 1

    def _best_round(self, j: int) -> int | None:
        lo = self._first_eligible(j)
        cands = [(v[0] / v[2] if v[2] else math.inf, c) for c, v in self.curves[j].items() if c >= lo]
        if not cands:
            return None
        return min(cands)[1]

    def _update_stopping(self, t: int):
        p = self.params
        for j in sorted(self.active):
            m = self.models[j]
            if m.early_stop:
                b = self._best_round(j)
                if b is not None and t - b >= p.early_stopping_rounds:
                    self.best[j] = b
                    self.active.discard(j)
            elif m.n_trees is not None and t >= m.n_trees:
                self.best[j] = m.n_trees
                self.active.discard(j)
        for j in sorted(self.active):
            m = self.models[j]
            if m.early_stop or m.n_trees is not None:
                continue
            fold_models = [i for i, o in enumerate(self.models) if o.group == m.group and o.early_stop]
            if fold_models and all(i not in self.active for i in fold_models):
                self.best[j] = int(np.median([self.best[i] for i in fold_models]))
                self.active.discard(j)

    # ---------------------------------------------------------------- training
    def run(self, keep: bool = False) -> BatchResult:
        """With ``keep`` the binned rows stay for another trainer."""
        try:
            with small_batches(self.spark):
                return self._run()
        finally:
            if not keep:
                self.state.close()

    def _last_tree(self) -> int:
        """No more trees than this are built, as far as is known now."""
        given = [self.models[j].n_trees for j in self.active]
        return min([self.params.max_trees] + ([max(given)] if given and None not in given else []))

    def _run(self) -> BatchResult:
        p = self.params
        lam, lr = p.reg_lambda, p.learning_rate
        t = max((len(m.init_trees) for m in self.models), default=0)
        if t and self.rows:
            if t >= (p.refresh_every or 1):
                self._refresh()
            self._measure()
        while True:
            at_cap = t >= p.max_trees
            builders_models = [] if at_cap else sorted(self.active)
            metric_models = sorted(self.active) if t >= 1 else []
            if not builders_models and not metric_models:
                break
            allowed_all = self._colsample(t)
            cur, open_, allowed = {}, {}, {}
            bits = self.bits()
            for j in builders_models:
                m = self.models[j]
                a = allowed_all
                if len(self.masked[j]) and t - len(m.init_trees) < m.mask_trees:
                    a = self._colsample(t, self.masked[j]) if m.drop_masked else np.setdiff1d(a, self.masked[j])
                allowed[j] = a
            twins = self._alike(sorted(self.active))
            # Of models that would build the same tree the first does, and the others take it.
            built = self._alike(builders_models, lambda j: (self.models[j].depth, bits[j]), lambda j: allowed[j].tobytes(),
                                lambda j: self.dirs[j][allowed[j]].tobytes())
            for j in built:
                cur[j] = Tree.empty(self.models[j].depth)
                cur[j].lower[0], cur[j].upper[0] = -math.inf, math.inf
                open_[j] = [(0, -1)]            # (built node, sibling derived from it)
            d, above, derived = 0, None, []
            while True:
                level_models = [j for j in built if j in cur and d < self.models[j].depth and open_[j]]
                if not level_models and not (d == 0 and metric_models):
                    break
                builders = []
                for j in level_models:
                    nodes = np.array(open_[j], np.int64)
                    builders.append(Builder(
                        model=j, holdout=self.models[j].holdout, tree=cur[j], level=d, nodes=nodes[:, 0],
                        siblings=nodes[:, 1], lower=cur[j].lower, upper=cur[j].upper, features=allowed[j],
                        dirs=self.dirs[j][allowed[j]], bits=bits[j]))
                held = [(j, self.models[j].holdout) for j in twins if metric_models] if d == 0 else []
                tops = [(j, self.models[j].holdout) for j in twins if builders_models] if d == 0 else []
                cells = level_cells(run_pass(self.state, self.plan(t, metrics=held, tops=tops, builders=builders)),
                                    above, derived).persist()
                try:
                    rows = self._search(cells, bits)
                    if d == 0:
                        self._read_metrics(cells, t, twins)
                        self._update_stopping(t)
                        for j in list(cur):
                            if not self.active.intersection(built[j]):
                                cur.pop(j)
                finally:
                    if above is not None:
                        above.unpersist()
                above = cells
                if d == 0 and at_cap:
                    break
                derived = self._apply_level(rows, cur, open_, d, lam, lr)
                d += 1
            if above is not None:
                above.unpersist()
            if at_cap or not cur:
                if not self.active or at_cap:
                    break
            for lead, tree in cur.items():
                used = tree.value[tree.used]
                for j in self.active.intersection(built[lead]):
                    self.top[j] = self.obj.bounds_after(self.top[j], self.high, float(used.min()), float(used.max()))
                    self.trees[j].append(tree)
                    self.pending[j].append(tree)
                    self.same[j] = lead
            t += 1
            # After the last tree only its losses are read, for which new margins are not worth writing.
            if p.refresh_every and t % p.refresh_every == 0 and t < self._last_tree():
                self._refresh()
        for j, m in enumerate(self.models):
            if j not in self.best and m.early_stop:
                b = self._best_round(j)
                self.best[j] = b if b is not None else len(self.trees[j])
        for j, m in enumerate(self.models):
            if j not in self.best:
                fold_models = [i for i, o in enumerate(self.models) if o.group == m.group and o.early_stop]
                if m.n_trees is not None:
                    self.best[j] = min(m.n_trees, len(self.trees[j]))
                elif fold_models:
                    self.best[j] = int(np.median([self.best[i] for i in fold_models]))
                else:
                    self.best[j] = len(self.trees[j])
        return self._result()

    def _apply_level(self, rows, cur, open_, d, lam, lr) -> list[tuple[int, int, int]]:
        """Writes a level's splits and leaves, and opens their children: the smaller is to be built.  Returns
        (model, parent, child) of the others."""
        by = {(r["model"], r["node"]): r for r in rows}
        derived = []
        for j, tree in cur.items():
            if d >= self.models[j].depth:
                continue
            nodes = [n for pair in open_[j] for n in pair if n >= 0]
            open_[j] = []
            for node in sorted(nodes):
                lo, hi = float(tree.lower[node]), float(tree.upper[node])
                r = by.get((j, node))
                G, H, C = (r["Gn"], r["Hn"], r["Ct"]) if r is not None else (0.0, 0.0, 0)
                w = _clamp(-G / (H + lam) if H + lam else 0.0, lo, hi)
                tree.used[node] = True
                tree.weight[node], tree.cover[node], tree.count[node] = w, H, C
                if r is None or r["feature"] is None:
                    tree.value[node] = lr * w
                    continue
                f = int(r["feature"])
                tree.feature[node] = f
                tree.gain[node] = r["loss_chg"]
                tree.default_left[node] = bool(r["dl"])
                if self.spec.is_cat[f]:
                    tree.is_cat[node] = True
                    tree.cat_left[node] = np.array(sorted(r["left_bins"]), np.int64)
                    tree._cat_matrix = None
                else:
                    tree.split_bin[node] = int(r["bin"])
                wl, wr = r["wl"], r["wr"]
                llo, lhi, rlo, rhi = lo, hi, lo, hi
                dirn = int(self.dirs[j][f])
                if dirn != 0:
                    mid = (wl + wr) / 2.0
                    if dirn > 0:
                        lhi, rlo = mid, mid
                    else:
                        llo, rhi = mid, mid
                left, right = 2 * node + 1, 2 * node + 2
                tree.lower[left], tree.upper[left], tree.lower[right], tree.upper[right] = llo, lhi, rlo, rhi
                if d + 1 < self.models[j].depth:
                    small, large = (left, right) if r["CL"] <= r["CR"] else (right, left)
                    open_[j].append((small, large))
                    derived.append((j, node, large))
                    continue
                for cn, cg, ch, cc in ((left, r["GL"], r["HL"], r["CL"]), (right, r["GR"], r["HR"], r["CR"])):
                    cw = _clamp(-cg / (ch + lam) if ch + lam else 0.0, float(tree.lower[cn]), float(tree.upper[cn]))
                    tree.used[cn] = True
                    tree.weight[cn], tree.cover[cn], tree.count[cn] = cw, ch, cc
                    tree.value[cn] = lr * cw
        return derived

    def _result(self) -> BatchResult:
        res = []
        for j, m in enumerate(self.models):
            res.append(ModelResult(m, self.trees[j][: self.best[j]], self.curves[j], self.best[j],
                                   self.base[j]))
        groups = {}
        for g in dict.fromkeys(m.group for m in self.models):
            fold_models = [r for r in res if r.spec.group == g and r.spec.early_stop]
            finals = [r for r in res if r.spec.group == g and not r.spec.early_stop]
            cv_mapes = [r.mape_at(r.best_trees) for r in fold_models]
            info = {"cv_mapes": cv_mapes, "cv_trees": [r.best_trees for r in fold_models],
                    "cv_mape": float(np.mean(cv_mapes)) if fold_models else None,
                    "n_trees": finals[0].best_trees if finals else None,
                    "test_mape": finals[0].mape_at(finals[0].best_trees) if finals else None}
            groups[g] = info
        return BatchResult(self.spec, self.params, res, groups)
