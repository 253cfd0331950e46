"""Cross-validation: folds by hash order, held-out rows kept at weight 0, statistics and losses of all folds in one
grouped pass. Fits of folds that need several passes go in lockstep: each pass serves the next step of all of them."""

from __future__ import annotations

import queue
import threading
from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ridgeline.functions.glm import Cox, Response
from ridgeline.operators.features import FeatureFrame
from ridgeline.functions.special import Columns
from ridgeline.operators.comoments import Comoments, comoments_by
from ridgeline.plans.diagnostic import coefficient
from ridgeline.plans.path import Ask, GlmData, Options, PathResult, _glm_path, complete, gaussian_columns, gaussian_from_statistics, grpnet, lambda_path, moments, path_moments, statistics_of

#: Rows that number themselves in one task, and the largest number of such tasks.
RUN, MOST_RUNS = 200_000, 1 << 16


def assign_folds(df: DataFrame, key: str, n_folds: int, seed: int = 0) -> DataFrame:
    """``df`` with ``fold``: rows in order of seeded hashes of their key are dealt out in turn, so that sizes differ by
    one at most. Null and repeated keys are rows like any other; those of one key are told apart by their other columns.

    Hashes put rows in runs of about ``RUN``; a row's number is its place in its run plus the rows of the runs
    before. Both follow from the rows alone, never from partitions, so a repeated or recovered task gives the same
    folds. The rows are shuffled once, by run, and joined with nothing but the runs' totals, ``MOST_RUNS`` rows at
    most, which are summed in one task and broadcast."""
    runs = min(max(-(-df.count() // RUN), 1), MOST_RUNS)
    cells = [F.col(f"`{c.replace('`', '``')}`") for c in df.columns]
    keyed = df.select(*cells, F.xxhash64(F.lit(seed), F.col(key)).alias("__hash"), F.xxhash64(F.lit(seed), *cells).alias("__row"))
    keyed = keyed.withColumn("__run", F.pmod(F.xxhash64(F.lit(seed + 1), "__hash", "__row"), F.lit(runs)))
    totals = keyed.groupBy("__run").agg(F.count("*").alias("__n"))
    before = totals.select("__run", (F.sum("__n").over(Window.orderBy("__run")) - F.col("__n")).alias("__before"))
    place = F.row_number().over(Window.partitionBy("__run").orderBy("__hash", "__row")) - 1
    placed = keyed.withColumn("__place", place).join(F.broadcast(before), "__run")
    return placed.select(*cells, F.pmod(F.col("__before") + F.col("__place"), F.lit(n_folds)).cast("int").alias("fold"))


@dataclass
class CVResult:
    lmdas: np.ndarray
    losses: np.ndarray  # folds x lambdas
    avg_losses: np.ndarray
    best_idx: int
    frame: FeatureFrame
    response: Response
    options: Options

    def fit(self, size: int = 100) -> PathResult:
        """A path of all rows that ends at the best value."""
        best = float(self.lmdas[self.best_idx])
        top = max(float(self.lmdas[0]), best)
        path = top * (best / top) ** (np.arange(size) / max(size - 1, 1)) if best < top else [best]
        return _settled(grpnet(self.frame, self.response, replace(self.options, lmda_path=path, early_exit=False)), len(path))

    def plot_loss(self, ax=None):
        """Mean held-out loss and its standard error over folds by -log lambda, the best value marked, on a Matplotlib
        axis; ``loss_table`` holds the numbers."""
        if ax is None:
            from matplotlib import pyplot

            ax = pyplot.gca()
        x, spread = -np.log(self.lmdas), self.losses.std(axis=0) / np.sqrt(len(self.losses))
        ax.errorbar(x, self.avg_losses, yerr=spread, fmt="o", capsize=3)
        ax.axvline(x[self.best_idx], linestyle="--")
        ax.set_xlabel("-log(lambda)")
        ax.set_ylabel("held-out loss")
        return ax

    def loss_table(self, spark) -> DataFrame:
        """(fold, lmda_idx, lmda, loss): what a plot of the losses shows."""
        rows = [(f, i, float(lm), float(self.losses[f, i])) for f in range(len(self.losses)) for i, lm in enumerate(self.lmdas)]
        return spark.createDataFrame(rows, "fold int, lmda_idx int, lmda double, loss double")


def _settled(fit: PathResult, size: int) -> PathResult:
    if fit.error or len(fit.lmdas) != size:
        raise RuntimeError(f"a fold's path ended early: {fit.error or 'fewer values than its grid'}")
    return fit


def cv_grpnet(frame: FeatureFrame, response: Response, key: str | None = None, n_folds: int = 5, options: Options | None = None, seed: int = 0, folds: str | None = None) -> CVResult:
    """Held-out loss per fold and value of a common grid, the full path's values and any larger ones of a fold.

    Rows are dealt to folds by ``key`` (see ``assign_folds``), or ``folds`` names a column of 0 ... n_folds - 1. Groups,
    penalties and alpha of ``options`` hold for the grid as well as for the folds; links are kept. The loss of
    a fold is that of all rows less that of its training rows, over the held-out weight. Gaussian fits take one pass
    for the statistics of all folds; other families fit all folds in lockstep, with as many passes as the longest of them,
    and then score all folds and values in one pass; Cox fits take two passes for each of these. A path that ends early raises."""
    options = options or Options(min_ratio=1e-1, early_exit=False)
    base = replace(options, early_exit=False)
    if options.missing == "drop":
        frame = complete(frame, response)
    needed = [*response.y, *response.offsets, *(c for c in (response.weight, response.start, response.stop, response.status, response.strata, key, folds) if c)]
    cells = [x.cast("double").alias(f"__x{j}") for j, x in enumerate(frame.columns)]
    df = frame.df.select(*cells, *(F.col(c) for c in dict.fromkeys(needed)))  # only these are dealt out
    if folds is None:
        df = assign_folds(df, key, n_folds, seed)
    elif folds != "fold":
        df = df.withColumnRenamed(folds, "fold")
    dealt = replace(frame, df=df, features=tuple(replace(f, expr=F.col(f"__x{j}")) for j, f in enumerate(frame.features)))
    if response.family.name in ("gaussian", "multigaussian") and response.family.opt:
        grid, losses = _gaussian_cv(dealt, response, n_folds, base)
    else:
        grid, losses = _glm_cv(dealt, response, n_folds, base)
    avg = losses.mean(axis=0)
    return CVResult(grid, losses, avg, int(np.argmin(avg)), frame, response, options)


def _grid(options: Options, top: float) -> np.ndarray:
    return lambda_path(top, options.min_ratio, options.lmda_path_size) if options.lmda_path is None else np.sort(np.asarray(options.lmda_path, float))[::-1]


def _with_larger(options: Options, own: float, grid: np.ndarray) -> np.ndarray:
    """The grid and a fold's own values above it."""
    return np.concatenate([[x for x in lambda_path(own, options.min_ratio, options.lmda_path_size) if x > grid[0]], grid])


class Lockstep:
    """Runs fits side by side and answers what they ask together: ``answer`` gets one question of each fit that hasn't ended
    and is called on the caller's thread; threads of the fits only compute on the driver."""

    def __init__(self, answer: Callable[[list], list]):
        self.answer, self.said = answer, queue.Queue()

    def run(self, works: list[Callable]) -> list:
        """Each work is called with ``ask``; their results in order."""
        replies, results, errors = [queue.Queue() for _ in works], [None] * len(works), []

        def go(k: int) -> None:
            def ask(question):
                self.said.put((k, question))
                reply = replies[k].get()
                if isinstance(reply, BaseException):
                    raise reply
                return reply

            try:
                results[k] = works[k](ask)
            except BaseException as e:  # the caller's thread raises it
                errors.append(e)
            self.said.put((k, None))

        threads = [threading.Thread(target=go, args=(k,), daemon=True) for k in range(len(works))]
        for t in threads:
            t.start()
        live, waiting = len(works), {}
        while live:
            k, question = self.said.get()
            if question is None:
                live -= 1
            else:
                waiting[k] = question
            if live and len(waiting) == live:
                try:
                    found = self.answer(list(waiting.values()))
                except Exception as e:  # ends every fit that waits
                    found = [e] * live
                for j, reply in zip(waiting, found, strict=True):
                    replies[j].put(reply)
                waiting = {}
        if errors:
            raise errors[0]
        return results


class _Fold(GlmData):
    """The training rows of one fold of ``data``: questions go to ``ask``. ``full``: the loss of their full model."""

    def __init__(self, data: GlmData, fold: int, share: float, full: float, ask: Callable):
        self.__dict__.update(data.__dict__, fold=fold, scale=1.0 / share if share > 0 else 0.0, full=full, ask=ask)

    def moments(self, beta, inter, curved, columns=None) -> dict:
        columns = range(self.frame.p) if columns is None else columns
        return self.ask(Ask(beta.copy(), np.array(inter), list(columns), list(curved), self.fold, self.scale))

    def loss_full(self) -> float:
        return self.full


def _glm_cv(dealt: FeatureFrame, response: Response, n_folds: int, options: Options) -> tuple[np.ndarray, np.ndarray]:
    is_cox = isinstance(response.family, Cox)
    data = GlmData(dealt, response, options, centred=options.intercept or is_cox, by=("fold",))
    data.table, data.more = data.with_column("fold"), ("fold",)
    data.keep()
    try:
        rows = data.fold_weights()
        held = np.array([rows.get(f) or 0.0 for f in range(n_folds)])
        full = _full_losses(data, held)
        grid = _grid(options, _glm_path(data, replace(options, lmda_path=None, lmda_path_size=1)).lmda_max)

        def fit(f: int) -> Callable:
            def work(ask: Callable) -> PathResult:
                data_f = _Fold(data, f, 1.0 - held[f], full[f], ask)
                found = _glm_path(data_f, replace(options, lmda_path=lambda top: _with_larger(options, top, grid)))
                return _settled(found, len(_with_larger(options, found.lmda_max, grid)))

            return work

        answer = data.cox_answer if is_cox else lambda asks: moments(data.table, data.family, data.K, asks, bool(response.offsets), options.newton_most, data.tasks)
        fits = Lockstep(answer).run([fit(f) for f in range(n_folds)])
        found = [[coefficient(float(lm), own) for lm in grid] for own in fits]
        betas = np.array([[b for b, _ in own] for own in found])
        if is_cox:
            sums = _cox_losses(data, held, betas)
        else:
            inters = np.array([[np.atleast_1d(a) for _, a in own] for own in found]) + data.shift(betas)
            sums = path_moments(data.table, data.family, dealt.p, data.K, betas, inters, "fold", data.tasks)[0]
        return grid, np.where(held[:, None] > 0, sums / np.where(held > 0, held, 1.0)[:, None], 0.0)
    finally:
        data.release()


def _full_losses(data: GlmData, held: np.ndarray) -> list[float]:
    """The loss of a full model for each fold's training rows, whose weights sum to 1."""
    scales = [1 / (1 - h) if h < 1 else 0.0 for h in held]
    if isinstance(data.family, Cox):
        none = np.zeros(data.frame.p)
        return [m["full"] for m in data.cox_answer([Ask(none, np.zeros(1), [], [], f, scale, slopes=False) for f, scale in enumerate(scales)])]
    ys = [F.col(f"y{k}") for k in range(len(data.response.y))]
    full = data.family.loss_full(ys if getattr(data.family, "multi", False) else ys[0], F.col("w"), Columns)
    rows = {r["fold"]: r["full"] for r in data.table.groupBy("fold").agg(F.sum(full).alias("full")).collect()}
    total = sum(rows.values())
    return [(total - rows.get(f, 0.0)) * scale for f, scale in enumerate(scales)]


def _cox_losses(data: GlmData, held: np.ndarray, betas: np.ndarray) -> np.ndarray:
    """Loss of all rows less that of each fold's training rows, for its coefficients (folds, L, p): two passes for all."""
    asks = []
    for f, own in enumerate(betas):
        for b in own:
            columns = np.flatnonzero(b).tolist()
            asks.append(Ask(b, np.zeros(1), columns, [], slopes=False))
            if held[f] < 1:  # weights of training rows sum to 1 in their loss, which counts for their share
                asks.append(Ask(b, np.zeros(1), columns, [], f, 1 / (1 - held[f]), slopes=False))
    found = iter(data.cox_answer(asks))
    out = np.zeros(betas.shape[:2])
    for f, i in np.ndindex(*out.shape):
        out[f, i] = next(found)["loss"]
        if held[f] < 1:
            out[f, i] -= (1 - held[f]) * next(found)["loss"]
    return out


def fold_statistics(frame: FeatureFrame, response: Response, fold: str, n_folds: int) -> list[Comoments]:
    """Comoments of columns and responses (less offsets) per fold, in one pass; the total is their sum."""
    columns, w = gaussian_columns(frame, response)
    return comoments_by(frame.df, columns, w, F.col(fold), n_folds, strict=True)


def _gaussian_cv(dealt: FeatureFrame, response: Response, n_folds: int, options: Options) -> tuple[np.ndarray, np.ndarray]:
    parts = fold_statistics(dealt, response, "fold", n_folds)
    p, K, starts, names = dealt.p, len(response.y), dealt.group_starts(), dealt.names
    none = Comoments.none(p + K)
    if options.intercept:  # columns about their means: intercepts and predictions then are of the size of y
        shift = np.append(sum(parts, none).mean[:p], np.zeros(K))
        parts = [replace(m, mean=m.mean - shift) if m.weight else m for m in parts]
    fit = lambda m, path: gaussian_from_statistics(statistics_of(m, p), names, starts, replace(options, lmda_path=path, lmda_path_size=1 if path is None else options.lmda_path_size))
    grid = _grid(options, fit(sum(parts, none), None).lmda_max)
    losses = np.zeros((n_folds, len(grid)))
    for f, held in enumerate(parts):
        train = sum((m for g, m in enumerate(parts) if g != f), none)
        own = fit(train, lambda top: _with_larger(options, top, grid))
        own = _settled(own, len(_with_larger(options, own.lmda_max, grid)))
        if held.weight <= 0:
            continue
        h = statistics_of(held, p)
        for i, lm in enumerate(grid):
            b, a = coefficient(float(lm), own)
            B = b.reshape(p, K)
            eta = np.atleast_1d(a) + h["x"] @ B
            losses[f, i] = (0.5 * np.trace(B.T @ h["cxx"] @ B) + 0.5 * eta @ eta - np.trace(B.T @ h["cxy"]) - eta @ h["y"]) / K
    return grid, losses
