"""Purged, embargoed walk-forward evaluation.

Ridge regressions are solved from Gram matrices: each date's sums of products are aggregated once
in Spark, every fold is a sum of dates, and all folds, penalties and targets are solved in one
Arrow step.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch, ship
from ..sources import io
from . import calendar as cal
from .evalstats import ic_summary, information_coefficients


def folds(dates: DataFrame, calendar: DataFrame, horizon: int, embargo: int, min_train_months: int = 36, n_folds: int = 6, rolling_months: int | None = None, within: Sequence[str] = ()) -> DataFrame:
    """fold (from 1), date, role: test blocks of the dates after the training floor, and their training dates.

    A training date's label must end by the test block's start less the embargo.  ``within``: columns
    of ``dates`` each of whose values has folds of its own.
    """
    by = list(within)
    every = dates.select(*by, "date").distinct()
    both = lambda a, b: a.join(F.broadcast(b), by) if by else a.join(F.broadcast(b))  # noqa: E731  (a row for each value of ``within``)
    floor = every.groupBy(*by).agg(F.add_months(F.min("date"), min_train_months).alias("floor"))
    pool = both(every, floor).where(F.col("date") >= F.col("floor")).select(*by, "date")
    tests = pool.select(*by, F.ntile(n_folds).over(Window.partitionBy(*by).orderBy("date")).alias("fold"), "date")
    starts = cal.offset(tests.groupBy(*by, "fold").agg(F.min("date").alias("start")), calendar, -embargo, on="start", to="cutoff")
    ends = cal.offset(every, calendar, horizon, to="label_end")
    train = both(ends, starts).where((F.col("date") < F.col("start")) & (F.col("label_end") <= F.col("cutoff")))
    if rolling_months is not None:
        train = train.where(F.col("date") >= F.add_months("start", -rolling_months))
    train = train.select(*by, "fold", "date")
    held = tests.join(train.select(*by, "fold").distinct(), [*by, "fold"], "left_semi")
    return train.withColumn("role", F.lit("train")).unionByName(held.withColumn("role", F.lit("test")))


def stored(rows: DataFrame) -> DataFrame:
    """``rows`` written to the shared folder and read from there: tables of fits and choices are read several times."""
    root = scratch(rows.sparkSession)
    io.put(rows, root, "results", "stored")
    return io.get(rows.sparkSession, root, "results", "stored")


def imputed(rows: DataFrame, features: Sequence[str]) -> DataFrame:
    return rows.fillna(0.0, subset=list(features))


def grams(rows: DataFrame, features: Sequence[str], targets: Sequence[str]) -> DataFrame:
    """date, target, gram: sums of products of (1, features, target) over rows whose target is known, as a lower triangle.

    A date has a row for each batch that holds some of it; they add up.
    """
    size, low = len(features) + 2, np.tril_indices(len(features) + 2)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            days, x = batch.column(0), np.asarray(batch.column(1).flatten(), float).reshape(batch.num_rows, len(features))
            coded = days.dictionary_encode()
            codes, out = np.asarray(coded.indices), ([], [], [])
            for k, t in enumerate(targets):
                y = np.asarray(batch.column(2 + k).cast(pa.float64()), float)
                for c in np.unique(codes[~np.isnan(y)]):
                    own = (codes == c) & ~np.isnan(y)
                    m = np.empty((int(own.sum()), size))
                    m[:, 0], m[:, 1:-1], m[:, -1] = 1, x[own], y[own]
                    for column, value in zip(out, (coded.dictionary[int(c)], t, (m.T @ m)[low]), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], days.type), pa.array(out[1], pa.string()), pa.array(out[2], pa.list_(pa.float64()))], ["date", "target", "gram"])

    x = F.array(*(F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features))
    return rows.where("date IS NOT NULL").select("date", x.alias("x"), *(F.col(t).cast("double").alias(t) for t in targets)).mapInArrow(multiply, "date date, target string, gram array<double>")


class Ridge:
    """Ridge weights from a summed Gram matrix: |y - b - Xw|^2 + alpha |w|^2, the intercept free."""

    def __init__(self, gram: Sequence[float], n_features: int, alpha: float):
        size = n_features + 2
        full = np.zeros((size, size))
        full[np.tril_indices(size)] = gram
        full = full + np.tril(full, -1).T
        n = full[0, 0]
        mean = full[0, 1:] / n
        centred = full[1:, 1:] - n * np.outer(mean, mean)
        self.weights = np.linalg.solve(centred[:-1, :-1] + alpha * np.eye(n_features), centred[:-1, -1])
        self.intercept = float(mean[-1] - mean[:-1] @ self.weights)

    def predict(self, features: Sequence[str]):
        terms = [F.coalesce(F.col(f).cast("double"), F.lit(0.0)) * F.lit(float(w)) for f, w in zip(features, self.weights, strict=True)]
        return sum(terms, F.lit(self.intercept))


def _solved(n_features: int):
    """Batches of (a triangle of sums, penalty) as weights, the intercept first; null where a system has no solution."""

    @F.pandas_udf("array<double>")
    def solve(gram: pd.Series, alpha: pd.Series) -> pd.Series:
        def one(sums, penalty):
            try:
                model = Ridge(np.asarray(sums, float), n_features, float(penalty))
            except np.linalg.LinAlgError:
                return None
            return [model.intercept, *model.weights.tolist()]

        return pd.Series([one(g, a) for g, a in zip(gram, alpha, strict=True)], dtype=object)

    return solve


def fit_ridges(panel: DataFrame, features: Sequence[str], targets: Sequence[str], cells: DataFrame, alphas: Sequence[float]) -> DataFrame:
    """The keys of ``cells``, target, alpha and ``weights`` (intercept first) of one ridge for each cell, target and penalty.

    ``cells`` has its keys and the training dates of each (a small table).  The sums of products of a
    date are aggregated once, joined to all cells that train on it and added up in Spark; all
    systems are then solved in one Arrow step, a row each.
    """
    ship(panel.sparkSession)  # the solves import this module
    keys = [c for c in cells.columns if c != "date"]
    each = grams(panel, features, targets).select("date", "target", F.posexplode("gram").alias("at", "part"))
    by_date = each.groupBy("date", "target", "at").agg(F.sum("part").alias("part"))
    sums = by_date.join(F.broadcast(cells.distinct()), "date").groupBy(*keys, "target", "at").agg(F.sum("part").alias("part"))
    whole = sums.groupBy(*keys, "target").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "part"))), lambda x: x["part"]).alias("gram"))
    asked = whole.select("*", F.explode(F.array(*(F.lit(float(a)) for a in alphas))).alias("alpha"))
    return asked.select(*keys, "target", "alpha", _solved(len(features))(F.col("gram"), F.col("alpha")).alias("weights")).where("weights IS NOT NULL")


def _predicted(rows: DataFrame, features: Sequence[str], tests: DataFrame, fits: Sequence[Row]) -> DataFrame:
    """``rows`` (with date) of the test dates of each cell, once for each of its fits: their columns but the ``features``, ``__fit`` (its place in ``fits``) and ``pred``.

    A batch's rows of a cell meet all weights of the cell side by side, a feature at a time, so that
    equal rows get equal predictions wherever they stand.  ``fits`` has a row a cell, target and
    penalty, as ``tests`` has a row a cell and date.
    """
    keys = [c for c in tests.columns if c != "date"]
    known = [n for n in rows.columns if n not in features]
    weights: dict[tuple, list] = {}
    for k, fit in enumerate(fits):
        weights.setdefault(tuple(fit[c] for c in keys), []).append((k, fit["weights"]))
    stacked = {cell: (np.array([k for k, _ in own], np.int32), np.array([w for _, w in own], float).T) for cell, own in weights.items()}
    names, size = list(stacked), len(features)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells, x = np.asarray(batch.column(0)), np.asarray(batch.column(1).flatten(), float).reshape(batch.num_rows, size)
            for c in np.unique(cells):
                at = np.flatnonzero(cells == c)
                (places, w), of = stacked[names[c]], np.ascontiguousarray(x[at].T)
                pred = np.repeat(w[0][:, None], len(at), axis=1)
                for value, weight in zip(of, w[1:], strict=True):
                    pred += weight[:, None] * value
                each = pa.array(np.tile(at, len(places)))
                yield pa.RecordBatch.from_arrays([*(batch.column(2 + k).take(each) for k in range(len(known))), pa.array(np.repeat(places, len(at))), pa.array(pred.ravel())], [*known, "__fit", "pred"])

    spark = rows.sparkSession
    cells = spark.createDataFrame([(*cell, k) for k, cell in enumerate(names)], T.StructType([*(tests.schema[c] for c in keys), T.StructField("__cell", T.IntegerType())]))
    x = F.array(*(F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features))
    asked = tests.join(F.broadcast(cells), keys).select("date", "__cell")
    own = rows.join(F.broadcast(asked), "date").select("__cell", x.alias("__x"), *known)
    schema = T.StructType([*(rows.schema[c] for c in known), T.StructField("__fit", T.IntegerType()), T.StructField("pred", T.DoubleType())])
    return own.mapInArrow(multiply, schema)


def _fits(spark: SparkSession, weights: DataFrame, fits: Sequence[Row]) -> DataFrame:
    """``__fit`` with the keys, target and penalty of each of ``fits``: a small table."""
    names = [c for c in weights.columns if c != "weights"]
    return spark.createDataFrame([(k, *(fit[c] for c in names)) for k, fit in enumerate(fits)], T.StructType([T.StructField("__fit", T.IntegerType()), *(weights.schema[c] for c in names)]))


def predict_ridges(panel: DataFrame, features: Sequence[str], targets: Sequence[str], tests: DataFrame, weights: DataFrame) -> DataFrame:
    """The keys of ``tests`` (keys, date), target, alpha, date, ticker, ``actual`` and ``pred`` of the test dates of each cell.

    Test dates and weights are small tables (a row a cell and date, a row a cell, target and penalty).
    """
    keys, fits = [c for c in tests.columns if c != "date"], weights.collect()
    own = panel.select("date", "ticker", F.struct(*(F.col(t).cast("double").alias(t) for t in targets)).alias("__y"), *features)
    found = _predicted(own, features, tests, fits).join(F.broadcast(_fits(panel.sparkSession, weights, fits)), "__fit")
    actual = F.coalesce(*(F.when(F.col("target") == t, F.col("__y")[t]) for t in targets))
    return found.select(*keys, "target", "alpha", "date", "ticker", actual.alias("actual"), "pred")


def score_ridges(panel: DataFrame, features: Sequence[str], targets: Sequence[str], tests: DataFrame, weights: DataFrame) -> DataFrame:
    """The keys of ``tests``, target, alpha, date and ``ic``: the coefficients of :func:`predict_ridges`, for which only a fit's number, date and two values are dealt and sorted."""
    keys, fits = [c for c in tests.columns if c != "date"], weights.collect()
    own = panel.select("date", F.array(*(F.col(t).cast("double") for t in targets)).alias("__y"), *features)
    place = F.array(*(F.lit(list(targets).index(fit["target"])) for fit in fits)).cast("array<int>")
    found = _predicted(own, features, tests, fits).select("__fit", "date", "pred", F.get("__y", F.get(place, F.col("__fit"))).alias("actual"))
    ics = information_coefficients(found, "pred", "actual", ("__fit", "date"))
    return ics.join(F.broadcast(_fits(panel.sparkSession, weights, fits)), "__fit").select(*keys, "target", "alpha", "date", "ic")


def ridge_grid(panel: DataFrame, features: Sequence[str], target: str, plan: DataFrame, alphas: Sequence[float]) -> DataFrame:
    """fold, date, ticker, target, pred, alpha: out-of-sample predictions of one ridge for each fold and penalty."""
    weights = fit_ridges(panel, features, [target], plan.where("role = 'train'").select("fold", "date"), alphas)
    found = predict_ridges(panel, features, [target], plan.where("role = 'test'").select("fold", "date"), weights)
    return found.select("fold", "date", "ticker", F.col("actual").alias(target), "pred", "alpha")


def evaluate_ridge(panel: DataFrame, features: Sequence[str], target: str, plan: DataFrame, alpha: float) -> DataFrame:
    """fold, date, ticker, target, pred: out-of-sample predictions of one ridge for each fold."""
    return ridge_grid(panel, features, target, plan, [alpha]).drop("alpha")


def inner_plan(plan: DataFrame, calendar: DataFrame, horizon: int, embargo: int, inner_folds: int = 3, inner_months: int = 24) -> DataFrame:
    """outer, inner, date, role: folds within the training dates of each fold of ``plan``; none where they are too few."""
    train = plan.where("role = 'train'").select(F.col("fold").alias("outer"), "date")
    enough = train.groupBy("outer").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > inner_folds).select("outer")
    inner = folds(train.join(enough, "outer", "left_semi"), calendar, horizon, embargo, inner_months, inner_folds, within=["outer"])
    return inner.withColumnRenamed("fold", "inner")


def chosen_settings(scored: DataFrame, outers: DataFrame, settings: Sequence[str], order: DataFrame) -> DataFrame:
    """target, fold, the ``settings`` of highest mean inner coefficient, ``inner_ic``.

    ``scored`` has per-date coefficients (target, outer, settings, ic), ``outers`` the (target, outer)
    to choose for, ``order`` the candidates with their ``place``.  Of equal ones (up to the twelfth
    digit: sums in another order differ by less) the first candidate wins; it is taken where no
    coefficient is.
    """
    means = scored.groupBy("target", "outer", *settings).agg(F.avg("ic").alias("inner_ic"))
    each = outers.crossJoin(F.broadcast(order)).join(means, ["target", "outer", *settings], "left")  # rows: folds times candidates
    w = Window.partitionBy("target", "outer").orderBy(F.round("inner_ic", 12).desc_nulls_last(), "place")
    best = each.withColumn("__n", F.row_number().over(w)).where("__n = 1")
    return best.select("target", F.col("outer").alias("fold"), *settings, "inner_ic")


def nested_ridges(panel: DataFrame, features: Sequence[str], targets: Sequence[str], plan: DataFrame, calendar: DataFrame, alphas: Sequence[float], horizon: int, embargo: int, inner_folds: int = 3, inner_months: int = 24) -> tuple[DataFrame, DataFrame]:
    """Predictions (target, fold, date, ticker, actual, pred) and the chosen (target, fold, alpha, inner_ic).

    The penalty of a fold is picked in inner folds of its training set.  Outer and inner cells of
    all targets and penalties are one table of fits, solved together, and inner predictions are
    scored in one pass.
    """
    inner = inner_plan(plan, calendar, horizon, embargo, inner_folds, inner_months)
    outer = plan.select(F.col("fold").alias("outer"), F.lit(0).alias("inner"), "date", "role")  # an outer fold is inner cell 0
    cells = inner.select("outer", "inner", "date", "role").unionByName(outer)
    of = lambda role: cells.where(F.col("role") == role).select("outer", "inner", "date")
    weights = stored(fit_ridges(panel, features, targets, of("train"), alphas))
    scored = score_ridges(panel, features, targets, of("test").where("inner > 0"), weights.where("inner > 0"))
    order = panel.sparkSession.createDataFrame([(float(a), k) for k, a in enumerate(alphas)], "alpha double, place int")
    outers = weights.where("inner = 0").select("target", "outer").distinct()
    chosen = stored(chosen_settings(scored, outers, ["alpha"], order))
    final = weights.where("inner = 0").join(F.broadcast(chosen.select("target", F.col("fold").alias("outer"), "alpha")), ["target", "outer", "alpha"])
    found = predict_ridges(panel, features, targets, of("test").where("inner = 0"), final)
    return found.select("target", F.col("outer").alias("fold"), "date", "ticker", "actual", "pred"), chosen


def nested_ridge(panel: DataFrame, features: Sequence[str], target: str, plan: DataFrame, calendar: DataFrame, alphas: Sequence[float], horizon: int, embargo: int, inner_folds: int = 3, inner_months: int = 24) -> tuple[DataFrame, DataFrame]:
    """:func:`nested_ridges` of one target: (fold, date, ticker, target, pred) and (fold, alpha, inner_ic)."""
    found, chosen = nested_ridges(panel, features, [target], plan, calendar, alphas, horizon, embargo, inner_folds, inner_months)
    return found.select("fold", "date", "ticker", F.col("actual").alias(target), "pred"), chosen.drop("target")


def _members(plan: Iterable, fold: int, role: str) -> list:
    return sorted(r["date"] for r in plan if r["fold"] == fold and r["role"] == role)


def _assembled(panel: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    known = imputed(panel.where(F.col(target).isNotNull()), features)
    return VectorAssembler(inputCols=list(features), outputCol="__x").transform(known).select("date", "ticker", target, "__x")


def _boosted(rows: DataFrame, target: str, train: Sequence, depth: int, trees: int, rate: float, seed: int, least: int, subset: str) -> GBTRegressionModel:
    model = GBTRegressor(featuresCol="__x", labelCol=target, predictionCol="pred", maxDepth=depth, maxIter=trees, stepSize=rate, subsamplingRate=0.8, seed=seed, minInstancesPerNode=least, featureSubsetStrategy=subset, maxBins=64)
    return model.fit(rows.where(F.col("date").isin(list(train))))


def boosted_trees(panel: DataFrame, features: Sequence[str], target: str, train: DataFrame, test: DataFrame, depth: int = 3, trees: int = 20, rate: float = 0.1, seed: int = 7, least: int = 1, subset: str = "all") -> DataFrame:
    """date, ticker, target, pred of gradient-boosted trees fitted on ``train`` dates, for ``test`` dates.

    ``least`` rows stand in each leaf; ``subset`` is the share of features tried at a node.
    """
    rows = _assembled(panel, features, target)
    dates = lambda t: [r["date"] for r in t.select("date").distinct().collect()]
    fitted = _boosted(rows, target, dates(train), depth, trees, rate, seed, least, subset)
    return fitted.transform(rows.where(F.col("date").isin(dates(test)))).select("date", "ticker", target, "pred")


def boosted_grid(panel: DataFrame, features: Sequence[str], target: str, plan: DataFrame, depths: Sequence[int], leasts: Sequence[int], trees: int = 20, rate: float = 0.1, at_once: int = 8) -> DataFrame:
    """fold, depth, least, date, ticker, target, pred: boosted trees of each fold and setting; one fit each.

    Fits don't depend on each other, so ``at_once`` of them run side by side: a fit is many short
    jobs, which alone leave most cores idle.  ``panel`` is read by every one; give it stored.
    """
    rows, dates = _assembled(panel, features, target), plan.collect()  # one short row a fold and date
    cells = [(fold, depth, least) for fold in sorted({r["fold"] for r in dates if r["role"] == "train"}) for depth in depths for least in leasts]
    if not cells:
        raise ValueError("no folds: too few training dates")

    def one(cell: tuple[int, int, int]) -> DataFrame:
        fold, depth, least = cell
        fitted = _boosted(rows, target, _members(dates, fold, "train"), depth, trees, rate, 7, least, "0.7")
        found = fitted.transform(rows.where(F.col("date").isin(_members(dates, fold, "test"))))
        return found.select(F.lit(fold).alias("fold"), F.lit(depth).alias("depth"), F.lit(least).alias("least"), "date", "ticker", target, "pred")

    with ThreadPoolExecutor(at_once) as pool:
        return reduce(DataFrame.unionByName, pool.map(one, cells))


def fold_report(predictions: DataFrame, target: str, *setting: str) -> DataFrame:
    """fold (0: pooled over all dates) and the IC summary, of each setting."""
    ics = information_coefficients(predictions, "pred", target, (*setting, "fold", "date"))
    pooled = ic_summary(ics, *setting).select(F.lit(0).alias("fold"), "*")
    return ic_summary(ics, *setting, "fold").unionByName(pooled)
