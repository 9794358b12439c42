"""Classification reports and the A/B experiment with distributed linear models."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import mix_hash
from ..sources.scratch import discard_tables, materialize


def accuracy(p: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    return p.agg(F.avg((F.col(label) == F.col(pred)).cast("double")).alias("accuracy"), F.count(F.lit(1)).alias("n"))


def confusion(p: DataFrame, classes: list[int], label: str = "label", pred: str = "pred") -> DataFrame:
    wide = p.groupBy(label).pivot(pred, classes).agg(F.count(F.lit(1))).fillna(0)
    return wide.select(label, *[F.col(f"`{c}`").alias(f"p{c}") for c in classes])


def per_class(p: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    """precision, recall, f1, support of every class; 0 where a ratio has no rows. One aggregation over both roles of a row."""
    rows = p.select(F.explode(F.array(F.struct(F.col(label).alias("k"), F.lit(1).alias("is_label"), (F.col(label) == F.col(pred)).cast("int").alias("hit"), F.lit(0).alias("is_pred")),
                                      F.struct(F.col(pred).alias("k"), F.lit(0).alias("is_label"), F.lit(0).alias("hit"), F.lit(1).alias("is_pred")))).alias("r")).select("r.*")
    s = rows.groupBy("k").agg(F.sum("hit").alias("tp"), F.sum("is_pred").alias("np"), F.sum("is_label").alias("support"))
    z = lambda c: F.coalesce(c, F.lit(0.0))
    s = s.withColumns({"precision": z(F.try_divide(F.col("tp"), F.col("np"))), "recall": z(F.try_divide(F.col("tp"), F.col("support")))})
    return s.withColumn("f1", z(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))))


def report(p: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    """The classification report in long form: one row per class, then accuracy, macro and weighted averages."""
    c = per_class(p, label, pred)
    cols = ["precision", "recall", "f1"]
    rows = c.select(F.concat(F.lit("Grade "), F.col("k")).alias("name"), *cols, F.col("support").cast("long").alias("support"))
    w = lambda m: F.try_divide(F.sum(F.col(m) * F.col("support")), F.sum("support")).alias(m)
    macro = c.agg(*[F.avg(m).alias(m) for m in cols], F.sum("support").alias("support")).select(F.lit("macro avg").alias("name"), *cols, "support")
    weighted = c.agg(*[w(m) for m in cols], F.sum("support").alias("support")).select(F.lit("weighted avg").alias("name"), *cols, "support")
    acc = c.agg(F.try_divide(F.sum("tp"), F.sum("support")).alias("a"), F.sum("support").alias("support")).select(F.lit("accuracy").alias("name"), F.col("a").alias("precision"), F.col("a").alias("recall"), F.col("a").alias("f1"), "support")
    return rows.unionByName(acc).unionByName(macro).unionByName(weighted)


def improvement(base: Column, new: Column) -> tuple[Column, Column]:
    """Percentage points and a verdict."""
    points = (new - base) * 100
    return points, F.when(points > 0, "improved").when(points < 0, "worse").otherwise("unchanged")


def compare_runs(base: DataFrame, new: DataFrame) -> DataFrame:
    """Two one-row results (accuracy) side by side."""
    points, verdict = improvement(F.col("baseline"), F.col("augmented"))
    return base.select(F.col("accuracy").alias("baseline")).join(F.broadcast(new.select(F.col("accuracy").alias("augmented")))).withColumns({"points": points, "verdict": verdict})


#: Shares of a class and features are rounded to such parts before they are multiplied and summed: sums of up to 10^8 rows are exact then, whatever the order of the
#: rows, so that every run of an experiment gives the same model.
SHARE, FEATURE = 1 << 16, 1 << 10


def _features(b: pa.RecordBatch, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Features with a constant behind them, and which rows have as many as are asked for."""
    col = b.column("x").cast(pa.list_(pa.float64()))
    n = pc.fill_null(pc.list_value_length(col), -1).to_numpy(zero_copy_only=False)
    ok = n == size
    x = col.filter(pa.array(ok)).flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
    return np.concatenate((np.round(np.nan_to_num(x) * FEATURE) / FEATURE, np.ones((len(x), 1))), 1), ok


def _shares(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    z = x @ w.T
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def gradients(rows: DataFrame, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``rows``: x (features), y (class number), runs (numbers of the runs that train on the row). ``weights``: run, class, feature. The sum of the cross entropy's gradients
    over the rows of each run, and the number of these rows. A task sums what it reads; these sums are added by an aggregation, and what comes to the driver has the size of
    the model."""
    n_runs, n_classes, width = weights.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros_like(weights), np.zeros(n_runs)
        for b in batches:
            x, ok = _features(b, width - 1)
            y = b.column("y").filter(pa.array(ok)).to_numpy(zero_copy_only=False)
            on = b.column("runs").filter(pa.array(ok)).to_pylist()
            for r in range(n_runs):
                mine = np.array([r in k for k in on], bool)
                if mine.any():
                    p = _shares(x[mine], weights[r])
                    p[np.arange(len(p)), y[mine]] -= 1
                    total[r] += (np.round(p * SHARE) / SHARE).T @ x[mine]
                    n[r] += mine.sum()
        flat = np.concatenate((total.ravel(), n))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat)), pa.int64()), pa.array(flat)], names=["at", "v"])

    sums = rows.select("x", "y", "runs").mapInArrow(run, "at bigint, v double").groupBy("at").agg(F.sum("v").alias("v")).toPandas()
    flat = np.zeros(weights.size + n_runs)
    flat[sums["at"].to_numpy()] = sums["v"].to_numpy()
    return flat[: weights.size].reshape(weights.shape), flat[weights.size :]


def predict(rows: DataFrame, weights: np.ndarray, names: list[str], classes: list[int]) -> DataFrame:
    """``rows``: x, label. run, label, pred of every row under the weights of every run; of equal shares the first class counts. Rows without proper features have no prediction
    (null)."""
    width = weights.shape[2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, ok = _features(b, width - 1)
            for name, w in zip(names, weights):
                pred = np.full(len(ok), None, object)
                pred[ok] = [classes[k] for k in (x @ w.T).argmax(1)]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(ok)), b.column("label").cast(pa.int32()), pa.array(pred.tolist(), pa.int32())], names=["run", "label", "pred"])

    return rows.select("x", "label").mapInArrow(run, "run string, label int, pred int")


def train_epochs(train: DataFrame, valid: DataFrame, runs: dict[str, Column], classes: list[int], epochs: int, steps: int = 2, rate: float = 2.0, shrink: float = 1e-4, features: str = "embedding", label: str = "label", key: str = "vec_id", seed: int = 0) -> tuple[list[dict], DataFrame]:
    """Train a linear classifier for each run (``runs``: name and condition on the rows it trains on) over ``epochs`` epochs, all runs in the same passes. The rows of an epoch are dealt
    anew to ``steps`` mini-batches by a hash of key and epoch; after each the weights move against the mean gradient, and they go on from epoch to epoch. Returns for every run and
    epoch the accuracy on ``valid`` (run, epoch, accuracy), and the predictions of the last epoch (run, label, pred), written to the shared folder.

    Rows whose label is no class, or whose features are missing or of another number than the first row's, train nothing; in ``valid`` they count as wrong. The weights are as many numbers as
    classes times features, and are held by the driver and sent with every task."""
    member = F.filter(F.array(*[F.when(c, F.lit(k)) for k, c in enumerate(runs.values())]), lambda r: r.isNotNull())
    number = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(label).cast("int")) - 1
    rows = train.select(F.col(key).cast("long").alias("id"), F.col(features).alias("x"), number.cast("int").alias("y"), member.alias("runs"))
    rows = materialize(rows.filter((F.col("y") >= 0) & (F.size("runs") > 0) & F.col("x").isNotNull()), "experiment-rows")
    judged = materialize(valid.select(F.col(features).alias("x"), F.col(label).cast("int").alias("label")), "experiment-valid")
    first = rows.orderBy("id").select(F.size("x")).first()
    weights = np.zeros((len(runs), len(classes), (first[0] if first else 0) + 1))
    log: list[dict] = []
    names = list(runs)
    for epoch in range(epochs):
        for step in range(steps):
            mine = rows.filter(F.pmod(F.shiftright(mix_hash(F.col("id"), seed + epoch), 8), F.lit(steps)) == step)
            g, n = gradients(mine, weights)
            weights = weights - rate * (g / np.maximum(n, 1)[:, None, None] + shrink * weights)
        p = predict(judged, weights, names, classes)
        if epoch == epochs - 1:
            p = materialize(p, "experiment-predictions")
        hits = {r["run"]: r["a"] for r in p.groupBy("run").agg(F.avg(F.coalesce((F.col("label") == F.col("pred")).cast("double"), F.lit(0.0))).alias("a")).collect()}
        log += [{"run": name, "epoch": epoch + 1, "accuracy": float(hits.get(name, 0.0))} for name in names]
    discard_tables(rows, judged)
    return log, p


def ab_experiment(base: DataFrame, more: DataFrame, valid: DataFrame, classes: list[int], epochs: int = 8, **options) -> dict[str, DataFrame]:
    """Train on ``base``, and on ``base`` and ``more``; judge both on ``valid`` after every epoch. ``epochs``: run, epoch, accuracy, is_best (better than all before). ``summary``: run, best_epoch, accuracy
    (the best), points (over the first run's best), verdict. ``predictions``, ``report`` and ``confusion`` are those of the last epoch, which need not be the best."""
    spark = base.sparkSession
    both = base.withColumn("_base", F.lit(True)).unionByName(more.withColumn("_base", F.lit(False)))
    log, p = train_epochs(both, valid, {"baseline": F.col("_base"), "augmented": F.lit(True)}, classes, epochs, **options)
    best: dict[str, dict] = {}
    for r in log:
        r["is_best"] = r["run"] not in best or r["accuracy"] > best[r["run"]]["accuracy"]
        if r["is_best"]:
            best[r["run"]] = r
    rows = spark.createDataFrame([(k, r["epoch"], r["accuracy"], best["baseline"]["accuracy"]) for k, r in best.items()], "run string, best_epoch int, accuracy double, first double")
    points, verdict = improvement(F.col("first"), F.col("accuracy"))
    tagged = lambda f: [f(p.filter(F.col("run") == k).drop("run")).withColumn("run", F.lit(k)) for k in best]
    reports, tables = tagged(report), tagged(lambda d: confusion(d, classes))
    return {"epochs": spark.createDataFrame(log, "run string, epoch int, accuracy double, is_best boolean"), "summary": rows.withColumns({"points": points, "verdict": verdict}).drop("first"), "predictions": p,
            "report": reports[0].unionByName(reports[1]), "confusion": tables[0].unionByName(tables[1])}
