"""Training, stacking and comparing models. Fitted models are tables of nodes or coefficients (operators/ensembles.py)."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hydrolake.operators import metrics
from hydrolake.operators.ensembles import LinearModel, TreeModel
from hydrolake.operators.ranking import kfold_assign
from hydrolake.plans import learners
from hydrolake.plans.learners import Boosting, Forest, Logistic, Only
from hydrolake.session import cut_lineage

Spec = Boosting | Forest | Logistic
Model = TreeModel | LinearModel

# Learner settings.
RANDOM_FOREST = Forest("rf", trees=100, depth=10, balanced=True, seed=42)
BOOSTED = Boosting("gbt", rounds=100, depth=5, step=0.1)
BOOSTED_3_CLASSES = Boosting("gbt_multi", rounds=100, depth=5, step=0.1, loss="softmax", balanced=True)
LOGISTIC = Logistic("lr", steps=1000, balanced=True)
DEPTH_MODEL = Boosting("depth", rounds=200, depth=5, step=0.05, loss="squared", l2=0.0)
META = Logistic("meta", steps=1000, balanced=False)


def fit(df: DataFrame, spec: Spec, features: Sequence[str], label: str = "label", stored: bool = False) -> Model:
    """One model of all rows that have a label. ``stored``: ``df`` is read from a checkpoint."""
    m = learners.matrix(df, features, label, stored=stored, values=isinstance(spec, Logistic))
    model = learners.fit(m, spec)
    m.release()
    return model


def positive_probability(model: Model, df: DataFrame, name: str = "score") -> DataFrame:
    """Probability of class 1 next to the input columns."""
    return model.predict(df, 0, name)


def importances(model: TreeModel) -> DataFrame:
    """(feature, importance): share of all gains."""
    return model.importances()


def dominant(table: DataFrame, limit: float = 0.15) -> DataFrame:
    """Whether the largest share of importance stays below the limit."""
    return table.agg(F.max_by("feature", "importance").alias("feature"), F.max("importance").alias("importance")).withColumn(
        "balanced", F.col("importance") < limit
    )


def evaluate(scored: DataFrame, label: str, score: str = "score", threshold: float = 0.5) -> DataFrame:
    """Accuracy, F1 of class 1, precision, recall and ROC area in one row."""
    return evaluate_by(scored, [], label, score, threshold)


def evaluate_by(scored: DataFrame, by: Sequence[str], label: str, score: str = "score", threshold: float = 0.5) -> DataFrame:
    """precision, recall, f1, auc, accuracy of every group; one aggregate for the counts, one running sum for the area."""
    by = list(by)
    keys = by or ["_all"]
    rows = scored if by else scored.withColumn("_all", F.lit(0))
    hit, named, real = F.col(label) == 1, F.col(score) >= threshold, F.col(label).isNotNull() & F.col(score).isNotNull()
    cell = lambda a, b: F.count_if(real & a & b).cast("double")
    counts = rows.groupBy(*keys).agg(cell(hit, named).alias("tp"), cell(~hit, named).alias("fp"), cell(hit, ~named).alias("fn"), cell(~hit, ~named).alias("tn"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    counts = counts.withColumns({"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "accuracy": ratio(tp + tn, tp + fp + fn + tn)})
    counts = counts.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    area = metrics.roc_auc(rows, label, score, keys).select(*keys, "auc")
    return counts.join(area, keys, "left").select(*by, "precision", "recall", "f1", "auc", "accuracy")


def _keys(key) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def folded(df: DataFrame, features: Sequence[str], label: str, key, folds: int, seed: int = 42) -> DataFrame:
    """Key, features, label and ``fold`` of every row, computed once."""
    keys = _keys(key)
    return cut_lineage(kfold_assign(df.select(*dict.fromkeys([*keys, *features, label])), label, keys, folds, seed))


def training_sets(rows: DataFrame, folds: int, resample: Callable[[DataFrame], DataFrame] | None, whole: bool) -> tuple[DataFrame, str, list]:
    """Rows, the column that parts them, and what each model is trained on: model k on all folds but k, and the last
    (with ``whole``) on all rows.

    With ``resample`` each training set is resampled by itself, so no synthetic neighbour of a left-out row is trained
    on; the sets then stand one below the other, numbered in ``_set``.
    """
    last = [None] if whole else []
    if resample is None:
        return rows, "fold", [*range(folds), *last]
    sets = [resample(rows.where(F.col("fold") != k)) for k in range(folds)] + [resample(rows) for _ in last]
    out = sets[0].withColumn("_set", F.lit(0))
    for k, s in enumerate(sets[1:], 1):
        out = out.unionByName(s.withColumn("_set", F.lit(k)), allowMissingColumns=True)
    return out, "_set", [Only(k) for k in range(len(sets))]


def cross_fit(rows: DataFrame, specs: Sequence[Spec], features: Sequence[str], label: str, folds: int,
              resample: Callable[[DataFrame], DataFrame] | None = None, whole: bool = False) -> dict[str, Model]:
    """All models of all folds, side by side: model k of a learner has not seen fold k; model ``folds``, if ``whole``, has seen all rows.

    The rows are binned once for all learners and folds.
    """
    data, column, held = training_sets(rows, folds, resample, whole)
    m = learners.matrix(data, features, label, column, stored=resample is None, values=any(isinstance(s, Logistic) for s in specs))
    # learners run side by side: the short passes of one fill the gaps between those of another
    with ThreadPoolExecutor(max(1, len(specs))) as pool:
        found = list(pool.map(lambda s: learners.fit(m, s, held), specs))
    m.release()
    return {s.name: model for s, model in zip(specs, found)}


def out_of_fold(rows: DataFrame, models: dict[str, Model]) -> DataFrame:
    """Adds ``p_<name>``: each row's probability by the models that have not seen its fold. One pass, no join."""
    for name, model in models.items():
        rows = model.predict(rows, "fold", f"p_{name}")
    return rows


@dataclass
class Stack:
    """Base models and a logistic regression over their probabilities. ``number``: the base models fitted on all rows."""

    bases: dict[str, Model]
    meta: LinearModel
    number: int

    def transform(self, df: DataFrame) -> DataFrame:
        for name, model in self.bases.items():
            df = model.predict(df, self.number, f"p_{name}")
        return self.meta.predict(df).drop(*[f"p_{n}" for n in self.bases])


def stack(df: DataFrame, specs: Sequence[Spec], features: Sequence[str], label: str, key, folds: int = 5, seed: int = 42,
          resample: Callable[[DataFrame], DataFrame] | None = None) -> Stack:
    """Stacked ensemble: the meta model learns from out-of-fold probabilities."""
    rows = folded(df, features, label, key, folds, seed)
    bases = cross_fit(rows, specs, features, label, folds, resample, whole=True)
    table = out_of_fold(rows, bases).select(label, *[f"p_{s.name}" for s in specs])
    return Stack(bases, fit(table, META, [f"p_{s.name}" for s in specs], label), folds)


SCORES = ("precision", "recall", "f1", "auc", "accuracy")


def fold_scores(df: DataFrame, specs: Sequence[Spec], features: Sequence[str], label: str, key, folds: int = 10, seed: int = 42,
                resample: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """model, fold and its scores on the rows of that fold, for every model."""
    rows = folded(df, features, label, key, folds, seed)
    scored = out_of_fold(rows, cross_fit(rows, specs, features, label, folds, resample))
    long = scored.select("fold", label, F.explode(F.array(*[F.struct(F.lit(s.name).alias("model"), F.col(f"p_{s.name}").alias("score")) for s in specs])).alias("s"))
    return evaluate_by(cut_lineage(long.select("fold", label, "s.*")), ["model", "fold"], label)


def compare(df: DataFrame, specs: Sequence[Spec], features: Sequence[str], label: str, key, folds: int = 10, seed: int = 42,
            resample: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Mean and spread over the folds of every score per model; the best by mean F1 is marked."""
    each = fold_scores(df, specs, features, label, key, folds, seed, resample)
    parts = [x for c in SCORES for x in (F.avg(c).alias(c), F.stddev_pop(c).alias(f"{c}_spread"))]
    table = cut_lineage(each.groupBy("model").agg(F.count(F.lit(1)).alias("folds"), *parts))
    best = table.agg(F.min_by("model", F.struct(-F.col("f1"), F.col("model"))).alias("m")).scalar()
    return table.withColumn("is_best", F.col("model") == best)


def tuned_threshold(scored: DataFrame, label: str, score: str = "score") -> float:
    """The threshold with the largest F1."""
    return metrics.best_threshold(scored, label, score).first()["threshold"]


@dataclass
class Trained:
    """A stack and the threshold tuned on out-of-fold probabilities."""

    ensemble: Stack
    threshold: float

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds ``score`` and ``prediction``."""
        return self.ensemble.transform(df).withColumn("prediction", metrics.apply_threshold("score", self.threshold))


def train_ensemble(df: DataFrame, specs: Sequence[Spec], features: Sequence[str], label: str, key, folds: int = 5, seed: int = 42,
                   resample: Callable[[DataFrame], DataFrame] | None = None) -> Trained:
    """Stack, then the threshold: the meta model's scores of rows by bases that have not seen them decide it."""
    rows = folded(df, features, label, key, folds, seed)
    bases = cross_fit(rows, specs, features, label, folds, resample, whole=True)
    table = cut_lineage(out_of_fold(rows, bases).select(label, *[f"p_{s.name}" for s in specs]))
    meta = fit(table, META, [f"p_{s.name}" for s in specs], label, stored=True)
    return Trained(Stack(bases, meta, folds), tuned_threshold(meta.predict(table), label))
