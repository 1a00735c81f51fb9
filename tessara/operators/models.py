"""Component models by segment, on MLlib: fit, prune, score, explain, calibrate, compare.

Fitting is an action for each model and segment; what comes to the driver is coefficients. Scoring is a Column
expression built from them, so any number of models score in one pass and no vector leaves the JVM.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, GeneralizedLinearRegression, IsotonicRegression, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessara.functions import numeric as N
from tessara.operators.summarize import pair_correlations


@dataclass(frozen=True)
class Linear:
    """A fitted linear predictor: feature weights, an intercept and the link (log, logit or identity)."""

    weights: dict[str, float]
    intercept: float
    link: str
    errors: dict[str, float] | None = None

    def score(self) -> Column:
        """The prediction; a missing feature counts as 0, as in fitting."""
        eta = reduce(lambda a, b: a + b, [F.coalesce(F.col(f).cast("double"), F.lit(0.0)) * w for f, w in self.weights.items()], F.lit(self.intercept))
        return F.exp(eta) if self.link == "log" else N.sigmoid(eta) if self.link == "logit" else eta

    def contributions(self, means: dict[str, float]) -> dict[str, Column]:
        """Exact additive contributions on the link scale: weight times the distance from the mean."""
        return {f: (F.coalesce(F.col(f).cast("double"), F.lit(0.0)) - means.get(f, 0.0)) * w for f, w in self.weights.items()}


def design(frame: DataFrame, features: list[str], target: str, weight: str | None = None) -> DataFrame:
    """(__x, __y, __w) with missing features as 0; rows without target are dropped."""
    filled = frame.where(F.col(target).isNotNull()).select(*[F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in features], F.col(target).cast("double").alias("__y"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("__w"))
    return VectorAssembler(inputCols=features, outputCol="__x").transform(filled).select("__x", "__y", "__w")


def varying(frame: DataFrame, features: list[str]) -> list[str]:
    """Features with a variance above 0, found in one aggregate."""
    if not features:
        return []
    row = frame.agg(*[F.var_samp(F.coalesce(F.col(f).cast("double"), F.lit(0.0))).alias(f) for f in features]).first()
    return [f for f in features if row[f] is not None and row[f] > 0]


def prune_correlated(frame: DataFrame, features: list[str], above: float) -> list[str]:
    """Features in order, without those that correlate above a threshold with one kept before."""
    if len(features) < 2:
        return list(features)
    filled = frame.select(*[F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in features])
    r = {(x["x"], x["y"]): x["r"] for x in pair_correlations(filled, features).collect()}
    kept: list[str] = []
    for f in features:
        if all(abs(r.get((g, f)) or 0.0) <= above for g in kept):
            kept.append(f)
    return kept


def family_best(frame: DataFrame, features: list[str], target: str, family: dict[str, str], events: int) -> list[str]:
    """Of each family of features the one that correlates most with the target; at most events // 15 of them, 4 at least."""
    row = frame.agg(*[F.corr(F.col(f).cast("double"), F.col(target).cast("double")).alias(f) for f in features]).first()
    strength = {f: abs(row[f]) if row[f] is not None and row[f] == row[f] else 0.0 for f in features}
    best: dict[str, str] = {}
    for f in sorted(features, key=lambda x: (-strength[x], x)):
        best.setdefault(family.get(f, f), f)
    return list(best.values())[: max(4, events // 15)]


def fit_glm(frame: DataFrame, target: str, features: list[str], family: str = "poisson", weight: str | None = None) -> Linear:
    """Poisson (log), binomial (logit) or gaussian (identity), unpenalised, with frequency weights.

    A design without features gives the weighted mean; standard errors are absent where the design is singular.
    """
    link = {"poisson": "log", "binomial": "logit", "gaussian": "identity"}[family]
    if not features:
        w = F.col(weight).cast("double") if weight else F.lit(1.0)
        mean = frame.where(F.col(target).isNotNull()).agg((F.sum(F.col(target) * w) / F.sum(w)).alias("m")).first()["m"]
        m = min(max(float(mean or 0.0), 1e-9), 1 - 1e-9 if family == "binomial" else float("inf"))
        return Linear({}, math.log(m) if link == "log" else math.log(m / (1 - m)) if link == "logit" else float(mean or 0.0), link)
    rows = design(frame, features, target, weight)
    model = GeneralizedLinearRegression(family=family, link=link, featuresCol="__x", labelCol="__y", weightCol="__w", maxIter=50, tol=1e-9).fit(rows)
    try:
        errors = dict(zip([*features, "intercept"], map(float, model.summary.coefficientStandardErrors)))
    except Exception:  # a singular design has none
        errors = None
    return Linear(dict(zip(features, map(float, model.coefficients))), float(model.intercept), link, errors)


def fit_lasso(frame: DataFrame, target: str, features: list[str], alpha: float = 0.1, weight: str | None = None) -> Linear:
    """A logistic fit with an L1 penalty: it has a solution where the unpenalised one has none."""
    model = LogisticRegression(featuresCol="__x", labelCol="__y", weightCol="__w", regParam=alpha, elasticNetParam=1.0, maxIter=100).fit(design(frame, features, target, weight))
    return Linear(dict(zip(features, map(float, model.coefficients))), float(model.intercept), "logit")


#: On the logit scale no event is less likely than this; a fit that says so runs away from separated data.
RUNAWAY = 15.0


def fit_logistic(frame: DataFrame, target: str, features: list[str], weight: str | None = None, alpha: float = 0.1, rounds: int = 50) -> tuple[Linear, bool]:
    """(model, converged): unpenalised logistic; ``fit_lasso`` where that does not converge.

    It has not converged if it used all its rounds, if a coefficient or an error is no number, or if the effect of one
    standard deviation of a feature is beyond ``RUNAWAY`` (the classes are separated).
    """
    if not features:
        return fit_glm(frame, target, features, "binomial", weight), True
    rows = design(frame, features, target, weight)
    try:
        model = GeneralizedLinearRegression(family="binomial", link="logit", featuresCol="__x", labelCol="__y", weightCol="__w", maxIter=rounds, tol=1e-8).fit(rows)
        errors = [float(x) for x in model.summary.coefficientStandardErrors]
        numbers = [*map(float, model.coefficients), float(model.intercept)]
        spread = frame.agg(*[F.stddev_pop(F.coalesce(F.col(f).cast("double"), F.lit(0.0))).alias(f) for f in features]).first()
        fine = model.summary.numIterations < rounds and all(math.isfinite(x) for x in [*numbers, *errors])
        fine = fine and all(abs(c) * (spread[f] or 0.0) < RUNAWAY for f, c in zip(features, numbers))
    except Exception:  # a singular design is no fit either
        fine = False
    if not fine:
        return fit_lasso(frame, target, features, alpha, weight), False
    return Linear(dict(zip(features, numbers)), numbers[-1], "logit", dict(zip([*features, "intercept"], errors))), True


def fit_ols(frame: DataFrame, target: str, features: list[str]) -> Linear:
    model = LinearRegression(featuresCol="__x", labelCol="__y", weightCol="__w", regParam=0.0, solver="normal").fit(design(frame, features, target))
    return Linear(dict(zip(features, map(float, model.coefficients))), float(model.intercept), "identity")


def fit_segments(frame: DataFrame, segment: str, values: list[str], target: str, features: list[str], family: str = "poisson", weight: str | None = None, least: int = 60) -> dict[str, Linear]:
    """A model for each segment with enough rows, on the features that vary in it."""
    sizes = {r[segment]: r["n"] for r in frame.where(F.col(segment).isin(values) & F.col(target).isNotNull()).groupBy(segment).agg(F.count("*").alias("n")).collect()}
    out = {}
    for value in values:
        if sizes.get(value, 0) >= least:
            rows = frame.where(F.col(segment) == value)
            out[value] = fit_glm(rows, target, varying(rows, features), family, weight)
    return out


def score_segments(models: dict[str, Linear], segment: str, default: float = 0.0) -> Column:
    """The prediction of a row's segment; a segment without model gets the default."""
    out = F.lit(default)
    for value, model in models.items():
        out = F.when(F.col(segment) == value, model.score()).otherwise(out)
    return out


def coefficient_table(frame: DataFrame, models: dict[str, Linear]) -> DataFrame:
    """(segment, feature, coefficient, ratio, z): what was fitted, as rows."""
    rows = [(s, f, float(w), (m.errors or {}).get(f)) for s, m in models.items() for f, w in [*m.weights.items(), ("intercept", m.intercept)]]
    out = frame.sparkSession.createDataFrame(rows, "segment string, feature string, coefficient double, error double")
    return out.select("segment", "feature", "coefficient", F.exp("coefficient").alias("ratio"), F.try_divide("coefficient", "error").alias("z"))


def fit_trees(frame: DataFrame, target: str, features: list[str], kind: str = "forest", classify: bool = False, trees: int = 300, depth: int = 5, weight: str | None = None, step: float = 0.05):  # noqa: ANN201
    """(model, assembler) of a random forest or of gradient boosting; importances are the model's own."""
    assembler = VectorAssembler(inputCols=features, outputCol="__x")
    common = {"featuresCol": "__x", "labelCol": "__y", "weightCol": "__w", "maxDepth": depth, "seed": 42}
    if kind == "forest":
        maker = RandomForestClassifier if classify else RandomForestRegressor
        learner = maker(numTrees=trees, featureSubsetStrategy="sqrt" if classify else "all", **common)
    else:
        maker = GBTClassifier if classify else GBTRegressor
        learner = maker(maxIter=trees, stepSize=step, **common)
    return learner.fit(design(frame, features, target, weight)), assembler


def score_trees(model, assembler, frame: DataFrame, out: str) -> DataFrame:  # noqa: ANN001
    """``frame`` with a tree model's prediction (a classifier's probability of 1)."""
    from pyspark.ml.functions import vector_to_array

    features = assembler.getInputCols()
    filled = frame.withColumns({f"__f_{f}": F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features})
    scored = model.transform(VectorAssembler(inputCols=[f"__f_{f}" for f in features], outputCol="__x").transform(filled))
    value = vector_to_array("probability")[1] if "probability" in scored.columns else F.col("prediction")
    return scored.select(*frame.columns, value.alias(out))


def fit_platt(frame: DataFrame, probability: str, actual: str) -> tuple[float, float]:
    """(a, b) of sigmoid(a * logit(p) + b), with an L2 penalty of 1 on the whole sample."""
    rows = frame.where(F.col(probability).isNotNull() & F.col(actual).isNotNull()).select(N.logit(F.col(probability)).alias("z"), F.col(actual).cast("double").alias("y"))
    n = rows.count()
    x = VectorAssembler(inputCols=["z"], outputCol="x").transform(rows)
    model = LogisticRegression(featuresCol="x", labelCol="y", regParam=1.0 / max(n, 1), elasticNetParam=0.0, standardization=False, maxIter=100).fit(x)
    return float(model.coefficients[0]), float(model.intercept)


def fit_isotonic(frame: DataFrame, probability: str, actual: str, weight: str | None = None) -> tuple[list[float], list[float]]:
    """Boundaries and values of a rising step function over all rows; interpolated between, clamped at the ends.

    Equal probabilities are summed first (their mean outcome with their weight), which changes nothing in the fit.
    """
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    known = frame.select(F.col(probability).cast("double").alias("p"), F.col(actual).cast("double").alias("y"), w.alias("w")).dropna()
    summed = known.groupBy("p").agg((F.sum(F.col("y") * F.col("w")) / F.sum("w")).alias("y"), F.sum("w").alias("w"))
    model = IsotonicRegression(featuresCol="p", labelCol="y", weightCol="w").fit(summed)
    return [float(x) for x in model.boundaries], [float(x) for x in model.predictions]


def apply_isotonic(probability: Column, boundaries: list[float], values: list[float]) -> Column:
    """A fitted isotonic function as an expression."""
    b, v = F.array(*[F.lit(x) for x in boundaries]), F.array(*[F.lit(x) for x in values])
    at = F.size(F.filter(b, lambda x: x <= probability))
    x0, x1, y0, y1 = F.get(b, at - 1), F.get(b, at), F.get(v, at - 1), F.get(v, at)
    between = y0 + (y1 - y0) * F.coalesce(F.try_divide(probability - x0, x1 - x0), F.lit(0.0))
    return F.when(at == 0, F.lit(values[0])).when(at == len(boundaries), F.lit(values[-1])).otherwise(between)


def fit_cross_calibrated(train: DataFrame, key: str | list[str], target: str, features: list[str], folds: int = 5) -> list[tuple[Linear, float, float]]:
    """For each fold a logistic model fitted on the others, and its Platt scaling fitted on that fold.

    A scaling thus never sees the rows that its model was fitted on.
    """
    folded = train.withColumn("__fold", F.pmod(F.xxhash64(*([key] if isinstance(key, str) else key)), F.lit(folds)))
    out = []
    for k in range(folds):
        rest, held = folded.where(F.col("__fold") != k), folded.where(F.col("__fold") == k)
        model, _ = fit_logistic(rest, target, varying(rest, features))
        out.append((model, *fit_platt(held.withColumn("__p", model.score()), "__p", target)))
    return out


def score_cross_calibrated(fitted: list[tuple[Linear, float, float]]) -> Column:
    """The mean of the folds' calibrated probabilities."""
    return reduce(lambda a, b: a + b, [N.platt(model.score(), a, b) for model, a, b in fitted]) / len(fitted)


def sign_label(coefficient: Column, expected: Column) -> Column:
    """Whether a coefficient has the sign that its feature ought to have: as expected, reversed, or none at all."""
    return F.when(F.abs(coefficient) < 1e-9, "none").when(F.signum(coefficient) == F.signum(expected), "as expected").otherwise("reversed")


def probe(model: Linear, frame: DataFrame) -> dict[str, float]:
    """(best, worst) predictions at the most and the least favourable values observed of every feature."""
    row = frame.agg(*[x for f in model.weights for x in (F.min(F.col(f).cast("double")).alias(f"a_{f}"), F.max(F.col(f).cast("double")).alias(f"z_{f}"))]).first()
    link = {"log": math.exp, "logit": lambda x: 1 / (1 + math.exp(-x)), "identity": float}[model.link]
    best = model.intercept + sum(w * (row[f"z_{f}"] if w > 0 else row[f"a_{f}"]) for f, w in model.weights.items())
    worst = model.intercept + sum(w * (row[f"a_{f}"] if w > 0 else row[f"z_{f}"]) for f, w in model.weights.items())
    return {"best": link(best), "worst": link(worst)}


def tournament(test: DataFrame, actual: str, scores: dict[str, Column]) -> DataFrame:
    """(version, mae, brier, n): several versions on the rows that all can score, best first."""
    scored = test.select(F.col(actual).alias("__y"), *[c.alias(n) for n, c in scores.items()]).dropna()
    one = scored.agg(F.count("*").alias("n"), *[x for n in scores for x in (F.avg(F.abs(F.col(n) - F.col("__y"))).alias(f"m_{n}"), F.avg(F.pow(F.col(n) - F.col("__y"), 2)).alias(f"b_{n}"))])
    return one.select(F.inline(F.array(*[F.struct(F.lit(n).alias("version"), F.col(f"m_{n}").alias("mae"), F.col(f"b_{n}").alias("brier"), F.col("n").alias("n")) for n in scores]))).orderBy("brier", "version")


def replaced(total: Column, old: Column, new: Column) -> Column:
    """A stored total with one of its parts exchanged."""
    return total - F.coalesce(old, F.lit(0.0)) + F.coalesce(new, F.lit(0.0))


def points_mix(components: dict[str, tuple[Column, float, Column]]) -> dict[str, Column]:
    """Expected points by component: (expectation, weight, gate) -> expectation * weight * gate, and their sum."""
    parts = {f"pts_{n}": F.coalesce(value, F.lit(0.0)) * weight * F.coalesce(gate, F.lit(0.0)) for n, (value, weight, gate) in components.items()}
    return parts | {"pts_total": reduce(lambda a, b: a + b, parts.values())}
