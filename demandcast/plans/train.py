"""Training: base models, blend, stack, metrics."""

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from demandcast.operators import models
from demandcast.operators.evaluate import blend_weights, regression_metrics
from demandcast.operators.split import folds_by_date
from demandcast.schema import FEATURES, HOLDOUT_DAYS, PREDICTIONS, SERIES
from demandcast.session import materialize, shared_folder

MODEL_NAMES = {"GBT": "pred_gbt", "RF": "pred_rf", "Ensemble": "pred_ensemble", "MetaLearner": "pred_meta"}


class NoForecast(Exception):
    """The models at hand cannot make a forecast."""


@dataclass
class Forecaster:
    """Fitted models. A missing one is None."""

    gbt: object = None
    rf: object = None
    meta: object = None
    weights: dict[str, float] = field(default_factory=dict)
    features: tuple[str, ...] = FEATURES

    def predict(self, df: DataFrame) -> DataFrame:
        """Add pred_gbt, pred_rf, the blend where weights are known, and pred_final.

        pred_final is the stacked forecast, or the mean of the base models
        when there is no stacking model. A stacking model needs both bases.
        Predictions are columns of the same rows; nothing is joined.
        """
        bases = {n: m for n, m in (("gbt", self.gbt), ("rf", self.rf)) if m is not None}
        if not bases:
            raise NoForecast("no base model")
        if self.meta is not None and len(bases) < len(models.BASES):
            raise NoForecast("the stacking model needs both base models")
        out = models.assemble(df, self.features)
        for model in bases.values():
            out = model.transform(out)
        columns = {n: F.col(models.BASES[n]) for n in bases}
        if self.weights and len(bases) == len(models.BASES):
            blend = reduce(lambda a, b: a + b, [c * self.weights[n] for n, c in columns.items()])
            out = out.withColumn("pred_ensemble", blend)
        if self.meta is not None:
            out = self.meta.transform(models.meta_vector(out)).drop("meta_features")
            final = F.col("pred_meta")
        else:
            final = reduce(lambda a, b: a + b, columns.values()) / len(columns)
        return out.withColumn("pred_final", final).drop("features")


@dataclass
class Training:
    """A forecaster with what was learned about it."""

    forecaster: Forecaster
    scored: DataFrame  # stored rows with `role` and the served base models' predictions
    meta_scores: DataFrame
    meta_name: str
    stacked: DataFrame  # rows that the stack learned from
    judged: DataFrame  # rows that it was chosen on

    def predictions(self) -> DataFrame:
        """Test rows: keys, inputs, `true` and all predictions."""
        weights = self.forecaster.weights
        blend = F.col("pred_gbt") * weights["gbt"] + F.col("pred_rf") * weights["rf"]
        test = self.scored.where(F.col("role") == "test").withColumn("pred_ensemble", blend)
        test = self.forecaster.meta.transform(models.meta_vector(test))
        return test.select(
            "date", *SERIES, *self.forecaster.features, F.col("target").alias("true"), *PREDICTIONS
        )

    def metrics(self) -> DataFrame:
        return regression_metrics(self.predictions(), "true", MODEL_NAMES)


def assign_roles(
    rows: DataFrame, holdout_days: int = HOLDOUT_DAYS, reference_mode: bool = False
) -> DataFrame:
    """Add `role`: fit, valid or test, by calendar days back from the last date.

    Validation rows stop the boosting and set blend weights and stacking. By
    default they are the last days before the test rows; in reference mode the
    test rows themselves play that part, which flatters the metrics.
    """
    last = rows.agg(F.max("date")).scalar()
    test = F.col("date") > F.date_sub(last, holdout_days)
    valid = F.col("date") > F.date_sub(last, 2 * holdout_days)
    role = F.when(test, "test")
    if not reference_mode:
        role = role.when(valid, "valid")
    return rows.withColumn("role", role.otherwise("fit"))


def out_of_fold(
    fit_rows: DataFrame, folds: int, gbt_params: dict | None, rf_params: dict | None
) -> DataFrame:
    """Base predictions for the later part of the fit rows, each from models of earlier dates only.

    Folds are cut by date; `folds` bounds the number of fits.
    """
    folded = folds_by_date(fit_rows, folds)
    scored = None
    for k in range(1, folds + 1):
        known = models.assemble(folded.where(F.col("fold") < k)).select("target", "features")
        gbt, rf = models.fit_gbt(known, gbt_params), models.fit_rf(known, rf_params)
        part = Forecaster(gbt, rf).predict(folded.where(F.col("fold") == k))
        part = part.select("date", *SERIES, "target", *models.BASES.values())
        scored = part if scored is None else scored.unionByName(part)
    return scored


def train_forecaster(
    rows: DataFrame,
    holdout_days: int = HOLDOUT_DAYS,
    gbt_params: dict | None = None,
    rf_params: dict | None = None,
    reference_mode: bool = False,
    stack_folds: int = 3,
) -> Training:
    """Fit both base models, the blend and the stack on stored model rows.

    By default the stack learns from out-of-fold predictions on the fit rows and is
    chosen on the valid rows, which also stop the boosting and set the blend. Then
    both base models are fitted again on fit and valid rows together, with the
    number of rounds found, so the served models have seen every row up to the
    cutoff. In reference mode the test rows judge and nothing is fitted again.
    """
    shared_folder(rows.sparkSession)  # boosting cuts its lineage there
    judge = "test" if reference_mode else "valid"
    marked = assign_roles(rows, holdout_days, reference_mode)
    counts = {r["role"]: r["count"] for r in marked.groupBy("role").count().collect()}
    for role in ("fit", judge, "test"):
        if not counts.get(role):
            raise ValueError(f"no {role} rows: change holdout_days from {holdout_days}")

    # Assembled once and stored; every fit reads these vectors.
    vectors = materialize(models.assemble(marked).select("role", "target", "features"), "vectors")
    seen = vectors.where(F.col("role").isin("fit", judge)).withColumn(
        "is_valid", F.col("role") == judge
    )
    gbt = models.fit_gbt(seen, gbt_params, "is_valid")
    rf = models.fit_rf(vectors.where(F.col("role") == "fit"), rf_params)

    # Scored once and stored; weights, stacking and the choice read this table.
    needed = marked if reference_mode else marked.where(F.col("role") != "fit")
    scored = materialize(Forecaster(gbt, rf).predict(needed).drop("pred_final"), "scored")
    judged = scored.where(F.col("role") == judge)
    weights = {
        r["model"]: r["weight"] for r in blend_weights(judged, "target", models.BASES).collect()
    }
    if reference_mode:
        stacked = scored.where(F.col("role") == "fit")
    else:
        rounds = {**(gbt_params or {}), "maxIter": gbt.getNumTrees}
        fit_rows = marked.where(F.col("role") == "fit").drop("role")
        stacked = materialize(out_of_fold(fit_rows, stack_folds, rounds, rf_params), "stacked")
    candidates = models.fit_meta_candidates(stacked)
    scores = models.meta_scores(judged, candidates)
    name = models.select_meta(scores).first()["name"]
    if not reference_mode:
        known = vectors.where(F.col("role") != "test")
        gbt, rf = models.fit_gbt(known, rounds), models.fit_rf(known, rf_params)
        test = marked.where(F.col("role") == "test")
        scored = materialize(Forecaster(gbt, rf).predict(test).drop("pred_final"), "scored")
    forecaster = Forecaster(gbt, rf, candidates[name], weights)
    return Training(forecaster, scored, scores, name, stacked, judged)
