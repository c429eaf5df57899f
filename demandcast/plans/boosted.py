"""Search, training and evaluation of the histogram boosters, without targets from later periods."""

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, functions as F

from demandcast.operators import boosting, models, search
from demandcast.operators.evaluate import regression_metrics
from demandcast.operators.split import folds_by_date
from demandcast.plans.train import assign_roles
from demandcast.schema import FEATURES, HOLDOUT_DAYS, MAIN_HORIZON, SERIES
from demandcast.session import materialize

COLUMNS = {"leafwise": "pred_leafwise", "symmetric": "pred_symmetric"}
NAMES = {"LeafWise": "pred_leafwise", "Symmetric": "pred_symmetric", "Blend": "pred_blend"}
KEYS = ("date", *SERIES)
TARGET_DATE = f"target_date_t{MAIN_HORIZON}"


def with_roles(rows: DataFrame, holdout_days: int = HOLDOUT_DAYS) -> DataFrame:
    """Rows with `role` fit, valid or test, but for fit and valid rows whose target was sold in a later role's days.

    A row just before a border has a target beyond it: a model that learns it, or stops
    by it, has seen days that it is judged on.
    """
    last = rows.agg(F.max("date")).scalar()
    ends = F.when(F.col("role") == "fit", F.date_sub(last, 2 * holdout_days)).when(F.col("role") == "valid", F.date_sub(last, holdout_days))
    return assign_roles(rows, holdout_days).where(ends.isNull() | (F.col(TARGET_DATE) <= ends))


def with_folds(rows: DataFrame, folds: int) -> DataFrame:
    """Rows with `fold` by date, but for those whose target was sold after their fold's last day."""
    folded = folds_by_date(rows, folds)
    ends = folded.groupBy("fold").agg(F.max("date").alias("_end"))
    # One row for each fold.
    return folded.join(F.broadcast(ends), "fold").where(F.col(TARGET_DATE) <= F.col("_end")).drop("_end")


def binned(rows: DataFrame, keep: tuple[str, ...], learn=None) -> tuple[DataFrame, list]:
    """The stored bins of model rows, and their borders, taken from the rows where `learn` holds."""
    vectors = materialize(models.assemble(rows).select("target", "features", *keep), "vectors")
    values = vectors.where(learn) if learn is not None else vectors
    parts = boosting.vector_to_array("features")
    names = [f"f{k}" for k in range(len(FEATURES))]
    borders = boosting.feature_borders(values.select(parts.alias("v")).select(*[F.col("v")[k].alias(n) for k, n in enumerate(names)]), names)
    return materialize(boosting.bin_rows(vectors, borders, keep), "binned"), borders


def search_boosted(rows: DataFrame, table: str, trials: int, folds: int, holdout_days: int = HOLDOUT_DAYS, fixed: dict | None = None) -> DataFrame:
    """search.search() on the rows before the holdout, cut into folds by date; trials are stored in `table`."""
    known = with_roles(rows, holdout_days).where("role <> 'test'").drop("role")
    packed, borders = binned(with_folds(known, folds), ("fold",))
    return search.search(packed, borders, table, trials, fixed=fixed)


@dataclass
class BoostedTraining:
    """Served models by family, the error curves that chose their rounds, and scored test rows."""

    models: dict
    judged: dict
    weights: dict
    scored: DataFrame

    def curve(self, spark) -> DataFrame:
        """(family, round, mae, served): the judging error after each round trained."""
        rows = [(f, k + 1, e, k < m.rounds) for f, m in self.judged.items() for k, e in enumerate(m.curve)]
        return spark.createDataFrame(rows, "family string, round int, mae double, served boolean")

    def metrics(self) -> DataFrame:
        return regression_metrics(self.scored, "true", NAMES)

    def nodes(self, spark) -> DataFrame:
        kinds = "family string, tree int, node int, feature string, threshold double, left int, right int, value double, gain double"
        return spark.createDataFrame([(f, *n) for f, m in self.models.items() for n in m.nodes()], kinds)


def train_boosted(rows: DataFrame, holdout_days: int = HOLDOUT_DAYS, settings: dict | None = None) -> BoostedTraining:
    """Fit both families with patience on the valid rows, then again on fit and valid rows with the rounds found.

    Test rows are scored by the second fits and weighed into a blend by the first fits' inverse errors.
    """
    spark = rows.sparkSession
    specs = {"leafwise": boosting.LeafWise(), "symmetric": boosting.Symmetric(), **(settings or {})}
    marked = materialize(with_roles(rows, holdout_days), "roles")
    roles = {r["role"] for r in marked.select("role").distinct().collect()}
    if roles != {"fit", "valid", "test"}:
        raise ValueError(f"rows of {sorted(roles)} alone: change holdout_days from {holdout_days}")
    packed, borders = binned(marked.where("role <> 'test'"), ("role",), F.col("role") == "fit")
    folds = packed.withColumn("fold", (F.col("role") == "valid").cast("int"))
    columns = [COLUMNS[f] for f in specs]
    judged = dict(zip(specs, boosting.fit_many(folds, [boosting.Job(s) for s in specs.values()], borders, columns), strict=True))
    again = [boosting.Job(replace(s, rounds=judged[f].rounds, patience=0)) for f, s in specs.items()]
    served = dict(zip(specs, boosting.fit_many(packed.withColumn("fold", F.lit(0)), again, borders, columns), strict=True))
    inverse = {f: 1 / max(min(m.curve), 1e-12) for f, m in judged.items()}
    weights = {f: v / sum(inverse.values()) for f, v in inverse.items()}
    scored = models.assemble(marked.where("role = 'test'"))
    for model in served.values():
        scored = model.transform(scored)
    blend = sum(F.col(COLUMNS[f]) * w for f, w in weights.items())
    scored = scored.select(*KEYS, F.col("target").alias("true"), *columns, blend.alias("pred_blend"))
    return BoostedTraining(served, judged, weights, materialize(scored, "scored"))
