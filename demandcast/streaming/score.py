"""Uploaded scoring files, each scored once as it lands in a folder."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from demandcast.plans.score import batch_score
from demandcast.plans.train import Forecaster


def score_uploads(
    spark: SparkSession, folder: str, schema: StructType, forecaster: Forecaster
) -> DataFrame:
    """A stream of scored rows. Scoring keeps no state, so restarts are safe."""
    uploads = spark.readStream.schema(schema).csv(folder, header=True, enforceSchema=False)
    return batch_score(uploads, forecaster)


def write_scores(scored: DataFrame, folder: str, checkpoint: str):
    """Score all files now waiting, then stop."""
    return (
        scored.writeStream.format("csv")
        .option("header", True)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(folder)
    )
