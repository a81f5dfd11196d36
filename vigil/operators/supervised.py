"""Supervised and forecast models on flattened windows, with MLlib."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.5


def flatten(windows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Window rows, day by day, as one vector; a missing cell is zero."""
    cells = F.flatten(
        F.transform(
            F.array_sort("window"),
            lambda row: F.array(*[F.coalesce(row[c].cast("double"), F.lit(0.0)) for c in columns]),
        )
    )
    return windows.withColumn("features", array_to_vector(cells)).drop("window")


def with_weight(train: DataFrame, label: str = "label") -> DataFrame:
    """`weight`: negatives per positive on positive rows, 1 on the others."""
    ratio = train.agg(
        F.try_divide(F.count_if(F.col(label) == 0), F.count_if(F.col(label) == 1))
    ).scalar()
    return train.withColumn(
        "weight", F.when(F.col(label) == 1, F.coalesce(ratio, F.lit(1.0))).otherwise(1.0)
    )


def fit_gbt(
    train: DataFrame,
    validation: DataFrame | None = None,
    weighted: bool = False,
    trees: int = 300,
    depth: int = 4,
    step: float = 0.05,
    subsample: float = 0.8,
    columns_share: float = 0.8,
    seed: int = 42,
) -> PipelineModel:
    """Scaler fitted on the training rows, then boosted trees.

    Validation rows, where given, ride along in the scaler's input with their own flag and
    stop the boosting early; the scaler itself is fitted on training rows alone.
    """
    if weighted:
        train = with_weight(train)
    scaler = StandardScaler(inputCol="features", outputCol="scaled", withMean=True, withStd=True)
    scaler_model = scaler.fit(train)
    rows = train.withColumn("is_validation", F.lit(False))
    if validation is not None:
        held = validation.withColumn("is_validation", F.lit(True))
        if weighted:
            held = held.withColumn("weight", F.lit(1.0))
        rows = rows.unionByName(held)
    gbt = GBTClassifier(
        featuresCol="scaled",
        labelCol="label",
        maxIter=trees,
        maxDepth=depth,
        stepSize=step,
        subsamplingRate=subsample,
        featureSubsetStrategy=str(columns_share),
        seed=seed,
    )
    if validation is not None:
        gbt = gbt.setValidationIndicatorCol("is_validation")
    if weighted:
        gbt = gbt.setWeightCol("weight")
    model = gbt.fit(scaler_model.transform(rows))
    return PipelineModel([scaler_model, model])


def score(windows: DataFrame, model: PipelineModel) -> DataFrame:
    """`score`: the probability of the positive class."""
    scored = model.transform(windows)
    kept = [c for c in ("user_key", "end_day", "label", "split") if c in windows.columns]
    return scored.select(*kept, vector_to_array("probability")[1].alias("score"))


def _alerts(scored: DataFrame, detector: str, reason: str, threshold: float) -> DataFrame:
    return scored.where(F.col("score") >= threshold).select(
        F.col("end_day").alias("day"),
        "user_key",
        F.lit(detector).alias("detector"),
        F.lit(reason).alias("reason"),
        "score",
    )


def supervised_alerts(scored: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    return _alerts(scored, "ml", "ml:supervised_s1", threshold)


def forecast_alerts(scored: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    return _alerts(scored, "forecast", "forecast:s1_exfil_7d", threshold)


def save_models(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_models(path: str) -> PipelineModel:
    return PipelineModel.load(path)
