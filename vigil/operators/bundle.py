"""All fitted models as one saved MLlib pipeline: forest, boosted trees and the boost by deviations."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.base import Transformer
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.sql import SparkSession

from vigil.operators import anomaly
from vigil.operators.forest import Forest, average_path


def forest_stages(forest: Forest, spark: SparkSession) -> list[Transformer]:
    """Window features to `base_score_raw` and `base_score`; other columns stay.

    Scaling and the score are SQL of the stage itself, the walk is MLlib's tree model, so the
    saved pipeline needs nothing of this library to be read and run.
    """
    cells = [f"__x{i}" for i in range(len(forest.columns))]
    scale = ", ".join(
        f"(`{c}` - {m!r}D) / {s!r}D AS {cell}" for c, m, s, cell in zip(forest.columns, forest.means, forest.stds, cells)
    )
    low, high = forest.score_range
    raw = f"pow(2D, -__path / {average_path(forest.psi) or 1.0!r}D) - 0.5D"
    helpers = ", ".join([*cells, "__x", "__path"])
    return [
        SQLTransformer(statement=f"SELECT *, {scale} FROM __THIS__"),
        VectorAssembler(inputCols=cells, outputCol="__x", handleInvalid="keep"),
        forest.model(spark),
        SQLTransformer(
            statement=f"SELECT * EXCEPT ({helpers}), {raw} AS base_score_raw, "
            f"({raw} - ({low!r}D)) / {(high - low) or 1.0!r}D AS base_score FROM __THIS__"
        ),
    ]


def boost_stages() -> list[Transformer]:
    """`base_score` and `z_max` to the boosted `score`; windows that give no alert go."""
    cases = " ".join(f"WHEN z_max >= {bound!r}D THEN {value!r}D" for bound, value in anomaly.BOOSTS)
    boost = f"CASE {cases} WHEN z_max < {anomaly.DAMP_BELOW!r}D THEN {anomaly.DAMP!r}D ELSE 0D END"
    quiet = f"base_score < {anomaly.GATE_SCORE!r}D AND (z_max IS NULL OR z_max < {anomaly.GATE_Z!r}D)"
    score = f"greatest(0D, least({anomaly.CAP!r}D, base_score * (1D + boost_pct)))"
    return [
        SQLTransformer(statement=f"SELECT *, {boost} AS boost_pct FROM __THIS__ WHERE NOT coalesce({quiet}, false)"),
        SQLTransformer(statement=f"SELECT *, {score} AS score FROM __THIS__ WHERE {score} >= {anomaly.FLOOR!r}D"),
    ]


def pipeline(*stages: Transformer) -> PipelineModel:
    """The stages as one model; fitted pipelines among them are taken apart."""
    flat: list[Transformer] = []
    for stage in stages:
        flat += stage.stages if isinstance(stage, PipelineModel) else [stage]
    return PipelineModel(flat)
