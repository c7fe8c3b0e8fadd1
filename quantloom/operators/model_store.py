"""Trained pipelines in the shared folder, a registry that points to them, and scoring with the active version.

Layout under a root: ``models/<name>/<version>`` (the pipeline as Spark ML saves it) and ``registry/<name>/<version>``, a
one-row table written after the model. A version whose registry row is missing was never finished and is not seen.
Activations are rows of their own, so a roll-back is one more activation.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.operators import memory
from quantloom.session import read_if_there

c = F.col
REGISTRY = "model_name string, model_version bigint, target string, features array<string>, path string, accuracy double, f1_macro double, created_at timestamp"


class ModelStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def save(self, model: PipelineModel, name: str, version: int, target: str, features: list[str], metrics: dict[str, float], created_at) -> None:
        """Persist a fitted pipeline, then its registry row; saving a version again replaces it."""
        path = f"{self.root}/models/{name}/{version}"
        model.write().overwrite().save(path)
        row = (name, version, target, features, path, float(metrics.get("accuracy", 0.0)), float(metrics.get("f1_macro", 0.0)), created_at)
        self.spark.createDataFrame([row], REGISTRY).write.mode("overwrite").parquet(f"{self.root}/registry/{name}/{version}")

    def activate(self, name: str, version: int, at) -> None:
        self.spark.createDataFrame([(name, version, at)], "model_name string, model_version bigint, activated_at timestamp").write.mode("append").parquet(f"{self.root}/activations")

    def versions(self) -> DataFrame:
        """All finished versions with their last activation (null if never)."""
        try:
            rows = self.spark.read.schema(REGISTRY).option("recursiveFileLookup", "true").parquet(f"{self.root}/registry")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            rows = self.spark.createDataFrame([], REGISTRY)
        activations = read_if_there(self.spark, f"{self.root}/activations")
        if activations is None:
            return rows.withColumn("activated_at", F.lit(None).cast("timestamp"))
        last = activations.groupBy("model_name", "model_version").agg(F.max("activated_at").alias("activated_at"))
        return rows.join(last, ["model_name", "model_version"], "left")

    def active(self, name: str) -> tuple[int, PipelineModel] | None:
        """Version and pipeline in force: the last activated one, else the first registered; None if there is none."""
        own = self.versions().where(c("model_name") == name)
        found = memory.active_models(own).first()
        if found is None or found.active is None:
            return None
        path = own.where(c("model_version") == found.active).first().path
        return found.active, PipelineModel.load(path)

    def roll_back(self, name: str, at) -> int | None:
        """Activate the version before the newest one."""
        found = memory.rollback_target(self.versions().where(c("model_name") == name)).first()
        if found is not None:
            self.activate(name, found.previous, at)
        return found and found.previous

    def retrain_if_due(self, name: str, train: Callable[[], tuple[PipelineModel, str, list[str], dict[str, float]]], at, min_accuracy: float = 0.52, max_age_days: int = 14) -> int | None:
        """Train, save and activate a new version where the active one is missing, weak or old at ``at``; its number, or None."""
        found, newest = self.active(name), 0
        if found is not None:
            own = self.versions().where(c("model_name") == name)
            newest = own.agg(F.max("model_version")).first()[0]
            active = own.where(c("model_version") == found[0])
            if not active.select(memory.should_retrain(active, F.lit(at).cast("timestamp"), min_accuracy, max_age_days).alias("due")).first().due:
                return None
        model, target, features, metrics = train()
        self.save(model, name, newest + 1, target, features, metrics, at)
        self.activate(name, newest + 1, at)
        return newest + 1

    def score(self, rows: DataFrame, name: str) -> DataFrame:
        """``rows`` with ``prediction`` (the label) and ``model_version`` of the active model."""
        found = self.active(name)
        if found is None:
            raise ValueError(f"no version of {name} is registered")
        version, model = found
        out = model.transform(rows)
        return out.select(*[c(n) for n in rows.columns], c("predicted").alias("prediction"), F.lit(version).cast("bigint").alias("model_version"))
