"""Append-only stores: what a run appends is there once, however often the run is tried.

Rows are first staged in a folder of their own below ``data``, which no reader looks at.
Then one row in ``runs`` names the run and its folder.  Readers take, for each run, the
folder that was named first; staged folders that nobody named, left by failed runs, and
later tries of a run are never read.  Nothing is renamed, so any store that Spark writes
to will do.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from tallyrank.operators.scoring import latest_entries

RUNS = "run_id string, folder string, named_us bigint"


@dataclass(frozen=True)
class Store:
    """A store of rows with the columns of ``schema`` below ``path``."""

    spark: SparkSession
    path: str
    schema: str

    def stage(self, rows: DataFrame) -> str:
        """Write rows where no reader looks yet; the folder's name."""
        declared = StructType.fromDDL(self.schema)
        folder = uuid.uuid4().hex
        columns = [F.col(f.name).cast(f.dataType).alias(f.name) for f in declared]
        rows.select(*columns).write.mode("errorifexists").parquet(f"{self.path}/data/folder={folder}")
        return folder

    def name(self, run_id: str, folder: str) -> None:
        """Make a staged folder the rows of a run, unless the run has some already."""
        row = [(run_id, folder, time.time_ns() // 1_000)]
        self.spark.createDataFrame(row, RUNS).coalesce(1).write.mode("append").parquet(f"{self.path}/runs")

    def append(self, rows: DataFrame, run_id: str) -> None:
        """Append the rows of a run; a run that is tried again adds nothing."""
        if not self.runs().filter(F.col("run_id") == run_id).limit(1).count():
            self.name(run_id, self.stage(rows))

    def _exists(self, part: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{part}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def runs(self) -> DataFrame:
        """(run_id, folder, named_us): the folder that counts for each run."""
        if not self._exists("runs"):
            return self.spark.createDataFrame([], RUNS)
        named = self.spark.read.schema(RUNS).parquet(f"{self.path}/runs")
        return latest_entries(named.withColumn("first", -F.col("named_us")), "run_id", ["first", "folder"]).select(
            "run_id", "folder", "named_us")

    def read(self) -> DataFrame:
        """All rows of all runs, each once, with ``run_id``."""
        if not self._exists("data"):
            return self.spark.createDataFrame([], self.schema).withColumn("run_id", F.lit(None).cast("string"))
        rows = self.spark.read.schema(f"{self.schema}, folder string").parquet(f"{self.path}/data")
        # One row a run: prunes the folders of the scan.
        return rows.join(self.runs().select("folder", "run_id"), "folder").drop("folder")


RECOMMENDATION_LOG = (
    "request_id bigint, user_id bigint, query string, recommended_products array<bigint>, scores array<double>, "
    "metadata map<string,string>, logged_at timestamp"
)
INTERACTIONS = "event_id bigint, user_id bigint, product_id bigint, kind string"
MODELS = (
    "model string, kind string, version bigint, trained_at timestamp, dataset_size bigint, train_seconds double, "
    "metrics map<string,double>, settings map<string,string>, features array<string>"
)


def model_entries(metrics: DataFrame, kinds: Mapping[str, str], dataset_size: int, features: list[str], *,
                  settings: Mapping[str, object] | None = None, train_seconds: float | None = None) -> DataFrame:
    """One registry row per model of ``metrics`` (model and one number column per metric), but for its version."""
    names = [c for c in metrics.columns if c != "model"]
    pairs = [x for n in names for x in (F.lit(n), F.col(n).cast("double"))]
    kind = F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv])
    held = [F.lit(x) for k, v in (settings or {}).items() for x in (k, json.dumps(v))]
    return metrics.select(
        "model", F.try_element_at(kind, F.col("model")).alias("kind"), F.current_timestamp().alias("trained_at"),
        F.lit(dataset_size).cast("bigint").alias("dataset_size"), F.lit(train_seconds).cast("double").alias("train_seconds"),
        F.create_map(*pairs).alias("metrics"),
        (F.create_map(*held) if held else F.create_map().cast("map<string,string>")).alias("settings"),
        F.array(*[F.lit(f) for f in features]).alias("features"),
    )


@dataclass(frozen=True)
class ModelRegistry:
    """Metadata of every fit that was registered, and the newest version of each model."""

    store: Store

    @classmethod
    def at(cls, spark: SparkSession, path: str) -> ModelRegistry:
        return cls(Store(spark, path, MODELS))

    def register(self, entries: DataFrame, run_id: str) -> None:
        """Append the rows of ``model_entries`` under the next version of each model; once per run."""
        known = self.store.read().groupBy("model").agg(F.max("version").alias("last"))
        numbered = entries.join(known, "model", "left")
        self.store.append(numbered.withColumn("version", F.coalesce("last", F.lit(0)) + 1).drop("last"), run_id)

    def latest(self) -> DataFrame:
        """The newest row of every model, and how many there are."""
        rows = self.store.read().drop("run_id")
        # Maps can't be ordered, so the rest travels as one value picked by the version.
        rest = F.struct(*[c for c in rows.columns if c != "model"])
        newest = rows.groupBy("model").agg(F.max_by(rest, "version").alias("e"), F.count("*").alias("entries"))
        return newest.select("model", "entries", "e.*")
