"""Sessions, table access and the shared folder for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession


def local_session(cpus: int | str = 8, partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("silverfold")
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """One table of a directory; ``timestamp_ntz`` columns stay as they are."""
    return spark.read.parquet(f"{directory}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    A local temporary folder is made only where that setting is absent *and* the
    master is local, so nothing machine-local is ever used on a cluster.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    made = tempfile.mkdtemp(prefix="silverfold-")
    spark.conf.set("spark.checkpoint.dir", f"file://{made}")
    spark.sparkContext.setCheckpointDir(made)
    return f"file://{made}"


class Stages:
    """Written tables that cut the lineage of an iterative job.

    Each ``save`` writes parquet into the shared folder and reads it back, so a lost
    executor costs a task and not the iteration, and the next plan sees true sizes.
    ``drop`` frees a table that no later step reads, and ``keep`` all but those named, at the end of a job;
    ``drop_results`` frees the rest once the result has been used.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self._n = 0
        self._live: dict[str, DataFrame] = {}

    def save(self, df: DataFrame, **measures: Column) -> DataFrame:
        """Writes ``df``; ``measures`` are aggregates of its rows, taken while they are written, as ``.seen``."""
        self._n += 1
        path = f"{self.root}/{self._n}"
        noted = Observation() if measures else None
        (df.observe(noted, *(c.alias(n) for n, c in measures.items())) if noted else df).write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._silverfold_path = path  # type: ignore[attr-defined]
        out.seen = noted.get if noted else {}  # type: ignore[attr-defined]
        self._live[path] = out
        return out

    def drop(self, *dfs: DataFrame | None) -> None:
        for df in dfs:
            path = getattr(df, "_silverfold_path", None)
            if path and self._live.pop(path, None) is not None:
                _delete(self.spark, path)

    def keep(self, *dfs: DataFrame) -> None:
        """Frees all tables of this job but ``dfs``, which its result still reads."""
        kept = {getattr(df, "_silverfold_path", None) for df in dfs}
        self.drop(*(df for path, df in list(self._live.items()) if path not in kept))


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def drop_results(df: DataFrame) -> None:
    """Frees the written tables a result reads, once it has been stored or is no longer needed."""
    folder = shared_folder(df.sparkSession).rstrip("/").split(":", 1)[-1].lstrip("/")
    jobs = set()
    for file in df.inputFiles():
        at = file.split(":", 1)[-1].lstrip("/")
        if at.startswith(f"{folder}/"):
            jobs.add(at[len(folder) + 1 :].split("/", 1)[0])
    for job in jobs:
        _delete(df.sparkSession, f"{shared_folder(df.sparkSession).rstrip('/')}/{job}")


def plain(pdf: pd.DataFrame) -> pd.DataFrame:
    """Text columns as objects: concatenated Arrow-backed ones are chunked, which Spark doesn't take."""
    texts = {c: object for c in pdf.columns if isinstance(pdf[c].dtype, pd.StringDtype)}
    return pdf.astype(texts) if texts else pdf
