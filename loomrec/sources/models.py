"""Saving and loading fitted models: one Parquet table per state table and a JSON description, on any Hadoop file system."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

FORMAT = "loomrec-model-1"


class _Folder:
    """Paths of one file system; the cluster's default one unless the path names another."""

    def __init__(self, spark: SparkSession, path: str):
        self.path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def exists(self, path: str) -> bool:
        return self.fs.exists(self.path(path))

    def move(self, old: str, new: str) -> None:
        if not self.fs.rename(self.path(old), self.path(new)):
            raise OSError(f"{old} can't be renamed to {new}")

    def remove(self, path: str) -> None:
        self.fs.delete(self.path(path), True)

    def write(self, path: str, text: str) -> None:
        out = self.fs.create(self.path(path), True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()


def save_model(model, path: str) -> None:
    """Write ``model`` to the folder ``path``: all into a new folder beside it first, which then replaces an earlier model.

    Raises ``ValueError`` if ``path`` holds something other than a model.
    """
    spark = SparkSession.active()
    folder, path = _Folder(spark, path), path.rstrip("/")
    if folder.exists(path) and not folder.exists(f"{path}/metadata.json"):
        raise ValueError(f"{path} exists and is no saved model")
    fresh, old = f"{path}.{uuid.uuid4().hex}.tmp", f"{path}.{uuid.uuid4().hex}.old"
    params, state = model.to_state()
    scalars = {k: v for k, v in state.items() if not isinstance(v, DataFrame)}
    tables = [k for k, v in state.items() if isinstance(v, DataFrame)]
    about = {"format": FORMAT, "type": type(model).__name__, "fitted": model.is_fitted, "params": params, "scalars": scalars, "tables": tables}
    try:
        for name in tables:
            state[name].write.parquet(f"{fresh}/{name}.parquet")
        folder.write(f"{fresh}/metadata.json", json.dumps(about, indent=1))
        if folder.exists(path):
            folder.move(path, old)
        folder.move(fresh, path)
        folder.remove(old)
    finally:
        folder.remove(fresh)


def load_model(spark: SparkSession, path: str):
    """The model saved at ``path``.  Raises ``FileNotFoundError`` or, for another format or unknown type, ``ValueError``."""
    from loomrec.plans.base import MODELS

    if not _Folder(spark, path).exists(f"{path}/metadata.json"):
        raise FileNotFoundError(f"{path} holds no saved model")
    about = json.loads(spark.read.text(f"{path}/metadata.json", wholetext=True).first()[0])
    if about.get("format") != FORMAT:
        raise ValueError(f"unknown model format {about.get('format')!r}")
    if about.get("type") not in MODELS:
        raise ValueError(f"unknown model type {about.get('type')!r}")
    state = dict(about["scalars"])
    for name in about["tables"]:
        state[name] = spark.read.parquet(f"{path}/{name}.parquet")
    return MODELS[about["type"]].from_state(about["params"], state, about["fitted"])
