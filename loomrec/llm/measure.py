"""Recall of the neighbour graph and of greedy search: python -m loomrec.llm.measure FOLDER [--drawn N] [--isotropic N] [--search].

For the factor tables of FOLDER, for N vectors drawn with the mean and covariance of its user vectors, or for N isotropic ones.
Prints the run's own estimate after every step and the recall at 10 of the ids divisible by 20 against all vectors.
"""

from __future__ import annotations

import argparse
import os
import time

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from loomrec.llm import queries
from loomrec.llm.nn_graph import exact_neighbours, neighbour_graphs, recall_of
from loomrec.scratch import stow


def drawn(spark: SparkSession, n: int, mean: np.ndarray, spread: np.ndarray) -> DataFrame:
    """``n`` Gaussian vectors; the tasks draw them, seeded by their first id."""

    def draw(batches):
        for batch in batches:
            ids = batch.column("id").to_numpy()
            x = np.random.default_rng([17, int(ids[0])]).standard_normal((len(ids), len(mean))) @ spread + mean
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(list(x), pa.list_(pa.float64()))], names=["id", "v"])

    return stow(spark.range(1, n + 1).mapInArrow(draw, "id long, v array<double>"))


def main() -> None:
    parser = argparse.ArgumentParser()
    parser.add_argument("folder")
    parser.add_argument("--drawn", type=int)
    parser.add_argument("--isotropic", type=int)
    parser.add_argument("--search", action="store_true")
    args = parser.parse_args()
    os.environ.setdefault("OMP_NUM_THREADS", "1")
    spark = SparkSession.builder.master("local[*]").config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    tables = queries._factor_tables(spark, args.folder)
    if args.drawn or args.isotropic:
        rows = tables["user"].limit(20_000).toPandas()["v"]
        x = np.stack(rows.to_list())
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        spread = np.linalg.cholesky(np.cov(x.T)).T if args.drawn else np.eye(x.shape[1])
        mean = x.mean(axis=0) if args.drawn else np.zeros(x.shape[1])
        tables = {"drawn" if args.drawn else "isotropic": drawn(spark, args.drawn or args.isotropic, mean, spread)}
    truth = stow(exact_neighbours(tables, 10, queries._every_20th))
    log, began = [], time.time()
    graph = stow(neighbour_graphs(tables, 10, log=log))
    print(f"graph: {time.time() - began:.0f} s")
    for step in log:
        print(step)
    for row in recall_of(graph, truth).collect():
        print("graph ", row.asDict())
    if args.search:
        began = time.time()
        for row in recall_of(queries._searched(tables), truth).collect():
            print("search", row.asDict(), f"{time.time() - began:.0f} s")


if __name__ == "__main__":
    main()
