"""What the corpus operators share: shared-folder tables, connected components and Arrow helpers."""

from __future__ import annotations

import gc
import time
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..folder import new_folder, shared_root

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: ASCII white space, as a regular expression class body.
SPACE = r"\x20\x09-\x0D"


def ascii_lower(column):
    """Lower-cases A-Z only; other letters stay as they are."""
    return F.translate(column, UPPER, LOWER)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: Paths of the tables that stored() wrote, for those who know when they are done with.
written: list[str] = []


#: Seconds between two collections of the driver's garbage, and when the last one was.
TIDY_S = 2
_tidied = [time.monotonic()]


def tidy(spark: SparkSession) -> None:
    """Collects the driver's garbage if TIDY_S have passed since the last time.

    Only then does Spark give up the shuffles, broadcasts and checkpoints of steps that are over. In work of many steps what they
    leave in the driver grows with their tasks, and its heap with it to the largest size allowed.
    """
    if time.monotonic() - _tidied[0] >= TIDY_S:
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        _tidied[0] = time.monotonic()


def checkpointed(frame: DataFrame) -> DataFrame:
    """A small result, written to the shared folder; later stages read it back from there."""
    shared_root(frame.sparkSession)
    out = frame.checkpoint(eager=True)
    tidy(frame.sparkSession)
    return out


def stored(frame: DataFrame, name: str) -> DataFrame:
    """A larger intermediate result, written as a Parquet table in the shared folder, so that later readers prune columns
    and a lost executor costs nothing that was computed before."""
    spark = frame.sparkSession
    path = new_folder(spark, name)
    frame.write.option("compression", "zstd").parquet(path)
    written.append(path)
    tidy(spark)
    return spark.read.schema(frame.schema).parquet(path)


def remove(spark: SparkSession, paths: list[str]) -> None:
    """Deletes tables in the shared folder."""
    conf, path = spark.sparkContext._jsc.hadoopConfiguration(), spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for p in paths:
        path(p).getFileSystem(conf).delete(path(p), True)


def rereadable(frame: DataFrame) -> bool:
    """Whether `frame` is a table as it is stored, so that every reading gives its rows in the same order."""
    plan = frame._jdf.queryExecution().optimizedPlan()
    while plan.nodeName() == "Project":
        plan = plan.children().head()
    return plan.nodeName() in ("LogicalRelation", "LocalRelation")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected `edges` (src, dst: bigint).

    Returns (node, root), root being the smallest node of the component, for every node that has an edge. Each round
    takes the least label among the neighbours (combined before the shuffle) and then jumps to the label's own label;
    labels stay distributed and each round is cut by a checkpoint. `edges` is evaluated once, so that both directions come from the
    same edges even where another evaluation would choose others, such as stars around the row that came first.
    """
    ways = F.array(F.struct(F.col("src").alias("src"), F.col("dst").alias("dst")), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))
    both = checkpointed(edges.where("src <> dst").select(F.explode(ways).alias("way")).select("way.*").distinct())
    labels = checkpointed(both.groupBy(F.col("src").alias("node")).agg(F.least(F.col("node"), F.min("dst")).alias("root")))
    while True:
        heard = both.join(labels, both.src == labels.node).groupBy(F.col("dst").alias("node")).agg(F.min("root").alias("heard"))
        nearer = labels.join(heard, "node").select("node", "root", F.least("root", "heard").alias("near"))
        nearer = checkpointed(nearer)
        above = nearer.select(F.col("node").alias("near"), F.col("near").alias("far"))
        moved = checkpointed(
            nearer.join(above, "near", "left").select("node", F.least("near", F.coalesce("far", "near")).alias("new"), "root")
        )
        if moved.where("new <> root").limit(1).count() == 0:
            return moved.select("node", F.col("new").alias("root"))
        labels = moved.select("node", F.col("new").alias("root"))


def least_labels(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The smallest member of each member's component."""
    label = np.arange(n)
    while True:
        before = label.copy()
        np.minimum.at(label, x, label[y])
        np.minimum.at(label, y, label[x])
        label = label[label]
        if (label == before).all():
            return label


def whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Of a partition sorted by `key`, pieces that hold whole groups of equal keys."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        cut = int(np.searchsorted(keys, keys[-1], "left"))
        if held and cut == 0 and held[-1].column(key)[-1].as_py() == keys[-1]:
            held.append(batch)
            continue
        if held or cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
        held = [batch.slice(cut)]
    if held:
        yield pa.Table.from_batches(held)


def utf8(column: pa.Array) -> list[bytes]:
    """The values as UTF-8 bytes; null becomes empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def pieces(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches, cut small, so that what is made of texts is never held for a whole batch of them."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
