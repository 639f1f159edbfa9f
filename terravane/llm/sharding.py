"""Sharding by sampled splitters.

The key of a record is (hash of its text, doc_id, place of the row in the table), so equal texts lie side by side. Rows are drawn
with a chance in proportion to their size; quantiles of the drawn hashes are the splitters of many more ranges than shards.
Ranges that turn out overfull (a text that a third of all rows repeat) are subdivided by doc_id, and by row where that repeats
too, with splitters from further draws until none is left that can be. Whole ranges then go to shards, the largest first, each to
the shard with the fewest bytes. The law is `bytes`: shards have nearly equal sizes, and equal texts share a shard unless they
fill more than a tenth of one.

The slot of a record is its range's offset in the shard plus its place in the range: no task ever numbers a whole shard. The
driver holds, as arrays, DRAWN keys and one count for each range: 77 MB at 100 TB.

Defined cases: null text counts as empty (size 1); a null doc_id sorts first; very long texts are placed whole; rows that repeat
or tie are each placed, and divided like others; no rows give no rows; columns named shard or slot are replaced, others of any
name are carried. A frame that is no stored table is stored first, since the places of rows must not change between readings.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .shared import read, rereadable, stored

#: Ranges for each shard at least, bytes for a range at most, drawn rows for a range.
RANGES, RANGE_BYTES, DRAWN = 64, 1 << 30, 24
#: Equal texts stay together while they fill at most this part of a shard.
WHOLE = 0.1
LEAST = -(1 << 63)


def keyed(docs: DataFrame, keep) -> DataFrame:
    """`keep` (columns of `docs`) with the size and the key (_h, _d, _t) of each row."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(*keep, (F.octet_length(text) + 1).cast("bigint").alias("_size"), F.xxhash64(text).alias("_h"), F.coalesce("doc_id", F.lit(LEAST)).cast("bigint").alias("_d"), F.monotonically_increasing_id().alias("_t"))


def locate(splits: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """The number of splitters (rows in order) at or below each key."""
    first = np.ascontiguousarray(splits[:, 0])
    left, out = np.searchsorted(first, keys[0], "left"), np.searchsorted(first, keys[0], "right")
    if len(keys) > 1:
        for value in np.unique(keys[0][left < out]):
            at = np.flatnonzero(keys[0] == value)
            i, j = left[at[0]], out[at[0]]
            out[at] = i + locate(splits[i:j, 1:], *(k[at] for k in keys[1:]))
    return out


def with_range(rows: DataFrame, splits: np.ndarray, place: np.ndarray | None = None) -> DataFrame:
    """Adds _range and, from `place` (shard, offset by range), _shard and _base. The splitters are bounded by the ranges."""
    names = ["_range", *(["_shard", "_base"] if place is not None else [])]
    schema = StructType([*rows.schema.fields, *(StructField(name, LongType(), False) for name in names)])

    def scan(batches):
        for batch in batches:
            at = locate(splits, *(batch.column(c).to_numpy() for c in ("_h", "_d", "_t")))
            more = [at, *(place[at].T if place is not None else ())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(np.ascontiguousarray(x, np.int64)) for x in more)], names=[*batch.schema.names, *names])

    return rows.mapInArrow(scan, schema)


def draw(rows: DataFrame, total: int, count: int, by_row: bool, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """About `count` keys (h, and doc and row or the least ones) in order, with weights, each row with a chance in proportion to its size."""
    step = max(1.0, total / count)
    chance = F.shiftrightunsigned(F.xxhash64("_h", "_d", "_t", F.lit(seed)), 11) / F.lit(float(1 << 53))
    more = [F.col(c) if by_row else F.lit(LEAST).alias(c) for c in ("_d", "_t")]
    kept = rows.where(chance < F.col("_size") / F.lit(step)).select("_h", *more, F.greatest(F.col("_size").cast("double"), F.lit(step)).alias("w"))
    found = kept.groupBy("_h", "_d", "_t").agg(F.sum("w").alias("w")).toArrow()  # about `count` rows at most
    keys = np.stack([found.column(c).to_numpy() for c in ("_h", "_d", "_t")], axis=1) if found.num_rows else np.zeros((0, 3), np.int64)
    order = np.lexsort(keys.T[::-1])
    return keys[order], found.column("w").to_numpy()[order]


def quantiles(keys: np.ndarray, weights: np.ndarray, pieces: int, whole: float = float("inf")) -> np.ndarray:
    """Keys that cut what is drawn into pieces of equal weight, moved to the start of their text (or document) unless it weighs over `whole`."""
    if not len(keys) or pieces < 2:
        return np.zeros((0, 3), np.int64)
    at = np.cumsum(weights)
    cut = np.minimum(np.searchsorted(at, np.arange(1, pieces) * at[-1] / pieces, "right"), len(keys) - 1)
    found = keys[cut].copy()
    for depth in (2, 1):  # rows of a document, then documents of a text
        fresh = np.r_[True, (keys[1:, :depth] != keys[:-1, :depth]).any(axis=1)]
        group = np.cumsum(fresh) - 1
        found[np.bincount(group, weights=weights)[group][cut] <= whole, depth:] = LEAST
    return np.unique(found, axis=0)


def plan_shards(rows: DataFrame, n_shards: int = 16, seed: int = 17) -> tuple[np.ndarray, np.ndarray]:
    """Splitters and, for each range, (shard, offset). rows: _size, _h, _d, _t."""
    total = rows.agg(F.coalesce(F.sum("_size"), F.lit(0))).first()[0]
    if not total:
        return np.zeros((0, 3), np.int64), np.zeros((1, 2), np.int64)
    ranges = max(RANGES * n_shards, -(-total // RANGE_BYTES))
    full = total / ranges
    splits = quantiles(*draw(rows, total, DRAWN * ranges, False, seed), ranges)
    while True:
        placed = with_range(rows.select("_size", "_h", "_d", "_t"), splits)
        counted = placed.groupBy("_range").agg(F.sum("_size").alias("b"), F.count("*").alias("n")).toArrow()  # one row a range
        size, n = np.zeros(len(splits) + 1), np.zeros(len(splits) + 1, np.int64)
        size[counted.column("_range").to_numpy()], n[counted.column("_range").to_numpy()] = counted.column("b").to_numpy(), counted.column("n").to_numpy()
        over = np.flatnonzero((size > 2 * full) & (n > 1))
        if not len(over):
            break
        seed += 1
        big = placed.where(F.col("_range").isin(over.tolist())) if len(over) < 1000 else placed
        keys, weights = draw(big, int(size[over].sum()), int(DRAWN * 2 * size[over].sum() / full) + 1, True, seed)
        where = locate(splits, *keys.T)  # in order, as the keys are
        more = [quantiles(keys[a:b], weights[a:b], int(np.ceil(size[k] / full)), WHOLE * total / n_shards) for k, a, b in zip(over, np.searchsorted(where, over, "left"), np.searchsorted(where, over, "right"))]
        wider = np.unique(np.concatenate([splits, *more]), axis=0)
        if len(wider) == len(splits):  # what is left are equal texts that stay together
            break
        splits = wider
    load, shard_of, rows_in = [(0.0, i) for i in range(n_shards)], np.zeros(len(size), np.int64), [0] * n_shards
    for k in np.lexsort((np.arange(len(size)), -size)).tolist():
        held, shard_of[k] = load[0]
        heapq.heapreplace(load, (held + size[k], int(shard_of[k])))
    place = np.zeros((len(size), 2), np.int64)
    for k, shard in enumerate(shard_of.tolist()):
        place[k] = shard, rows_in[shard]
        rows_in[shard] += int(n[k])
    return splits, place


def placed(rows: DataFrame, keys: DataFrame, n_shards: int = 16) -> DataFrame:
    """Keyed `rows` with shard and slot, planned over `keys` (the same keys, stored): dealt out by range, sorted in it."""
    splits, place = plan_shards(keys.select("_size", "_h", "_d", "_t"), n_shards)
    order = Window.partitionBy("_range").orderBy("_h", "_d", "_t")
    return with_range(rows, splits, place).withColumn("shard", F.col("_shard").cast("int")).withColumn("slot", F.col("_base") + F.row_number().over(order) - 1)


def sharded(docs: DataFrame, n_shards: int = 16) -> DataFrame:
    """`docs` with shard and slot; columns of these names are replaced."""
    docs = docs if rereadable(docs) else stored(docs, "shard-docs")
    row = F.struct(*(c for c in docs.columns if c.lower() not in ("shard", "slot"))).alias("row")
    return placed(keyed(docs, [row]), stored(keyed(docs, []), "shard-keys"), n_shards).select("row.*", "shard", "slot")


def write_shards(docs: DataFrame, path: str, n_shards: int = 16) -> None:
    """Writes the records by shard, in slot order within each file."""
    sharded(docs, n_shards).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each document: its size, checksum, shard and slot."""
    docs = read(spark, sf_dir, "documents")
    rows = stored(keyed(docs, ["doc_id", F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32")]), "shard-keys")
    return placed(rows, rows).select("doc_id", F.col("_size").alias("size"), "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
