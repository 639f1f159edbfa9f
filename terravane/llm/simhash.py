"""SimHash near-dedup with anchor-point covering.

A document's fingerprint is the majority of the bits of XXH64 (seed 42) over its word shingles. Documents whose
fingerprints differ in at most three bits are linked.

Covering: 62 of the 64 bits form two parts of 31. Of two fingerprints that differ in at most three bits, one part differs in
at most one. In each part the anchors are the words of the perfect Hamming (31, 26) code, whose covering radius is 1: each
fingerprint has one home anchor within distance 1 and is replicated to every anchor within radius plus threshold, 1 + 1
(16 anchors, or one for a code word). So a linked pair meets at the home anchor of either; there, homes are compared with
all that came, exactly, over all 64 bits. There are 2^27 anchors, so the cost follows the number of fingerprints.

Only distinct fingerprints take part: copies collapse into one row before anything is replicated. An anchor returns a star
for each local component, not its pairs; components of the stars are found by rounds of distributed label passing.

Defined cases: no words (null, empty, blank text) give the fingerprint zero, linked like any other; very long texts count whole;
rows that repeat, or tie on a doc_id, are returned each; a null doc_id is no candidate for the component's smallest id; no rows
give no rows; columns other than doc_id and text are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from xxhash import xxh64_intdigest

from .shared import checkpointed, components, least_labels, pieces, read, stored, utf8, whole_groups

SEED, BITS = 42, 3
PART = (1 << 31) - 1


def fingerprint(text: bytes, width: int = 3) -> int:
    words = text.lower().split()
    if not words:
        return 0
    if len(words) < width:
        return xxh64_intdigest(b" ".join(words), SEED)
    hashes = np.fromiter((xxh64_intdigest(b" ".join(x), SEED) for x in zip(*(words[i:] for i in range(width)))), np.uint64, len(words) - width + 1)
    count = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * count > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long."""

    def scan(batches):
        for batch in pieces(batches):
            found = np.array([fingerprint(x, width) for x in utf8(batch.column("text"))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found)], names=["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(scan, "doc_id bigint, fp bigint")


def _syndrome(part: np.ndarray) -> np.ndarray:
    """The exclusive or of the one-based places of the bits that are set."""
    out = np.zeros(len(part), np.uint64)
    for bit in range(31):
        out ^= np.where((part >> np.uint64(bit)) & np.uint64(1), np.uint64(bit + 1), np.uint64(0))
    return out


def anchors(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of the fingerprint, anchor, whether the anchor is its home) for every replica. fp: unsigned."""
    one, out = np.uint64(1), []
    bit = lambda place: np.where(place == 0, np.uint64(0), one << ((place - one) & np.uint64(63)))
    for k in (0, 1):
        part = (fp >> np.uint64(31 * k)) & np.uint64(PART)
        s = _syndrome(part)
        tag, at = np.uint64(k << 31), np.arange(len(fp))
        out.append((at, part ^ bit(s) | tag, np.ones(len(fp), bool)))
        for i in range(1, 32):
            j = s ^ np.uint64(i)
            use = (s != 0) & (j > np.uint64(i))  # each pair of places once; j = 0 is the single bit, the home
            out.append((at[use], part[use] ^ bit(np.uint64(i)) ^ bit(j[use]) | tag, np.zeros(int(use.sum()), bool)))
    return tuple(np.concatenate(x) for x in zip(*out))


def _replicate(batches):
    for batch in batches:
        fp = batch.column("fp").to_numpy().view(np.uint64)
        at, anchor, home = anchors(fp)
        yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(fp[at].view(np.int64)), pa.array(home)], names=["anchor", "fp", "home"])


def stars(fp: np.ndarray, home: np.ndarray, bits: int = BITS, tile: int = 2048) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join what is linked through the homes of one anchor: each member to the first of its component.

    Every tile is compared once and leaves a star for each of its components; these are joined at the end.
    """
    order = np.argsort(~home, kind="stable")
    fp, m, n = fp[order], int(home.sum()), len(fp)
    left, right = [], []
    for i in range(0, m, tile):
        for j in range(0, n, tile):
            x, y = np.nonzero(np.bitwise_count(fp[i : min(i + tile, m), None] ^ fp[None, j : j + tile]) <= bits)
            who, at = np.unique(np.r_[x + i, y + j], return_inverse=True)
            label = least_labels(len(who), at[: len(x)], at[len(x) :])
            moved = np.flatnonzero(label != np.arange(len(who)))
            left.append(who[moved]), right.append(who[label[moved]])
    label = least_labels(n, *(np.concatenate([*x, np.zeros(0, np.int64)]) for x in (left, right)))
    moved = np.flatnonzero(label != np.arange(n))
    return fp[moved], fp[label[moved]]


def _compare(bits: int):
    def scan(batches):
        for table in whole_groups(batches, "anchor"):
            anchor, fp, home = (table.column(c).to_numpy() for c in ("anchor", "fp", "home"))
            starts = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
            ends = np.r_[starts[1:], len(anchor)]
            homes = np.add.reduceat(home.astype(np.int64), starts)
            left, right = [], []
            for g in np.flatnonzero((homes > 0) & (ends - starts > 1)):
                a, b = stars(fp[starts[g] : ends[g]].view(np.uint64), home[starts[g] : ends[g]], bits)
                left.append(a.view(np.int64)), right.append(b.view(np.int64))
            if left:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(left)), pa.array(np.concatenate(right))], names=["src", "dst"])

    return scan


def near_links(prints: DataFrame, bits: int = BITS) -> DataFrame:
    """Stars (src, dst) over distinct fingerprints `fp` that join all within `bits` differing bits (3 at most)."""
    if bits > 3:
        raise ValueError("the covering holds for at most three differing bits")
    n = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = prints.select("fp").mapInArrow(_replicate, "anchor bigint, fp bigint, home boolean")
    return met.repartition(n, "anchor").sortWithinPartitions("anchor", "fp").mapInArrow(_compare(bits), "src bigint, dst bigint")


def print_components(docs: DataFrame, width: int = 3, bits: int = BITS) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest doc_id reachable by links between fingerprints."""
    prints = stored(fingerprints(docs, width), "fingerprints")
    distinct = checkpointed(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    roots = components(near_links(distinct, bits))
    linked = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    least = linked.groupBy("root").agg(F.min("rep").alias("component_id"))
    found = checkpointed(linked.join(least, "root").select("fp", "component_id"))
    return prints.join(found, "fp").select("doc_id", "fp", "component_id")


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each document: its fingerprint and the smallest doc_id of its component."""
    return print_components(read(spark, sf_dir, "documents")).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
