"""Substring dedup: a depth-limited radix sort of the suffixes that can repeat.

A byte goes if a WINDOW-byte string that covers it also starts in a document with a smaller doc_id. Suffixes are ordered only
through WINDOW bytes; groups of equal ones are exactly the repeated windows.
Anchors (see windows.py) only choose which suffixes are sorted and where they meet: equal windows have equal anchors, and windows
that follow each other share one, as a run. What is equal is decided by most-significant-digit passes of eight bytes each, on the
bytes themselves; what is alone in its group drops out after each pass.

 1. Anchor hashes are dealt out by value; those seen in two documents set bits of a filter of bounded size. A filter that fills
    up only lets more runs through; nothing depends on its misses, it has none.
 2. Runs that pass are sorted through all their bytes, first in each task, where copies are settled, so a text in a third of all
    documents sends one row a task; then by anchor. Of equal runs, all but those of the smallest doc_id are covered.
 3. Of anchors with several different runs, each run's windows are sorted through WINDOW bytes, and those that repeat a smaller
    document's are covered. An anchor with over WIDE different runs is too large for one task: its windows are dealt out one by
    one, by their content, and sorted as in 2.

Intervals meet their texts in one join on doc_id.

Defined cases: null or empty text has no bytes; texts shorter than a window lose nothing; very long texts are sorted in blocks like
others; rows that repeat or tie on a doc_id are one document, and each row is returned; a row without doc_id keeps all and counts
for nothing; no rows give no rows; columns other than doc_id and text are not looked at.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession, functions as F

from .shared import read, stored, utf8, whole_groups
from .windows import WINDOW, Runs, mix

#: Bits of an anchor hash that the filter sees; bits of the filter at most; bytes of text in one computation; anchors, and runs, held
#: in a task; different runs of an anchor that are sorted together (some 500,000 windows, 100 MB); windows of several anchors in one sort.
SEEN, FILTER, BLOCK, HELD, RUNS_HELD, WIDE, SORTED = 40, 28, 100_000, 4_000_000, 400_000, 32_768, 200_000
#: Bytes of a run, padded to whole digits; the last one holds the number of windows.
RUN_BYTES = 80
_OUT = "kind int, gram bigint, doc bigint, pack bigint, size bigint, text binary"


def _tag(docs: DataFrame):
    """24 bits that tell rows of one doc_id apart; 0 if no doc_id repeats."""
    if docs.groupBy("doc_id").count().where("count > 1").limit(1).count():
        return F.xxhash64(F.coalesce("text", F.lit(""))).bitwiseAND(0xFFFFFF)
    return F.lit(0).cast("bigint")


def _texts(docs: DataFrame, tag) -> DataFrame:
    """Texts of documents with an id."""
    return docs.where(F.col("doc_id").isNotNull()).select("doc_id", tag.alias("tag"), F.coalesce("text", F.lit("")).alias("text"))


def _blocks(batches):
    """(doc_ids, tags, Runs) for some documents at a time."""
    ids, tags, texts, size = [], [], [], 0
    for batch in batches:
        for i, g, t in zip(batch.column("doc_id").to_pylist(), batch.column("tag").to_pylist(), utf8(batch.column("text"))):
            if len(t) < WINDOW:
                continue
            ids.append(i), tags.append(g), texts.append(t)
            size += len(t)
            if size >= BLOCK:
                yield np.array(ids, np.int64), np.array(tags, np.int64), Runs(texts)
                ids, tags, texts, size = [], [], [], 0
    if texts:
        yield np.array(ids, np.int64), np.array(tags, np.int64), Runs(texts)


def _pack(tag: np.ndarray, at: np.ndarray, count: np.ndarray) -> np.ndarray:
    return tag << 40 | at << 8 | count


def _unpack(pack: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return pack >> 40 & 0xFFFFFF, pack >> 8 & 0xFFFFFFFF, pack & 0xFF


def _first_of(*keys: np.ndarray) -> np.ndarray:
    """Where a new group of equal keys begins, in sorted columns."""
    fresh = np.zeros(len(keys[0]), bool)
    fresh[:1] = True
    for k in keys:
        fresh[1:] |= k[1:] != k[:-1]
    return fresh


# ---- 1. which anchors can repeat


def _anchors(buckets: int):
    """Per task and bucket the sorted SEEN-bit hashes, five bytes each; twice if two documents of the task have it."""

    def emit(values, docs):
        order = np.lexsort((docs, values))
        v, d = values[order], docs[order]
        fresh = _first_of(v)
        again = np.r_[False, (v[1:] == v[:-1]) & (d[1:] != d[:-1])]
        nth = np.cumsum(again) - np.maximum.accumulate(np.where(fresh, np.cumsum(again), 0))
        v = v[fresh | (again & (nth == 1))]
        cut = np.searchsorted(v, (np.arange(buckets + 1, dtype=np.uint64) << np.uint64(SEEN)) // np.uint64(buckets))
        raw = v.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(buckets)), pa.array([raw[5 * i : 5 * j] for i, j in zip(cut, cut[1:])], pa.binary())], names=["bucket", "raw"])

    def scan(batches):
        values, docs, n = [], [], 0
        for ids, _, runs in _blocks(batches):
            values.append(runs.gram >> np.uint64(64 - SEEN)), docs.append(ids[runs.doc])
            n += len(values[-1])
            if n >= HELD:
                yield from emit(np.concatenate(values), np.concatenate(docs))
                values, docs, n = [], [], 0
        if n:
            yield from emit(np.concatenate(values), np.concatenate(docs))

    return scan


def _repeated(batches):
    for table in whole_groups(batches, "bucket"):
        for bucket in np.unique(table.column("bucket").to_numpy()):
            part = table.filter(pa.compute.equal(table.column("bucket"), int(bucket)))
            raw = np.frombuffer(b"".join(part.column("raw").to_pylist()), np.uint8).reshape(-1, 5)
            v = np.zeros((len(raw), 8), np.uint8)
            v[:, :5] = raw
            v = np.sort(v.view("<u8").ravel())
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(v[1:][v[1:] == v[:-1]]).astype(np.int64))], names=["v"])


class Filter:
    """A bitmap over the top bits of anchor hashes. False hits are harmless."""

    def __init__(self, bits: int, data: np.ndarray):
        self.shift, self.data = np.uint64(64 - bits), data

    def __call__(self, gram: np.ndarray) -> np.ndarray:
        at = (gram >> self.shift).astype(np.int64)
        return (self.data[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1

    @classmethod
    def of(cls, values: DataFrame) -> Filter:
        """From `v`, SEEN-bit hashes. Slices of the bitmap are made where the values are and gathered: FILTER bits at most."""
        bits = min(FILTER, max(20, int(32 * values.count()).bit_length()))
        n = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        wide = 14  # bits in a slice, as a power of two

        def slices(batches):
            for table in whole_groups(batches, "slice"):
                at, slot = table.column("slice").to_numpy(), table.column("slot").to_numpy()
                for s in np.unique(at):
                    mask = np.zeros(1 << wide, bool)
                    mask[slot[at == s]] = True
                    yield pa.RecordBatch.from_arrays([pa.array([int(s)]), pa.array([np.packbits(mask, bitorder="little").tobytes()], pa.binary())], names=["slice", "raw"])

        slot = F.shiftright("v", SEEN - bits)
        rows = values.select(F.shiftright(slot, wide).alias("slice"), slot.bitwiseAND((1 << wide) - 1).alias("slot"))
        rows = rows.repartition(n, "slice").sortWithinPartitions("slice").mapInArrow(slices, "slice bigint, raw binary")
        data = np.zeros(1 << (bits - 3), np.uint8)
        for r in rows.toLocalIterator():
            data[r.slice << (wide - 3) : (r.slice + 1) << (wide - 3)] = np.frombuffer(r.raw, np.uint8)
        return cls(bits, data)


def _shared_filter(texts: DataFrame) -> Filter:
    n = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = 4 * n
    rows = texts.mapInArrow(_anchors(buckets), "bucket bigint, raw binary")
    return Filter.of(stored(rows.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(_repeated, "v bigint"), "anchors"))


# ---- 2. and 3. runs: kind 1; a covered interval, kind 0, has a size and travels with the runs, dealt out by its document


def _rows(kind: int, gram, doc, pack, size=None, text: pa.Array | None = None) -> pa.RecordBatch:
    n = len(doc)
    size = pa.array(size) if size is not None else pa.nulls(n, pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), pa.array(gram.view(np.int64)), pa.array(doc), pa.array(pack), size, text if text is not None else pa.nulls(n, pa.binary())], names=["kind", "gram", "doc", "pack", "size", "text"])


def _covered(doc, tag, at, size) -> pa.RecordBatch:
    """Intervals, joined where they touch."""
    order = np.lexsort((at, tag, doc))
    doc, tag, at, end = doc[order], tag[order], at[order], (at + size)[order]
    if len(doc):
        group = np.cumsum(_first_of(doc, tag)) - 1
        reach = np.maximum.accumulate(end + group * (1 << 33)) - group * (1 << 33)
        fresh = _first_of(doc, tag) | np.r_[True, at[1:] > reach[:-1]]
        first = np.flatnonzero(fresh)
        last = np.r_[first[1:], len(doc)] - 1
        doc, tag, at, end = doc[first], tag[first], at[first], reach[last]
    return _rows(0, mix(doc.view(np.uint64) + np.uint64(1)), doc, _pack(tag, at, np.zeros(len(doc), np.int64)), end - at)


class Sorted:
    """Runs (gram, doc, pack, bytes) with their groups of equals: `same` names a row of the group, `least` its smallest doc."""

    def __init__(self, gram: np.ndarray, doc: np.ndarray, pack: np.ndarray, wide: np.ndarray):
        self.same = radix_classes(gram, wide)
        least = doc.copy()
        np.minimum.at(least, self.same, doc)
        self.least = least[self.same]
        follow = doc > self.least
        tag, at, count = _unpack(pack[follow])
        self.covered = _covered(doc[follow], tag, at, count + WINDOW - 1)
        stay = np.flatnonzero(~follow)
        stay = stay[np.lexsort((pack[stay], self.same[stay], gram[stay]))]
        # A document can hold a run in several places; equal rows of it are one.
        self.stay = stay[_first_of(self.same[stay], pack[stay])]
        self.gram, self.doc, self.pack, self.wide = gram, doc, pack, wide

    def rows(self, kind: int, at: np.ndarray | None = None) -> pa.RecordBatch:
        at = self.stay if at is None else at
        return _rows(kind, self.gram[at], self.doc[at], self.pack[at], None, _binary(self.wide[at]))


def _widened(data: np.ndarray, start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The bytes of runs of `count` windows, as rows of RUN_BYTES."""
    step = np.arange(RUN_BYTES)
    wide = data[np.minimum(start[:, None] + step, max(0, len(data) - 1))] if len(start) else np.zeros((0, RUN_BYTES), np.uint8)
    wide[step >= (count + WINDOW - 1)[:, None]] = 0
    wide[:, -1] = count
    return wide


def _binary(wide: np.ndarray) -> pa.Array:
    size = wide[:, -1].astype(np.int32) + WINDOW - 1
    flat = wide[np.arange(RUN_BYTES) < size[:, None]]
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(np.r_[0, np.cumsum(size)].astype(np.int32).tobytes()), pa.py_buffer(flat.tobytes())])


def _runs_of(table: pa.Table | pa.RecordBatch) -> tuple:
    """(gram, doc, pack, bytes) of rows with text."""
    gram, doc, pack = (table.column(c).to_numpy() for c in ("gram", "doc", "pack"))
    text = table.column("text")
    text = text.combine_chunks() if isinstance(text, pa.ChunkedArray) else text
    texts = text.to_pylist()
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    return gram, doc, pack, _widened(np.frombuffer(b"".join(texts), np.uint8), np.cumsum(size) - size, size - WINDOW + 1)


def _runs(passes: Filter):
    """Runs that pass the filter, one of each kind in a task; the task's other copies are covered at once."""

    def scan(batches):
        held, n = [], 0
        for ids, tags, runs in _blocks(batches):
            ok = np.flatnonzero(passes(runs.gram))
            doc = runs.doc[ok]
            held.append((runs.gram[ok].view(np.int64), ids[doc], _pack(tags[doc], runs.at[ok], runs.count[ok]), _widened(runs.data, runs.start[ok], runs.count[ok])))
            n += len(doc)
            if n >= RUNS_HELD:
                found = Sorted(*(np.concatenate(x) for x in zip(*held)))
                yield from (found.covered, found.rows(1))
                held, n = [], 0
        if n:
            found = Sorted(*(np.concatenate(x) for x in zip(*held)))
            yield from (found.covered, found.rows(1))

    return scan


def radix_classes(group: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Most-significant-digit passes over rows of bytes within `group`: for each row, the first row that equals it.

    After each pass of eight bytes, rows alone in their group drop out.
    """
    same, left = np.arange(len(rows)), np.arange(len(rows))
    if rows.shape[1] % 8:
        wide = np.zeros((len(rows), -(-rows.shape[1] // 8) * 8), np.uint8)
        wide[:, : rows.shape[1]] = rows
        rows = wide
    digits = np.ascontiguousarray(rows).view(">u8")
    for i in range(-1, digits.shape[1]):
        digit = digits[left, i].astype(np.uint64) if i >= 0 else np.zeros(len(left), np.uint64)
        order = np.lexsort((digit, group)) if i >= 0 else np.argsort(group, kind="stable")
        left, group, digit = left[order], group[order], digit[order]
        group = np.cumsum(_first_of(group, digit)) - 1
        several = np.bincount(group)[group] > 1 if len(group) else np.zeros(0, bool)
        left, group = left[several], group[several]
        if not len(left):
            return same
    fresh = _first_of(group)
    same[left] = np.minimum.reduceat(left, np.flatnonzero(fresh))[np.cumsum(fresh) - 1]
    return same


def radix_groups(group: np.ndarray, windows: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each row of bytes within `group`, the least doc of its equals."""
    same, least = radix_classes(group, windows), doc.copy()
    np.minimum.at(least, same, doc)
    return least[same]


def _steps(count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, place in the row) for rows of `count` members."""
    row = np.repeat(np.arange(len(count)), count)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)


def _cut(wide: np.ndarray, row: np.ndarray, step: np.ndarray) -> np.ndarray:
    """The windows at `step` of rows, without index arrays of their size."""
    return np.lib.stride_tricks.sliding_window_view(wide, WINDOW, axis=1)[row, step]


def _windows(found: Sorted, at: np.ndarray) -> pa.RecordBatch:
    """The intervals covered by single windows of the runs `at`, which stay, in order of gram and group of equals."""
    fresh = _first_of(found.same[at])
    one, of = at[fresh], np.cumsum(fresh) - 1  # one run of each group of equals; the group of each run
    run, step = _steps(_unpack(found.pack[one])[2])
    doc = found.least[one][run]
    hit = np.flatnonzero(radix_groups(found.gram[one][run], _cut(found.wide, one[run], step), doc) < doc)
    hits = np.bincount(run[hit], minlength=len(one))
    which, nth = _steps(hits[of])
    step = step[hit][(np.cumsum(hits) - hits)[of[which]] + nth]
    tag, place, _ = _unpack(found.pack[at[which]])
    return _covered(found.doc[at[which]], tag, place + step, np.full(len(which), WINDOW, np.int64))


def _settled(table: pa.Table, wide: int):
    """Whole anchors: covered intervals, and the runs of anchors with over `wide` different ones (kind 3)."""
    found = Sorted(*_runs_of(table))
    yield found.covered
    stay = found.stay
    gram, fresh = found.gram[stay], _first_of(found.same[stay])
    first = np.flatnonzero(_first_of(gram))
    if not len(first):
        return
    different = np.add.reduceat(fresh.astype(np.int64), first)
    docs = [f.reduceat(found.doc[stay], first) for f in (np.minimum, np.maximum)]
    size = np.diff(np.r_[first, len(stay)])
    kind = np.where((different < 2) | (docs[0] == docs[1]), 0, np.where(different > wide, 3, 2))
    if (kind == 3).any():
        yield found.rows(3, stay[np.repeat(kind == 3, size)])
    todo = np.flatnonzero(kind == 2)
    batch = np.cumsum(different[todo] * 16) // SORTED
    for b in np.unique(batch):
        pick = np.zeros(len(first), bool)
        pick[todo[batch == b]] = True
        yield _windows(found, stay[np.repeat(pick, size)])


def _sort(wide: int):
    """Runs in order of gram: those of whole anchors are settled; a large anchor's are thinned as they come, and given up as kind 3."""

    def scan(batches):
        held, given = None, None  # the last anchor's rows so far; an anchor that is given up
        for batch in batches:
            is_run = pa.compute.equal(batch.column("kind"), 1)
            yield batch.filter(pa.compute.invert(is_run))
            table = pa.Table.from_batches([batch.filter(is_run)])
            table = table if held is None else pa.concat_tables([held, table])
            if not len(table):
                continue
            gram = table.column("gram").to_numpy()
            if given is not None:
                n = int(np.searchsorted(gram, given, "right"))
                found = Sorted(*_runs_of(table.slice(0, n)))
                yield from (found.covered, found.rows(3))
                table, gram = table.slice(n), gram[n:]
                if not len(table):
                    held = None
                    continue
                given = None
            cut = int(np.searchsorted(gram, gram[-1], "left"))
            if cut:
                yield from _settled(table.slice(0, cut), wide)
            held = table.slice(cut)
            if len(held) > RUNS_HELD:
                found = Sorted(*_runs_of(held))
                yield found.covered
                held = pa.Table.from_batches([found.rows(1)])
                if len(np.unique(found.same[found.stay])) > wide:
                    yield found.rows(3)
                    held, given = None, gram[-1]
        if held is not None and len(held):
            yield from _settled(held, wide)

    return scan


def digest(window: np.ndarray) -> np.ndarray:
    """A hash of each row of WINDOW bytes, by which windows are dealt out."""
    wide = np.zeros((len(window), -(-WINDOW // 8) * 8), np.uint8)
    wide[:, :WINDOW] = window
    words, out = wide.view("<u8"), np.full(len(window), 0x51ED270B, np.uint64)
    for i in range(words.shape[1]):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + words[:, i])
    return out


def _singles(batches):
    """Each window of runs as a run of its own; a task's copies are covered at once."""
    for whole in batches:
        for lo in range(0, whole.num_rows, RUNS_HELD // 16):
            _, doc, pack, wide = _runs_of(whole.slice(lo, RUNS_HELD // 16))
            tag, at, count = _unpack(pack)
            row, step = _steps(count)
            window = np.zeros((len(row), RUN_BYTES), np.uint8)
            window[:, :WINDOW] = _cut(wide, row, step)
            window[:, -1] = 1
            found = Sorted(digest(window[:, :WINDOW]).view(np.int64), doc[row], _pack(tag[row], at[row] + step, np.ones(len(row), np.int64)), window)
            yield from (found.covered, found.rows(1))


def covered(docs: DataFrame, tag, wide: int = WIDE) -> DataFrame:
    """(doc_id, tag, gone): the intervals (start, size) of bytes to remove, for documents that lose any; they may overlap."""
    spark = docs.sparkSession
    texts = _texts(docs, tag)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = lambda rows: rows.repartition(n, "gram").sortWithinPartitions("gram")
    sent = texts.mapInArrow(_runs(_broadcast(spark, _shared_filter(texts))), _OUT)
    met = stored(dealt(sent).mapInArrow(_sort(wide), _OUT), "run-groups")
    # Distinct windows are few or many, but each is one run here: no anchor of theirs is wide.
    left = dealt(met.where("kind = 3").mapInArrow(_singles, _OUT)).mapInArrow(_sort(1 << 62), _OUT)
    gone = met.where("kind = 0").union(left)
    tag, at = F.shiftright("pack", 40).bitwiseAND(0xFFFFFF), F.shiftright("pack", 8).bitwiseAND(0xFFFFFFFF)
    return gone.select(F.col("doc").alias("doc_id"), tag.alias("tag"), F.struct(at.alias("start"), "size").alias("x")).groupBy("doc_id", "tag").agg(F.collect_list("x").alias("gone"))


class _broadcast:
    """A filter as a Spark broadcast, opened once a task."""

    def __init__(self, spark: SparkSession, found: Filter):
        self.shift, self.data = found.shift, spark.sparkContext.broadcast(found.data)

    def __call__(self, gram: np.ndarray) -> np.ndarray:
        at = (gram >> self.shift).astype(np.int64)
        return (self.data.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def _joined(docs: DataFrame, wide: int = WIDE) -> DataFrame:
    tag = _tag(docs)
    here = docs.select("doc_id", "text", tag.alias("tag"))
    return here.join(covered(docs, tag, wide), ["doc_id", "tag"], "left").select("doc_id", "text", F.col("gone.start").alias("start"), F.col("gone.size").alias("size"))


def removed(size: int, starts, sizes) -> np.ndarray:
    """A mask of the bytes that the intervals cover."""
    edge = np.zeros(size + 1, np.int64)
    np.add.at(edge, np.asarray(starts, np.int64), 1)
    np.add.at(edge, np.asarray(starts, np.int64) + np.asarray(sizes, np.int64), -1)
    return np.cumsum(edge[:-1]) > 0


def dedup_substrings(docs: DataFrame, wide: int = WIDE) -> DataFrame:
    """(doc_id, kept): the bytes that remain, concatenated. They need not be sound UTF-8 any more."""

    def scan(batches):
        for batch in batches:
            out = [_kept(t, s, k)[0] for t, s, k in zip(utf8(batch.column("text")), batch.column("start").to_pylist(), batch.column("size").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.binary())], names=["doc_id", "kept"])

    return _joined(docs, wide).mapInArrow(scan, "doc_id bigint, kept binary")


def _kept(text: bytes, starts, sizes) -> tuple[bytes, int, int]:
    """What remains, bytes removed, and runs of removed bytes."""
    if not starts:
        return text, 0, 0
    gone = removed(len(text), starts, sizes)
    return np.frombuffer(text, np.uint8)[~gone].tobytes(), int(gone.sum()), int((gone & ~np.r_[False, gone[:-1]]).sum())


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each document: its bytes, those removed, in how many runs, and the hash of what is kept."""

    def scan(batches):
        for batch in batches:
            texts = utf8(batch.column("text"))
            found = [_kept(t, s, k) for t, s, k in zip(texts, batch.column("start").to_pylist(), batch.column("size").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array([x[1] for x in found], pa.int64()), pa.array([x[2] for x in found], pa.int64()), pa.array([hashlib.sha256(x[0]).hexdigest() for x in found], pa.string())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    return _joined(read(spark, sf_dir, "documents")).mapInArrow(scan, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")
