"""Line dedup: hashes in range order, streamed; keep bitmaps for each document.

A line's key is the line without white space at its ends and with A-Z lower-cased. Keys of at least `min_chars` code
points that occur in at least `min_docs` documents lose all their lines except those of the largest doc_id.

Plan: every long line becomes (hash, doc_id, position), written once to the shared folder. The table is range-partitioned
on hash, doc_id and position together, so that a line in a third of all documents is spread over many ranges, and sorted
with the largest doc_id first. Each task streams its range batch by batch: the first document of a group keeps its lines, the rest
lose them once the group has enough documents; only lines of a group that has too few so far are held. Groups that cross a
border between ranges are settled from two summaries a range. The number of ranges follows the number of lines.

Defined cases: null or empty text is one empty line; very long texts and lines are split and hashed whole; a row without doc_id
counts for nothing and keeps its lines; rows that repeat or tie on a doc_id are one document for the count, and each row is
returned; no rows give no rows; columns other than doc_id and text are not looked at.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from .shared import read, stored, utf8

#: Long lines in one range.
RANGE_LINES = 4_000_000
BLANK = b" \t\n\x0b\x0c\r"
_LINES = "h1 bigint, h2 bigint, doc_id bigint, text_key bigint, pos int"


def _code_points(line: bytes) -> int:
    return len(line) if line.isascii() else len(line.decode("utf-8", "replace"))


def _lines(min_chars: int):
    def scan(batches):
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for doc, key, text in zip(batch.column("doc_id").to_pylist(), batch.column("text_key").to_pylist(), utf8(batch.column("text"))):
                for pos, line in enumerate(text.split(b"\n")):
                    if len(line) < min_chars:
                        continue
                    line = line.strip(BLANK)
                    if len(line) < min_chars or _code_points(line) < min_chars:
                        continue
                    digest = xxhash.xxh3_128_intdigest(line.lower())
                    for column, value in zip(out, ((digest >> 64) - (1 << 63), (digest & (2**64 - 1)) - (1 << 63), doc, key, pos)):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, [pa.int64()] * 4 + [pa.int32()])], names=["h1", "h2", "doc_id", "text_key", "pos"])

    return scan


#: what: 0 a line to drop, 1 a line whose group crosses a border, 2 a summary of such a group in one range.
_SEEN = "what int, h1 bigint, h2 bigint, doc_id bigint, text_key bigint, pos int, part int, last_doc bigint, docs bigint"


_NAMES = [x.split()[0] for x in _SEEN.split(", ")]


def _stream(min_docs: int):
    """Lines in order of hash, doc_id downwards and position; the first and last group of a range may cross its borders."""

    def scan(batches):
        part = TaskContext.get().partitionId()

        def rows(what, columns, last=None, docs=None):
            n = len(columns[0])
            zero = np.zeros(n, np.int64)
            values = [np.full(n, what, np.int32), *columns, np.full(n, part, np.int32), zero if last is None else last, zero if docs is None else docs]
            return pa.RecordBatch.from_arrays([pa.array(x) for x in values], names=_NAMES)

        def summary(g):
            one = lambda v, t=np.int64: np.array([v], t)
            return rows(2, [one(g["key"][0]), one(g["key"][1]), one(g["top"]), one(0), one(0, np.int32)], one(g["last"]), one(g["docs"]))

        # The open group: its largest doc_id, documents so far, the last one, whether the range begins with it, lines held.
        g = None
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(c).to_numpy() for c in ("h1", "h2", "doc_id", "text_key", "pos")]
            h1, h2, doc = columns[:3]
            fresh = np.r_[True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])]
            first = np.flatnonzero(fresh)
            group, end = np.cumsum(fresh) - 1, np.r_[first[1:], len(doc)] - 1
            docs = np.bincount(group, weights=fresh | np.r_[True, doc[1:] != doc[:-1]]).astype(np.int64)
            top = doc[first]
            goes_on = g is not None and g["key"] == (h1[0], h2[0])
            if goes_on:
                docs[0] += g["docs"] - (doc[0] == g["last"])
                top[0] = g["top"]
            elif g is not None and g["opens"]:
                yield summary(g)
            opens = g["opens"] if goes_on else g is None  # whether the batch's first group is the range's first
            held = g["held"] if goes_on else []
            many, later = docs >= min_docs, doc != top[group]
            inner = np.ones(len(doc), bool)
            if opens:
                inner = group > 0
                yield rows(1, [c[~inner] for c in columns])
                if len(first) > 1:
                    yield summary({"key": (h1[0], h2[0]), "top": top[0], "last": doc[end[0]], "docs": docs[0]})
            if many[0]:
                for x in held:
                    yield rows(0, x)
                held = []
            yield rows(0, [c[inner & later & many[group]] for c in columns])
            n = len(first) - 1
            wait = inner & later & (group == n) & ~many[n]
            held = [*(held if n == 0 else []), *([[c[wait] for c in columns]] if wait.any() else [])]
            g = {"key": (h1[-1], h2[-1]), "top": top[n], "docs": docs[n], "last": doc[-1], "opens": opens and n == 0, "held": held}
        if g is not None:
            for x in g["held"]:
                yield rows(1, x)
            yield summary(g)

    return scan


def _settled(summaries: list) -> list[tuple]:
    """(h1, h2, largest doc_id, documents) of the groups at the borders, from their parts in range order."""
    found: dict[tuple, list] = {}
    for s in sorted(summaries, key=lambda s: (s.part, s.h1, s.h2)):
        if (k := (s.h1, s.h2)) in found:
            found[k][1] += s.docs - (found[k][2] == s.doc_id)
            found[k][2] = s.last_doc
        else:
            found[k] = [s.doc_id, s.docs, s.last_doc]
    return [(*k, top, docs) for k, (top, docs, _) in found.items()]


def _pack(batches):
    for batch in batches:
        maps = []
        for gone in batch.column("gone").to_pylist():
            keep = np.ones(-(-(max(gone) + 1) // 8) * 8, bool)
            keep[gone] = False
            maps.append(zlib.compress(np.packbits(keep, bitorder="little").tobytes(), 6))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), pa.array([len(x) for x in batch.column("gone").to_pylist()], pa.int64()), pa.array(maps, pa.binary())], names=["doc_id", "text_key", "n_dropped", "keep_bitmap"])


def with_key(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"))


def keep_bitmaps(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """(doc_id, text_key, n_dropped, keep_bitmap) for the documents that lose lines.

    keep_bitmap: zlib-compressed bits, least significant first, one a line, 1 to keep; lines after its end are kept.
    """
    spark = docs.sparkSession
    lines = stored(with_key(docs).where("doc_id is not null").mapInArrow(_lines(min_chars), _LINES), "lines")
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-lines.count() // RANGE_LINES))
    keys = (F.col("h1"), F.col("h2"), F.col("doc_id").desc(), F.col("pos"))
    seen = stored(lines.repartitionByRange(n, *keys).sortWithinPartitions(*keys).mapInArrow(_stream(min_docs), _SEEN), "line-groups")
    settled = [x for x in _settled(seen.where("what = 2").collect()) if x[3] >= min_docs]  # at most two groups a range
    borders = spark.createDataFrame(settled, "h1 bigint, h2 bigint, top_doc bigint, n bigint")
    late = seen.where("what = 1").join(F.broadcast(borders), ["h1", "h2"]).where("doc_id <> top_doc")
    gone = seen.where("what = 0").select("doc_id", "text_key", "pos").union(late.select("doc_id", "text_key", "pos"))
    return gone.groupBy("doc_id", "text_key").agg(F.collect_set("pos").alias("gone")).mapInArrow(_pack, "doc_id bigint, text_key bigint, n_dropped bigint, keep_bitmap binary")


def kept_text(text: bytes, bitmap: bytes | None) -> bytes:
    if bitmap is None:
        return text
    lines = text.split(b"\n")
    bits = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), bitorder="little")
    keep = np.ones(max(len(lines), len(bits)), bool)
    keep[: len(bits)] = bits.astype(bool)
    return b"\n".join(x for x, k in zip(lines, keep) if k)


def _digest(batches):
    for batch in batches:
        texts, maps = utf8(batch.column("text")), batch.column("keep_bitmap").to_pylist()
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array([x.count(b"\n") + 1 for x in texts], pa.int64()), batch.column("n_dropped"), pa.array([hashlib.sha256(kept_text(x, b)).hexdigest() for x, b in zip(texts, maps)])],
            names=["doc_id", "n_lines", "n_dropped", "kept_sha256"],
        )


def _joined(docs: DataFrame, **limits) -> DataFrame:
    maps = keep_bitmaps(docs, **limits)
    return with_key(docs).join(maps, ["doc_id", "text_key"], "left").select("doc_id", "text", F.coalesce("n_dropped", F.lit(0)).cast("bigint").alias("n_dropped"), "keep_bitmap")


def dedup_lines(docs: DataFrame, **limits) -> DataFrame:
    """(doc_id, text): the documents with the lines that remain."""

    def apply(batches):
        for batch in batches:
            texts = [kept_text(x, b).decode("utf-8", "replace") for x, b in zip(utf8(batch.column("text")), batch.column("keep_bitmap").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return _joined(docs, **limits).mapInArrow(apply, "doc_id bigint, text string")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each document: doc_id, n_lines, n_dropped and the hash of what is kept."""
    return _joined(read(spark, sf_dir, "documents")).mapInArrow(_digest, "doc_id bigint, n_lines bigint, n_dropped bigint, kept_sha256 string")


OP3_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT doc_id, pos, line,
             translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                       'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
d AS (SELECT key, max(doc_id) AS top_doc FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.doc_id, k.pos, k.line, d.key IS NOT NULL AND k.doc_id <> d.top_doc AS gone FROM k LEFT JOIN d ON k.key = d.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
