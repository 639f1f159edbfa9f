"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Every text gives a fixed vector of statistics of its characters, words and lines, each transformed towards a normal shape
(logarithms of counts, log odds of fractions). One distributed pass sums, for each class, the count, the vectors and their
outer products over all labelled training rows; from these come the class means and covariances, shrunk towards the pooled
covariance and towards a multiple of the identity. A document's score is the logistic function of the difference of the two
log densities (Mahalanobis distances by cached Cholesky factors) plus the log prior odds.

Labels are taken only from rows whose crc32 of doc_id, as text, is not 1 modulo 3; label, language, source and doc_id are
never inputs.

Defined cases: null text counts as empty, and empty texts get a score like any other; labels that are null, or of documents
that are missing, are ignored; a document with several labels counts with their rounded mean; a class without training rows
makes every score the prior, 0.5 if there is no label at all; very long texts count whole; rows that repeat or tie are returned
each; no rows give no rows; columns other than doc_id and text are carried by keep_good and not looked at.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from .shared import pieces, read, stored, utf8

FOLD, FOLDS = 1, 3
#: Shares of the pooled covariance and of the identity in each class covariance.
POOLED, IDENTITY = 0.5, 0.02
#: Added to both parts of each odds, so that the fractions of short texts say little.
REST = 10.0

_KINDS = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": b"abcdefghijklmnopqrstuvwxyz", "digit": b"0123456789", "stop": b".,;:?'\"()-", "shout": b"!",
    "mark": b"#$%&*+/<=>@[\\]^_`{}~", "bar": b"|", "space": b" \t", "line": b"\n",
}
_KIND_OF = np.full(256, len(_KINDS), np.int64)
for _i, _chars in enumerate(_KINDS.values()):
    _KIND_OF[list(_chars)] = _i
WIDTH = 21


def statistics(text: bytes) -> np.ndarray:
    """The transformed statistics of one whole text."""
    n = len(text)
    kinds = np.bincount(_KIND_OF, weights=np.bincount(np.frombuffer(text, np.uint8), minlength=256), minlength=len(_KINDS) + 1)
    odds = lambda part, whole, rest=REST: np.log((part + rest) / (whole - part + rest))
    words, lines = text.split(), text.split(b"\n")
    nw, nl = len(words), len(lines)
    counts = Counter(words)
    top = sum(c for _, c in counts.most_common(5))
    pairs = len(set(zip(words, words[1:]))) if nw > 1 else 0
    letters = kinds[0] + kinds[1]
    line_counts = Counter(lines)
    repeated = sum(len(x) * (c - 1) for x, c in line_counts.items())
    plain = sum(1 for w in words if w[-1:].isalpha() or w[-1] >= 128)
    shouted = sum(1 for w in words if w.isupper() and len(w) > 1)
    sizes = np.fromiter(map(len, words), np.float64, nw) if nw else np.zeros(1)
    return np.array([
        np.log1p(n), np.log1p(nw), *(odds(kinds[i], n) for i in range(len(_KINDS))), odds(kinds[0], letters), np.log1p(sizes.mean()), np.log1p(sizes.std()),
        odds(len(counts), nw), odds(top, nw), odds(pairs, max(nw - 1, pairs)), odds(repeated, max(n, repeated)), odds(plain, nw), odds(shouted, nw), np.log(nl / (nw + 1)),
    ])


def featured(docs: DataFrame, *more) -> DataFrame:
    """(doc_id, more..., x): the statistics of each text."""
    rows = docs.select("doc_id", *more, "text")
    keep = [c for c in rows.columns if c != "text"]
    kinds = {f.name: f.dataType for f in rows.schema.fields}

    def scan(batches):
        for batch in pieces(batches):
            found = np.array([statistics(x) for x in utf8(batch.column("text"))]).reshape(-1, WIDTH)
            x = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1, dtype=np.int32) * WIDTH), pa.array(found.ravel()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), x], names=[*keep, "x"])

    return rows.mapInArrow(scan, StructType([*(StructField(c, kinds[c]) for c in keep), StructField("x", ArrayType(DoubleType()))]))


def in_fold(doc_id="doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % FOLDS == FOLD, F.lit(False))


class Model:
    """Class means and Cholesky factors, held ready for scoring; small, whatever the corpus."""

    def __init__(self, sums: dict[int, np.ndarray]):
        n = {c: sums[c][0] if c in sums else 0.0 for c in (0, 1)}
        total = n[0] + n[1]
        self.prior = (n[1] + 1) / (total + 2) if total else 0.5
        self.parts: list = []
        if min(n.values()) < 2:
            return
        mean = {c: sums[c][1 : 1 + WIDTH] / n[c] for c in (0, 1)}
        cov = {c: sums[c][1 + WIDTH :].reshape(WIDTH, WIDTH) / n[c] - np.outer(mean[c], mean[c]) for c in (0, 1)}
        pooled = (n[0] * cov[0] + n[1] * cov[1]) / total
        self.scale = np.sqrt(np.maximum(np.diag(pooled) + 0.25 * (mean[1] - mean[0]) ** 2, 1e-9))
        for c in (0, 1):
            s = ((1 - POOLED) * cov[c] + POOLED * pooled) / np.outer(self.scale, self.scale)
            s = (1 - IDENTITY) * s + IDENTITY * max(np.trace(s) / WIDTH, 1e-6) * np.eye(WIDTH)
            factor = np.linalg.cholesky(s)
            self.parts.append((mean[c] / self.scale, np.linalg.inv(factor), np.log(np.diag(factor)).sum(), np.log(n[c] / total)))

    def score(self, x: np.ndarray) -> np.ndarray:
        """The chance of label 1 for each row of statistics."""
        if not self.parts:
            return np.full(len(x), self.prior)
        z = x / self.scale
        d = [lp - half_log_det - 0.5 * (((z - mean) @ inverse.T) ** 2).sum(axis=1) for mean, inverse, half_log_det, lp in self.parts]
        return 1 / (1 + np.exp(-np.clip(d[1] - d[0], -500, 500)))


def fit(features: DataFrame, labels: DataFrame) -> Model:
    """From features (doc_id, x) and labels (doc_id, quality), training rows only."""
    known = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("y"))
    rows = features.where(~in_fold() & F.col("doc_id").isNotNull()).join(known, "doc_id").select("y", "x")

    def sums(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            y, x = batch.column("y").to_numpy(), batch.column("x").flatten().to_numpy().reshape(-1, WIDTH)
            for c in np.unique(y):
                z = x[y == c]
                total[c] = total.get(c, 0.0) + np.concatenate([[len(z)], z.sum(axis=0), (z.T @ z).ravel()])
        for c, v in total.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), c, np.int32)), pa.array(np.arange(len(v), dtype=np.int32)), pa.array(v)], names=["y", "i", "v"])

    found: dict[int, np.ndarray] = {}
    for r in rows.mapInArrow(sums, "y int, i int, v double").groupBy("y", "i").agg(F.sum("v").alias("v")).collect():  # 2 x 463 rows
        found.setdefault(r.y, np.zeros(1 + WIDTH + WIDTH * WIDTH))[r.i] = r.v
    return Model(found)


def scored(features: DataFrame, model: Model) -> DataFrame:
    """features with score in place of x."""
    keep = [f for f in features.schema.fields if f.name != "x"]

    def scan(batches):
        for batch in batches:
            score = model.score(batch.column("x").flatten().to_numpy().reshape(-1, WIDTH))
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in keep), pa.array(score)], names=[*(f.name for f in keep), "score"])

    return features.mapInArrow(scan, StructType([*keep, StructField("score", DoubleType())]))


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of `docs` whose score is at least `least`. Texts are read twice and never dealt out."""
    model = fit(featured(docs), labels)

    def scan(batches):
        for batch in pieces(batches):
            found = np.array([statistics(x) for x in utf8(batch.column("text"))]).reshape(-1, WIDTH)
            yield batch.filter(pa.array(model.score(found) >= least))

    return docs.mapInArrow(scan, docs.schema)


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each document: whether it is held out, its score and the predicted label."""
    features = stored(featured(read(spark, sf_dir, "documents")), "quality-statistics")
    rows = scored(features, fit(features, read(spark, sf_dir, "labels")))
    return rows.select("doc_id", in_fold().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
