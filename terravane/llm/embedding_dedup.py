"""Embedding near-dedup: int8 tile products with error bounds, exact recomputation of what is left.

Vectors that are equal in every component collapse into one row with its count. Candidates meet at pivots, vectors drawn from
the table (a bounded sample): each vector is at home with its nearest pivot. With a the angle of the threshold, a vector linked
to a home of a pivot lies within the pivot's radius (its farthest home) plus a, and within its own home's angle plus 2 a; it is
sent to every pivot that both bounds allow, so no pair is missed, whatever the directions are like. Of two homes the pair is
counted at the smaller pivot, so vectors are sent to smaller ones only. At a pivot, homes are compared with all that came in tiles:
both sides are quantised to int8, each vector with the exact norm of its own quantisation error, so every product has a
rigorous bound; pairs that the bound rules out are dropped and only the others are recomputed in double precision. Pivots with
many homes are split into parts; a task holds the homes of one part and streams past them whatever comes to the pivot, so
memory does not grow with a dense cluster (comparisons do: they are all pairs of it). Products of int8 codes are taken in
floating point of a width that keeps their sums exact. A tile returns counts and a star for each local component, not its pairs.

Vectors of different lengths are never compared: each length has pivots of its own.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components link with nothing; rows with equal
vec_id, and equal vectors, are compared like any others; null vec_id counts as a vector but never as the smallest id; no rows
give no rows; columns other than vec_id and embedding are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .shared import checkpointed, components, read, stored

#: The slack, an angle, covers rounding.
THRESHOLD, SLACK = 0.95, 1e-5
#: Pivots at most, homes in one part of a pivot, rows in a tile.
PIVOTS, PART, TILE = 4096, 4096, 1024
#: Rows that a task sends at once.
SENT = 8192


def quantised(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scales, norms of what the codes stand for, and norms of the errors, for unit rows."""
    scale = np.maximum(np.abs(unit).max(axis=1, initial=0.0), 1e-30) / 127
    codes = np.rint(unit / scale[:, None]).astype(np.int8)
    back = codes * scale[:, None]
    return codes, scale, np.linalg.norm(back, axis=1), np.linalg.norm(unit - back, axis=1) * (1 + 1e-9) + 1e-12


class Tile:
    """Unit rows with their quantised form."""

    def __init__(self, unit: np.ndarray):
        self.unit, (self.codes, self.scale, self.norm, self.error) = unit, quantised(unit)
        self.codes = self.codes.astype(np.float32 if unit.shape[1] * 127 * 127 < 1 << 24 else np.float64)  # sums of products stay exact


def linked(a: Tile, b: Tile, threshold: float = THRESHOLD) -> tuple[np.ndarray, np.ndarray, int]:
    """Pairs (i, j) of rows with a cosine of at least `threshold`, and how many were recomputed."""
    product = (a.codes @ b.codes.T) * a.scale[:, None] * b.scale[None, :]
    bound = a.norm[:, None] * b.error[None, :] + a.error[:, None] * b.norm[None, :] + a.error[:, None] * b.error[None, :]
    i, j = np.nonzero(product + bound >= threshold)
    cosine = np.einsum("ij,ij->i", a.unit[i], b.unit[j])
    keep = cosine >= threshold
    return i[keep], j[keep], len(i)


def _units(column: pa.Array) -> np.ndarray:
    """Unit rows from a list column of one length."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    return x / np.linalg.norm(x, axis=1)[:, None]


def _by_length(batch: pa.RecordBatch):
    """(length, rows of it), at most TILE at a time."""
    size = batch.column("d").to_numpy()
    for d in np.unique(size):
        at = np.flatnonzero(size == d)
        for lo in range(0, len(at), TILE):
            yield int(d), batch.take(pa.array(at[lo : lo + TILE]))


class Pivots:
    """The pivots of each length, numbered through; `first` is the number of a length's first one."""

    def __init__(self, drawn: dict[int, list], lengths: list[int]):
        self.of, self.first, n = {}, {}, 0
        for d in sorted(lengths):
            x = np.array(drawn.get(d) or [np.eye(1, d)[0]], np.float64)  # any direction serves
            self.of[d], self.first[d] = x / np.linalg.norm(x, axis=1)[:, None], n
            n += len(x)
        self.n = n


def _angles(unit: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The angles to all pivots, the home of each row, and its angle."""
    angle = np.arccos(np.clip(unit @ pivots.T, -1, 1))
    home = angle.argmin(axis=1)
    return angle, home, angle[np.arange(len(unit)), home]


def _near_pivots(unit: np.ndarray, pivots: np.ndarray, radius: np.ndarray, turn: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The home of each row, and (row, pivot) for its home and all smaller pivots that may be home to a vector within `turn`."""
    angle, home, near = _angles(unit, pivots)
    reach = np.minimum(near[:, None] + 2 * turn, radius[None, :] + turn) + SLACK
    return home, *np.nonzero((angle <= reach) & (np.arange(len(pivots)) <= home[:, None]))


def _send(pivots: Pivots, radius: np.ndarray, turn: float, parts: dict[int, int]):
    """Rows for each pivot, by part: homes go to one part, the others to all parts."""

    def scan(batches):
        for whole in batches:
            for d, batch in _by_length(whole):
                rep, first = batch.column("rep").to_numpy(), pivots.first[d]
                home, row, at = _near_pivots(_units(batch.column("e")), pivots.of[d], radius[first : first + len(pivots.of[d])], turn)
                home, at = home + first, at + first
                n_parts = np.array([parts.get(int(p), 1) for p in at])
                part = np.concatenate([np.arange(k) for k in n_parts])
                row, at, n_parts = np.repeat(row, n_parts), np.repeat(at, n_parts), np.repeat(n_parts, n_parts)
                visits = (home[row] != at) | (part != rep[row] % n_parts)
                for k in range(0, len(row), SENT):
                    i = slice(k, k + SENT)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(at[i].astype(np.int64) << 32 | part[i]), pa.array(rep[row[i]]), batch.column("m").take(pa.array(row[i])), pa.array(visits[i]), pa.array(home[row[i]].astype(np.int32)), batch.column("e").take(pa.array(row[i]))],
                        names=["spot", "rep", "m", "visits", "home", "e"],
                    )

    return scan


class _Rows(Tile):
    def __init__(self, rep, m, home, visits, unit):
        super().__init__(unit)
        self.rep, self.m, self.home, self.visits = rep, m, home, visits


def _compare(threshold: float):
    """Rows come sorted by spot, a spot's homes first, by rep: these are held, all others pass by in tiles."""

    def scan(batches):
        spot, homes = None, []
        for batch in batches:
            spots = batch.column("spot").to_numpy()
            starts = np.flatnonzero(np.r_[True, spots[1:] != spots[:-1]]) if len(spots) else []
            for s, e in zip(starts, [*starts[1:], len(spots)]):
                if spots[s] != spot:
                    spot, homes = spots[s], []
                for lo in range(s, e, TILE):
                    part = batch.slice(lo, min(TILE, e - lo))
                    columns = [*(part.column(c).to_numpy(zero_copy_only=False) for c in ("rep", "m", "home", "visits")), _units(part.column("e"))]
                    mine = int((~columns[3]).sum())
                    if mine:
                        homes.append(_Rows(*(c[:mine] for c in columns)))
                    if not homes:
                        continue
                    tile = homes[-1] if mine == len(part) else _Rows(*columns)
                    for held in homes:
                        yield from _pairs(held, tile, int(spot) >> 32, threshold)

    return scan


def _pairs(a: _Rows, b: _Rows, pivot: int, threshold: float):
    """Counts and stars of the links between homes `a` and rows `b` that are counted here."""
    i, j, _ = linked(a, b, threshold)
    # Each pair once: of one home, where the smaller row is at home; of two, at the smaller pivot, where no other is sent.
    keep = (b.home[j] != pivot) | (a.rep[i] < b.rep[j])
    i, j = i[keep], j[keep]
    if not len(i):
        return
    left, right = np.r_[a.rep[i], b.rep[j]], np.r_[b.m[j], a.m[i]]
    who, at = np.unique(left, return_inverse=True)
    label = np.arange(len(who))
    x, y = at[: len(i)], at[len(i) :]
    while True:
        before = label.copy()
        np.minimum.at(label, x, label[y])
        np.minimum.at(label, y, label[x])
        label = label[label]
        if (label == before).all():
            break
    yield pa.RecordBatch.from_arrays([pa.array(who), pa.array(who[label]), pa.array(np.bincount(at, weights=right).astype(np.int64))], names=["src", "dst", "links"])


def neighbours(reps: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(src, dst, links) over distinct vectors (rep, m, d, e): partial counts of src and a star edge to dst. d: length of e."""
    spark, none = reps.sparkSession, "src bigint, dst bigint, links bigint"
    counts = {r.d: r.n for r in reps.groupBy("d").agg(F.count("*").alias("n")).collect() if r.n > 1}  # one row a length
    if not counts:
        return spark.createDataFrame([], none)
    reps = reps.where(F.col("d").isin(list(counts)))
    total = sum(counts.values())
    wanted = {d: min(max(1, PIVOTS * n // total), max(1, int(2 * n**0.5))) for d, n in counts.items()}
    # A hash thins the rows first, so that each task sends a few of them.
    h = F.shiftrightunsigned(F.xxhash64("rep"), 11)
    limit = F.create_map(*(F.lit(x) for d, n in counts.items() for x in (d, int(min(1.0, 4 * wanted[d] / n) * (1 << 53)))))
    order = Window.partitionBy("d").orderBy(h, "rep")
    thin = reps.where(h < F.element_at(limit, F.col("d"))).withColumn("nth", F.row_number().over(order))
    drawn: dict[int, list] = {}
    for r in thin.where(F.col("nth") <= F.element_at(F.create_map(*(F.lit(x) for kv in wanted.items() for x in kv)), F.col("d"))).select("d", "e").collect():  # PIVOTS at most, and one a length
        drawn.setdefault(r.d, []).append(r.e)
    pivots, turn = Pivots(drawn, list(counts)), float(np.arccos(threshold))

    def homes(batches):
        for whole in batches:
            for d, batch in _by_length(whole):
                _, home, near = _angles(_units(batch.column("e")), pivots.of[d])
                at, where, count = np.unique(home, return_inverse=True, return_counts=True)
                far = np.zeros(len(at))
                np.maximum.at(far, where, near)
                yield pa.RecordBatch.from_arrays([pa.array(at + pivots.first[d], pa.int64()), pa.array(count, pa.int64()), pa.array(far)], names=["at", "n", "far"])

    at_home = reps.select("d", "e").mapInArrow(homes, "at bigint, n bigint, far double").groupBy("at").agg(F.sum("n").alias("n"), F.max("far").alias("far")).collect()  # one row a pivot at most
    parts = {r["at"]: -(-r["n"] // PART) for r in at_home}
    radius = np.full(pivots.n, -np.inf)
    for r in at_home:
        radius[r["at"]] = r["far"]
    kind = dict(reps.dtypes)["e"]
    sent = reps.mapInArrow(_send(pivots, radius, turn, parts), f"spot bigint, rep bigint, m bigint, visits boolean, home int, e {kind}")
    k = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return sent.repartition(k, "spot").sortWithinPartitions("spot", "visits", "rep").mapInArrow(_compare(threshold), none)


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for vectors (vec_id, embedding)."""
    sound = ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("embedding", lambda x: x != 0)
    rows = vectors.select("vec_id", "embedding", F.coalesce(sound, F.lit(False)).alias("sound"))
    key = [F.when(F.col("sound"), F.xxhash64("embedding")).alias("k1"), F.when(F.col("sound"), F.xxhash64(F.lit(1), "embedding")).alias("k2")]
    ids = rows.select(F.coalesce("vec_id", F.lit((1 << 63) - 1)).alias("v"), "vec_id", "embedding", *key)
    groups = stored(ids.where("k1 is not null").groupBy("k1", "k2").agg(F.min("v").alias("rep"), F.count("*").alias("m"), F.first("embedding").alias("e")), "vectors")
    # A node is the hash of the vector, since ids may repeat on different vectors.
    found = stored(neighbours(groups.select(F.col("k1").alias("rep"), "m", F.size("e").alias("d"), "e"), threshold), "vector-links")
    roots = components(found)
    counts = found.groupBy("src").agg(F.sum("links").alias("links"))
    linked_ = groups.select("k1", "k2", "rep", "m").join(counts, F.col("k1") == F.col("src"), "left").join(roots, F.col("k1") == F.col("node"), "left")
    linked_ = linked_.select("k1", "k2", "rep", (F.col("m") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "k1").alias("root"))
    least = linked_.groupBy("root").agg(F.min("rep").alias("least"))
    out = checkpointed(linked_.join(least, "root").select("k1", "k2", "n_links", "least"))
    joined = ids.drop("embedding").join(out, ["k1", "k2"], "left")
    component = F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.when(F.col("least") < (1 << 63) - 1, F.col("least")))
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each vector: its links, the smallest vec_id of its component, and whether it is that one."""
    return near_vectors(read(spark, sf_dir, "embeddings"))


OP7_SQL = r"""
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95),
r AS (WITH RECURSIVE c(x, y) AS (SELECT vec_id, vec_id FROM v UNION SELECT c.x, l.y FROM c JOIN l ON c.y = l.x)
      SELECT x, min(y) AS component_id FROM c GROUP BY x)
SELECT e.vec_id, (SELECT count(*) FROM l WHERE l.x = e.vec_id)::BIGINT AS n_links,
       coalesce(component_id, e.vec_id) AS component_id, e.vec_id = coalesce(component_id, e.vec_id) AS kept
FROM embeddings e LEFT JOIN r ON e.vec_id = r.x
"""
