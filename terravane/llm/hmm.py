"""Hidden Markov language model.

Tokens are white-space words with A-Z lower-cased, then one end token. A token belongs to a class that its last bytes decide
(short words are decided by the whole word); latent states emit classes, and a class emits its tokens by smoothed counts:

    P(text) = P(classes by the forward recursion) * product of (c + 0.5) / (N_g + 0.5 * (V_g + 1))

with c the token's count, N_g and V_g the tokens and distinct tokens of its class, all over the training documents; each class
keeps 0.5 for one unseen token, as the base model does for the whole vocabulary. Baum-Welch starts from a bounded sample of
training documents; then each full pass sums expected counts over all tokens of all training documents, partition by
partition, and adds them up. The likelihood of a text is exact: texts are cut into pieces only to be computed side by side,
and the pieces' K x K products, scaled, are chained.

Counts need no broadcast of the vocabulary: at most `HEAD` tokens can have a share of 1 / HEAD of all tokens, and only these
are broadcast; all others are dealt out by token and joined with their counts, and none of them can be a hot key. Long words are
known by a digest everywhere, so they are common or not like others.

Defined cases: null, empty and blank texts are the end token alone; very long texts and words are scored whole; rows that repeat or
tie are scored each, and all count in training; a null doc_id is in training and not held out; without training rows every count
is 0; no rows give no rows; columns other than doc_id and text are not looked at.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from .shared import read, stored, utf8

FOLD, FOLDS = 1, 5
#: States, classes, bytes that decide a class; tokens of a piece, and of a document that is not cut.
STATES, CLASSES, SUFFIX, PIECE, SHORT = 8, 4096, 4, 64, 768
#: Full passes; documents, characters of one (a piece drawn from it, if it is longer) and rounds for the start; the share that makes
#: a token common.
PASSES, START_DOCS, START_CHARS, START_ROUNDS, HEAD = 2, 400, 64_000, 12, 1 << 20
#: Bytes of text in one computation, and distinct tokens that a task counts before it passes them on.
BLOCK, COUNTED = 2_500_000, 500_000
END = CLASSES - 1


_SPACE = np.zeros(256, bool)
_SPACE[list(b" \t\n\x0b\x0c\r")] = True


def classes(texts: list[bytes], ends: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """The classes of the tokens of lower-case texts, one after another, and how many tokens each text has.

    ends: whether each text's end token is among them. A class is a hash of a word's last SUFFIX bytes.
    """
    data = np.frombuffer(b"".join([b"\n" * SUFFIX, *(x for t in texts for x in (t, b"\n"))]), np.uint8)
    word = ~_SPACE[data]
    last = np.flatnonzero(word[:-1] & ~word[1:])
    tail, inside = data[last].astype(np.uint64), np.ones(len(last), bool)
    for i in range(1, SUFFIX):
        inside &= word[last - i]
        tail |= np.where(inside, data[last - i], 0).astype(np.uint64) << np.uint64(8 * i)
    tail = tail * np.uint64(0x9E3779B97F4A7C15)
    found = ((tail ^ (tail >> np.uint64(29))) % np.uint64(END)).astype(np.int32)
    stop = SUFFIX + np.cumsum([len(t) + 1 for t in texts])
    upto = np.searchsorted(last, stop)
    sizes = np.diff(upto, prepend=0)
    return (np.insert(found, upto, END), sizes + 1) if ends else (found, sizes)


class Hmm:
    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit  # (K), (K, K), (CLASSES, K)

    @classmethod
    def first(cls, seed: int = 5) -> Hmm:
        rng = np.random.default_rng(seed)
        emit = rng.random((CLASSES, STATES)) + 0.2
        move = np.full((STATES, STATES), 0.1 / max(1, STATES - 1)) + np.eye(STATES) * 0.9
        return cls(np.full(STATES, 1 / STATES), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))

    @classmethod
    def of(cls, counts: np.ndarray) -> Hmm:
        """From expected counts: start, move and emit, one after another."""
        start, move, emit = np.split(counts[: STATES * (1 + STATES + CLASSES)], [STATES, STATES * (1 + STATES)])
        start, move, emit = start + 0.1, move.reshape(STATES, STATES) + 0.1, emit.reshape(CLASSES, STATES) + 0.02
        return cls(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


class Pieces:
    """The class sequences of some documents, one after another in `flat`, as pieces of at most `size` tokens, longest first; `obs` is (place, piece)."""

    def __init__(self, flat: np.ndarray, sizes: np.ndarray, size: int):
        self.sizes = sizes
        per = -(-self.sizes // size)
        self.first_of = np.cumsum(per) - per  # a document's first piece
        doc = np.repeat(np.arange(len(sizes)), per)
        nth = np.arange(len(doc)) - self.first_of[doc]
        begin = (np.cumsum(self.sizes) - self.sizes)[doc] + nth * size
        length = np.minimum(size, self.sizes[doc] - nth * size)
        self.order = np.argsort(-length, kind="stable")
        self.rank = np.empty_like(self.order)
        self.rank[self.order] = np.arange(len(doc))
        self.per, self.doc = per, doc[self.order]
        self.opening = nth[self.order] == 0
        self.length = length[self.order]
        at = np.arange(int(self.length[0]))[:, None] + begin[self.order]
        self.obs = flat[np.minimum(at, len(flat) - 1)]
        self.live = np.searchsorted(-self.length, -np.arange(len(self.obs)), "left")  # pieces longer than t

    def transfers(self, m: Hmm, emit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scaled K x K products of each piece, and the logarithms of the scales."""
        n = len(self.doc)
        x = np.broadcast_to(np.eye(STATES, dtype=m.move.dtype), (n, STATES, STATES)).copy()
        log = np.zeros(n)
        for t, c in enumerate(self.live):
            y = x[:c]
            step = (y.reshape(-1, STATES) @ m.move).reshape(c, STATES, STATES)
            if t == 0:
                step[self.opening[:c]] = y[self.opening[:c]]  # a document starts without a move
            step *= emit[t, :c, None, :]
            if t % 4 == 3 or t == len(self.live) - 1:
                scale = step.max(axis=(1, 2))
                step /= scale[:, None, None]
                log[:c] += np.log(scale)
            x[:c] = step
        return x, log

    def chained(self, m: Hmm, x: np.ndarray, log: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The natural logarithm of each document's likelihood, and the state weights before each piece."""
        before = np.zeros((len(self.doc), STATES), m.move.dtype)
        total = np.zeros(len(self.sizes))
        state = np.tile(m.start, (len(self.sizes), 1))
        docs = np.arange(len(self.sizes))
        for j in range(int(self.per.max())):
            docs = docs[self.per[docs] > j]
            piece = self.rank[self.first_of[docs] + j]
            before[piece] = state[docs]
            after = np.einsum("nk,nkl->nl", state[docs], x[piece])
            scale = after.sum(axis=1)
            state[docs] = after / scale[:, None]
            total[docs] += np.log(scale) + log[piece]
        return total, before

    def after(self, x: np.ndarray) -> np.ndarray:
        """The backward weights behind each piece."""
        out = np.ones((len(self.doc), STATES), x.dtype)
        weight = np.ones((len(self.sizes), STATES), x.dtype)
        for j in range(int(self.per.max()) - 1, -1, -1):
            docs = np.flatnonzero(self.per > j)
            piece = self.rank[self.first_of[docs] + j]
            out[piece] = weight[docs]
            back = np.einsum("nkl,nl->nk", x[piece], weight[docs])
            weight[docs] = back / back.max(axis=1, keepdims=True)
        return out

    def forward(self, m: Hmm, emit: np.ndarray, state: np.ndarray, alpha: np.ndarray | None) -> np.ndarray:
        """Scaled forward recursion within pieces from the weights before them; the logarithms of the scales."""
        ones, log = np.ones((STATES, 1), m.move.dtype), np.zeros(len(self.doc))
        for t, c in enumerate(self.live):
            step = state[:c] @ m.move
            if t == 0:
                step[self.opening] = state[self.opening]
            step *= emit[t, :c]
            scale = step @ ones
            step /= scale
            log[:c] += np.log(scale[:, 0])
            state = step
            if alpha is not None:
                alpha[t, :c] = step
        return log


def likelihoods(m: Hmm, flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """log10 of the probability of each class sequence. Short documents go side by side, long ones in pieces."""
    if sizes.max() <= SHORT:
        p = Pieces(flat, sizes, SHORT)
        total = p.forward(m, m.emit[p.obs], np.tile(m.start, (len(sizes), 1)), None)[p.rank]
    else:
        p = Pieces(flat, sizes, PIECE)
        total = p.chained(m, *p.transfers(m, m.emit[p.obs]))[0]
    return total / np.log(10)


def expected(m: Hmm, flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Expected counts of start, move and emit, then the log likelihood and the tokens. In single precision."""
    m = Hmm(*(x.astype(np.float32) for x in (m.start, m.move, m.emit)))
    short = sizes.max() <= SHORT
    p = Pieces(flat, sizes, SHORT if short else PIECE)
    emit = m.emit[p.obs]
    if short:
        total, before, behind = None, np.tile(m.start, (len(sizes), 1)), np.ones((len(sizes), STATES), np.float32)
    else:
        x, log = p.transfers(m, emit)
        total, before = p.chained(m, x, log)
        behind = p.after(x)
    alpha = np.zeros((*p.obs.shape, STATES), np.float32)
    log = p.forward(m, emit, before, alpha)
    total = log if total is None else total
    start, move = np.zeros(STATES), np.zeros((STATES, STATES))
    ones, beta, back_move = np.ones((STATES, 1), np.float32), behind, np.ascontiguousarray(m.move.T)
    live = np.zeros(p.obs.shape, bool)
    for t in range(len(p.live) - 1, -1, -1):
        c = p.live[t]
        live[t, :c] = True
        ahead = emit[t, :c] * beta[:c]
        gamma = alpha[t, :c] * beta[:c]
        gamma /= gamma @ ones
        back = ahead @ back_move
        if t:
            previous = alpha[t - 1, :c]
            move += (previous / ((previous * back) @ ones)).T @ ahead
        else:
            previous, inner = before[:c], ~p.opening[:c]
            move += (previous[inner] / ((previous[inner] * back[inner]) @ ones)).T @ ahead[inner]
            start += gamma[p.opening[:c]].sum(axis=0)
        alpha[t, :c] = gamma  # done with; now the state probabilities
        back /= back @ ones
        beta[:c] = back
    seen, gamma = p.obs[live], alpha[live]
    out = np.stack([np.bincount(seen, weights=gamma[:, k], minlength=CLASSES) for k in range(STATES)], axis=1)
    return np.concatenate([start, (move * m.move).ravel(), out.ravel(), [total.sum(), p.sizes.sum()]])


def blocks(texts):
    """(places, lower-case texts, class sequences, sizes) of bytes texts, about BLOCK bytes at a time; long documents apart."""

    def split(at, some):
        flat, sizes = classes(some)
        for part in (sizes <= SHORT, sizes > SHORT):
            which = np.flatnonzero(part)
            if len(which):
                yield at + which, [some[i] for i in which], flat[np.repeat(part, sizes)], sizes[which]

    held, size, at = [], 0, 0
    for text in texts:
        held.append(text.lower())
        size += len(text) + 1
        if size >= BLOCK:
            yield from split(at, held)
            at += len(held)
            held, size = [], 0
    if held:
        yield from split(at, held)


def key(word: bytes) -> bytes:
    """What stands for a word in tables: itself, or a digest if it is long (or looks like a digest). The end token is the empty key."""
    return word if len(word) <= 32 and word[:1] != b"\0" else b"\0" + xxhash.xxh3_128_digest(word)


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == FOLD, F.lit(False))


def token_counts(docs: DataFrame) -> DataFrame:
    """(tok, g, c): the key, class and count of each token over whole texts; counted in each task, then added up."""

    def rows(total: Counter, ends: int):
        toks, gs = [b"", *map(key, total)], np.r_[END, classes(list(total), False)[0]].astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(toks, pa.binary()), pa.array(gs), pa.array([ends, *total.values()], pa.int64())], names=["tok", "g", "c"])

    def scan(batches):
        total, ends = Counter(), 0
        for batch in batches:
            for text in utf8(batch.column("text")):
                total.update(text.lower().split())
                ends += 1
                if len(total) > COUNTED:
                    yield rows(total, ends)
                    total.clear()
                    ends = 0
        if ends:
            yield rows(total, ends)

    return docs.select("text").mapInArrow(scan, "tok binary, g int, c bigint").groupBy("tok", "g").agg(F.sum("c").alias("c"))


def train(docs: DataFrame, passes: int = PASSES) -> Hmm:
    """Baum-Welch over all of `docs`, from a start on a bounded sample."""
    # A hash thins the rows first, so that each task sends a few of them.
    h, n = F.xxhash64("doc_id", F.lit(3)), docs.count()
    thin = docs.where(F.shiftrightunsigned(h, 11) < int(min(1.0, 4 * START_DOCS / max(n, 1)) * (1 << 53)))
    begin = 1 + F.pmod(F.xxhash64("doc_id", F.lit(4)), F.greatest(F.lit(1), F.length("text") - START_CHARS + 1)).cast("int")
    piece = F.substr(F.coalesce("text", F.lit("")), F.coalesce(begin, F.lit(1)), F.lit(START_CHARS))
    texts = [r.text.encode() for r in thin.orderBy(h, "doc_id").limit(START_DOCS).select(piece.alias("text")).collect()]
    m = Hmm.first()
    for _ in range(START_ROUNDS if texts else 0):
        m = Hmm.of(sum(expected(m, flat, sizes) for _, _, flat, sizes in blocks(texts)))
    for _ in range(passes):

        def scan(batches, m=m):
            total = 0.0
            for _, _, flat, sizes in blocks(t for batch in batches for t in utf8(batch.column("text"))):
                total = total + expected(m, flat, sizes)
            if isinstance(total, np.ndarray):
                at = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["i", "v"])

        counts = np.zeros(STATES * (1 + STATES + CLASSES) + 2)
        for r in docs.select("text").mapInArrow(scan, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():  # one row a parameter
            counts[r.i] = r.v
        if counts.any():
            m = Hmm.of(counts)
    return m


def class_totals(counts: DataFrame) -> np.ndarray:
    """log10 of N_g + 0.5 * (V_g + 1) of each class."""
    total = np.full(CLASSES, 0.5)
    for r in counts.groupBy("g").agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect():  # one row a class
        total[r.g] += r.n + 0.5 * r.v
    return np.log10(total)


#: kind 0: a document with what its common tokens give; kind 1: another token of it and how often it occurs there.
_ROWS = "kind int, row bigint, doc_id bigint, n_tokens bigint, n_known bigint, known_score double, score double, tok binary, times bigint"


def _score(m: Hmm, common: dict[bytes, float], class_log: np.ndarray):
    def scan(batches):
        row = TaskContext.get().partitionId() << 40
        names = [x.split()[0] for x in _ROWS.split(", ")]
        for batch in batches:
            ids = batch.column("doc_id")
            for places, texts, flat, sizes in blocks(utf8(batch.column("text"))):
                k = len(sizes)
                score = likelihoods(m, flat, sizes) - np.add.reduceat(class_log[flat], np.cumsum(sizes) - sizes)
                # Every distinct token of every document, the end token among them.
                tokens, times, kinds = [], [], []
                for text in texts:
                    counted = Counter(text.split())
                    tokens.extend(map(key, counted)), tokens.append(b"")
                    times.extend(counted.values()), times.append(1)
                    kinds.append(len(counted) + 1)
                value = np.array(list(map(common.get, tokens)), np.float64)  # NaN for those that are not common
                of, times = np.repeat(np.arange(k), kinds), np.array(times)
                is_common = ~np.isnan(value)
                known = np.bincount(of[is_common], weights=times[is_common], minlength=k).astype(np.int64)
                known_score = np.bincount(of[is_common], weights=(value * times)[is_common], minlength=k)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.zeros(k, np.int32)), pa.array(np.arange(row, row + k)), ids.take(pa.array(places)), pa.array(sizes), pa.array(known), pa.array(known_score), pa.array(score), pa.nulls(k, pa.binary()), pa.nulls(k, pa.int64())],
                    names=names,
                )
                rest = np.flatnonzero(~is_common)
                n, none, no_score = len(rest), pa.nulls(len(rest), pa.int64()), pa.nulls(len(rest), pa.float64())
                toks = pa.array([tokens[i] for i in rest.tolist()], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(np.ones(n, np.int32)), pa.array(row + of[rest]), none, none, none, no_score, no_score, toks, pa.array(times[rest])], names=names)
                row += k

    return scan


def scores(docs: DataFrame) -> DataFrame:
    """The documents' scores by the model and by the unigram base, both learnt from those that are not held out."""
    training = docs.where(~held_out())
    counts = stored(token_counts(training), "token-counts")
    total, types = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    m, class_log = train(training), class_totals(counts)
    often = F.col("c") * HEAD >= total
    common = {bytes(r.tok): float(np.log10(r.c + 0.5)) for r in counts.where(often).select("tok", "c").collect()}  # at most HEAD
    rows = stored(docs.select("doc_id", "text").mapInArrow(_score(m, common, class_log), _ROWS), "token-rows")
    rest = counts.where(~often).select("tok", "c")
    found = rows.where("kind = 1").select("tok", "row", "times").join(rest, "tok", "left")
    more = found.groupBy("row").agg(F.sum(F.col("times") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("more"), F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("more_known"))
    joined = rows.where("kind = 0").select("row", "doc_id", "n_tokens", "n_known", "known_score", "score").join(more, "row", "left")
    words = F.col("known_score") + F.coalesce("more", F.lit(0.0))
    size = float(np.log10(total + 0.5 * (types + 1)))
    return joined.select(
        "doc_id", held_out().alias("held_out"), "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(total).cast("bigint").alias("train_tokens"),
        (words - F.col("n_tokens") * size).alias("base_score"), (words + F.col("score")).alias("score"),
    )


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each document: tokens, the base score and the log10 probability of the text under the model."""
    return scores(read(spark, sf_dir, "documents"))
