"""Boolean, scored search over a DataFrame.

A Search is a tree of clauses; compiling it gives two columns, whether a row matches and how well. Filters and exclusions are
plain predicates, so they reach the scan; a score is computed only where it is used (no sort is given, or a least score is).

    match = all filters and musts, none of the exclusions, and at least `minimum` of the optional clauses
    score = sum over musts and over the optional clauses that match

Without clauses everything matches with score 1. `minimum` is by default 1 if there are only optional clauses, else 0. A null
never matches a positive clause and passes an exclusion.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text

#: Lists are cut to this length.
TERMS_MAX, INNER_MAX, SIZE = 65_536, 10_000, 10
K1, B = 1.2, 0.75


@dataclass
class Clause:
    kind: str
    key: str = ""
    value: object = None
    extra: object = None


@dataclass
class Hits:
    """rows in order, and the count of all that match, if asked for."""

    rows: DataFrame
    total: int | None = None


@dataclass
class Search:
    filters: list[Clause] = field(default_factory=list)
    musts: list[Clause] = field(default_factory=list)
    shoulds: list[Clause] = field(default_factory=list)
    nots: list[Clause] = field(default_factory=list)
    minimum: int | None = None
    least_score: float | None = None
    sorts: list[tuple[str, str]] = field(default_factory=list)
    after: list | None = None
    collapsed: tuple[str, tuple[str, ...]] | None = None
    inner: dict[str, tuple] = field(default_factory=dict)
    function: tuple[str, object] | None = None

    def _add(self, to: list[Clause], *clause) -> Search:
        to.append(Clause(*clause))
        return self

    # filters: they decide, and score nothing
    def filter_term(self, key, value):
        return self._add(self.filters, "term", key, value)

    def filter_terms(self, key, values):
        return self._add(self.filters, "terms", key, list(values)[:TERMS_MAX])

    def filter_range(self, key, lower_than="", greater_than=""):
        """greater_than <= key < lower_than; an empty string is no bound. The upper bound comes first."""
        return self._add(self.filters, "range", key, (lower_than, greater_than))

    def filter_match(self, key, value):
        return self._add(self.filters, "match", key, value)

    def filter_match_phrase(self, key, value):
        return self._add(self.filters, "phrase", key, value)

    def filter_exists(self, key):
        return self._add(self.filters, "exists", key)

    def filter_nested(self, path, body: Search, inner: Iterable[str] | None = None):
        if inner is not None:
            self.inner[path] = (body, tuple(inner))
        return self._add(self.filters, "nested", path, body)

    def filter_custom(self, body: Search):
        return self._add(self.filters, "custom", "", body)

    def filter_raw(self, clause: Column | str):
        return self._add(self.filters, "raw", "", clause)

    # musts: they decide, and score
    def must_term(self, key, value):
        return self._add(self.musts, "term", key, value)

    def must_terms(self, key, values):
        return self._add(self.musts, "terms", key, list(values)[:TERMS_MAX])

    def must_range(self, key, lower_than="", greater_than=""):
        return self._add(self.musts, "range", key, (lower_than, greater_than))

    def match_all(self):
        return self._add(self.musts, "all")

    def wild_card(self, key, pattern, boost: float = 1.0):
        """* for any characters, ? for one; the pattern in lower case, on the whole value."""
        return self._add(self.musts, "wildcard", key, pattern.lower(), boost)

    def has_child(self, children: DataFrame, key: str, parent_key: str, body: Search | None = None, mode: str = "none"):
        """Rows with a child that `body` matches; the children's scores by `mode`: none, min, max, sum or avg."""
        return self._add(self.musts, "child", key, body or Search(), (children, parent_key, mode))

    def with_parent_id(self, parent_key, value):
        return self._add(self.filters, "term", parent_key, value)

    # optional clauses
    def should_term(self, key, value):
        return self._add(self.shoulds, "term", key, value)

    def should_range(self, key, lower_than="", greater_than=""):
        return self._add(self.shoulds, "range", key, (lower_than, greater_than))

    def should_exists(self, key):
        return self._add(self.shoulds, "exists", key)

    def should_match(self, key, value):
        return self._add(self.shoulds, "match", key, value)

    def should_match_phrase(self, key, value):
        return self._add(self.shoulds, "phrase", key, value)

    def should_custom(self, body: Search):
        return self._add(self.shoulds, "custom", "", body)

    def should_raw(self, clause: Column | str):
        return self._add(self.shoulds, "raw", "", clause)

    def should_nested(self, path, body: Search, inner: Iterable[str] | None = None):
        if inner is not None:
            self.inner[path] = (body, tuple(inner))
        return self._add(self.shoulds, "nested", path, body)

    # exclusions
    def must_not_exists(self, key):
        return self._add(self.nots, "exists", key)

    def must_not_term(self, key, value):
        return self._add(self.nots, "term", key, value)

    def must_not_terms(self, key, values):
        return self._add(self.nots, "terms", key, list(values)[:TERMS_MAX])

    # the rest
    def minimum_should_match(self, n: int | str):
        self.minimum = int(n)
        return self

    def min_score(self, score: float):
        self.least_score = score
        return self

    def sort(self, key: str, order: str | None = None):
        """With an order, one more key; without, this key alone."""
        self.sorts = [*self.sorts, (key, order)] if order else [(key, "asc")]
        return self

    def search_after(self, *values):
        self.after = list(values)
        return self

    def collapse(self, key: str, *sources: str):
        self.collapsed = (key, sources)
        return self

    def function_score_random(self, seed: int | None = None):
        self.function = ("random", seed)
        return self

    def function_score_script(self, script: str):
        self.function = ("script", script)
        return self

    def body(self) -> dict:
        """The tree as plain data."""
        part = lambda c: {c.kind: {c.key or "_": c.value.body() if isinstance(c.value, Search) else str(c.value)}}
        out = {n: [part(c) for c in cs] for n, cs in (("filter", self.filters), ("must", self.musts), ("should", self.shoulds), ("must_not", self.nots)) if cs}
        return out | ({"minimum_should_match": self.minimum} if self.minimum is not None else {})

    def debug(self) -> str:
        return json.dumps(self.body(), indent=2, sort_keys=True)


#: field -> a function from its column to an array of tokens.
Analyzers = dict[str, Callable[[Column], Column]]


class Corpus:
    """Rows, how their text fields are analysed, and the statistics that scores need, gathered in one pass."""

    def __init__(self, rows: DataFrame, analyzers: Analyzers | None = None, tokens: dict[str, str] | None = None):
        """tokens: field -> a column that holds its tokens already."""
        self.rows, self.analyzers, self.tokens = rows, analyzers or {}, tokens or {}
        self.stats: dict[tuple, float] = {}

    def tokens_of(self, key: str) -> Column:
        if key in self.tokens:
            return F.col(self.tokens[key])
        return self.analyzers.get(key, text.tokens_standard)(F.col(key))

    def analyse(self, key: str, value: str) -> list[str]:
        """A query string's tokens, as the field's own are made; one row, computed by the same expression."""
        fn = self.analyzers.get(key, text.tokens_standard)
        return list(self.rows.sparkSession.range(1).select(fn(F.lit(value))).first()[0] or [])

    def gather(self, wanted: set[tuple]) -> None:
        """wanted: (field, token or None, is text). Counts of rows with each token, and mean lengths."""
        wanted = sorted(wanted - set(self.stats), key=str)
        if not wanted:
            return
        columns = [F.count(F.lit(1)).alias("n")]
        for i, (key, token, is_text) in enumerate(wanted):
            if is_text and token is None:
                columns.append(F.avg(F.size(self.tokens_of(key))).alias(f"c{i}"))
            else:
                has = F.array_contains(self.tokens_of(key), token) if is_text else F.col(key) == F.lit(token)
                columns.append(F.count(F.when(has, 1)).alias(f"c{i}"))
        row = self.rows.agg(*columns).first()
        self.stats[("n",)] = row["n"]
        for i, w in enumerate(wanted):
            self.stats[w] = row[f"c{i}"] or 0

    def idf(self, key: str, token, is_text: bool) -> float:
        n, df = self.stats[("n",)], self.stats[(key, token, is_text)]
        return math.log(1 + (n - df + 0.5) / (df + 0.5))

    def bm25(self, key: str, tokens: list[str], frequency: Column) -> Column:
        length = F.size(self.tokens_of(key))
        norm = K1 * (1 - B + B * length / F.lit(float(self.stats[(key, None, True)]) or 1.0))
        return F.lit(sum(self.idf(key, t, True) for t in tokens)) * frequency / (frequency + norm)


def _and(parts: list[Column]) -> Column:
    out = F.lit(True)
    for p in parts:
        out = out & p
    return out


def wildcard_regex(pattern: str) -> str:
    return "^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern) + "$"


class Compiler:
    def __init__(self, corpus: Corpus, scored: bool = True):
        self.corpus, self.scored = corpus, scored

    def needs(self, body: Search) -> set[tuple]:
        out: set[tuple] = set()
        for scoring, clauses in ((True, body.musts + body.shoulds), (False, body.filters + body.nots)):
            for c in clauses:
                if c.kind == "custom" and scoring:
                    out |= self.needs(c.value)
                elif scoring and c.kind == "term":
                    out.add((c.key, c.value, False))
                elif scoring and c.kind in ("match", "phrase"):
                    out |= {(c.key, t, True) for t in self.corpus.analyse(c.key, c.value)} | {(c.key, None, True)}
        return out

    def compile(self, body: Search) -> tuple[Column, Column]:
        if not (body.filters or body.musts or body.shoulds or body.nots):
            return F.lit(True), F.lit(1.0)
        safe = lambda p: F.coalesce(p, F.lit(False))
        # What is null does not pass a filter either, and a bare comparison can be pushed to the scan.
        filters = [self.clause(c, False)[0] for c in body.filters]
        musts = [self.clause(c, self.scored) for c in body.musts]
        shoulds = [self.clause(c, self.scored) for c in body.shoulds]
        nots = [safe(self.clause(c, False)[0]) for c in body.nots]
        least = body.minimum
        if least is None:
            least = 1 if shoulds and not (filters or musts) else 0
        parts = filters + [m for m, _ in musts] + [~n for n in nots]
        if least == 1 and shoulds:
            some = shoulds[0][0]
            for m, _ in shoulds[1:]:
                some = some | m
            parts.append(some)
        elif least > 0:
            parts.append(sum((safe(m).cast("int") for m, _ in shoulds), F.lit(0)) >= least)
        score = F.lit(0.0)
        for _, s in musts:
            score = score + s
        for m, s in shoulds:
            score = score + F.when(safe(m), s).otherwise(F.lit(0.0))
        return _and(parts), score

    def clause(self, c: Clause, scored: bool) -> tuple[Column, Column]:
        one, zero = F.lit(1.0), F.lit(0.0)
        col = F.col(c.key) if c.key else None
        if c.kind == "term":
            # A keyword's score is its rarity; length plays no part.
            return col == F.lit(c.value), F.lit(self.corpus.idf(c.key, c.value, False) / (1 + K1)) if scored else zero
        if c.kind == "terms":
            return (col.isin(c.value) if c.value else F.lit(False)), one
        if c.kind == "range":
            upper, lower = c.value
            parts = ([col >= F.lit(lower)] if lower != "" else []) + ([col < F.lit(upper)] if upper != "" else [])
            return _and([*parts, col.isNotNull()]), one
        if c.kind == "exists":
            return col.isNotNull(), one
        if c.kind == "all":
            return F.lit(True), one
        if c.kind == "raw":
            return (F.expr(c.value) if isinstance(c.value, str) else c.value), one
        if c.kind == "custom":
            return Compiler(self.corpus, scored).compile(c.value)
        if c.kind == "nested":
            return F.exists(col, lambda x: element_match(c.value, x)), one
        if c.kind == "wildcard":
            pattern = wildcard_regex(c.value)
            if c.key in self.corpus.analyzers or c.key in self.corpus.tokens:
                return F.exists(self.corpus.tokens_of(c.key), lambda t: t.rlike(pattern)), F.lit(float(c.extra))
            return col.rlike(pattern), F.lit(float(c.extra))
        if c.kind in ("match", "phrase"):
            words = self.corpus.analyse(c.key, c.value)
            tokens = self.corpus.tokens_of(c.key)
            if not words:
                return F.lit(False), zero
            query = F.array(*map(F.lit, words))
            if c.kind == "phrase":
                return text.match_phrase(tokens, query), self.corpus.bm25(c.key, words, text.phrase_count(tokens, words)) if scored else zero
            score = zero
            if scored:
                for t in words:
                    score = score + self.corpus.bm25(c.key, [t], text.phrase_count(tokens, [t]))
            return text.match_any(tokens, query), score
        if c.kind == "child":
            return F.col(_child_column(c)).isNotNull(), F.coalesce(F.col(_child_column(c)), zero)
        raise ValueError(c.kind)


def element_match(body: Search, x: Column) -> Column:
    """A body on the fields of an array's struct; keys may carry the path or not."""
    name = lambda key: key.rsplit(".", 1)[-1]
    safe = lambda p: F.coalesce(p, F.lit(False))

    def one(c: Clause) -> Column:
        if c.kind == "custom":
            return element_match(c.value, x)
        v = x[name(c.key)] if c.key else None
        if c.kind == "term":
            return v == F.lit(c.value)
        if c.kind == "terms":
            return v.isin(c.value)
        if c.kind == "exists":
            return v.isNotNull()
        if c.kind == "range":
            upper, lower = c.value
            return _and(([v >= F.lit(lower)] if lower != "" else []) + ([v < F.lit(upper)] if upper != "" else []) + [v.isNotNull()])
        if c.kind == "all":
            return F.lit(True)
        raise ValueError(f"{c.kind} is not known in nested fields")

    some = [safe(one(c)) for c in body.shoulds]
    least = body.minimum if body.minimum is not None else int(bool(some) and not (body.filters or body.musts))
    parts = [safe(one(c)) for c in body.filters + body.musts] + [~safe(one(c)) for c in body.nots]
    return _and(parts + ([sum((p.cast("int") for p in some), F.lit(0)) >= least] if least else []))


def _child_column(c: Clause) -> str:
    return f"_child_{id(c)}"


def _with_children(rows: DataFrame, body: Search) -> DataFrame:
    """Adds the children's scores that `body` asks for: one aggregate by parent, joined."""
    for c in body.musts:
        if c.kind == "child":
            children, parent_key, mode = c.extra
            match, score = compiled(Corpus(children), c.value, mode != "none")
            by = children.where(match).groupBy(F.col(parent_key).alias("_parent"))
            total = {"none": F.lit(1.0), "min": F.min(score), "max": F.max(score), "sum": F.sum(score), "avg": F.avg(score)}[mode]
            found = by.agg(total.alias(_child_column(c))) if mode != "none" else children.where(match).select(F.col(parent_key).alias("_parent")).distinct().withColumn(_child_column(c), F.lit(1.0))
            rows = rows.join(found, F.col(c.key) == F.col("_parent"), "left").drop("_parent")
    return rows


def compiled(corpus: Corpus, body: Search, scored: bool = True) -> tuple[Column, Column]:
    compiler = Compiler(corpus, scored)
    if scored:
        corpus.gather(compiler.needs(body))
    return compiler.compile(body)


def matching(corpus: Corpus | DataFrame, body: Search) -> DataFrame:
    """The rows that match, unscored."""
    corpus = corpus if isinstance(corpus, Corpus) else Corpus(corpus)
    columns = corpus.rows.columns
    return _with_children(corpus.rows, body).where(compiled(corpus, body, False)[0]).select(columns)


def ordering(sorts: Iterable[tuple[str, str]]) -> list[Column]:
    """Missing values come last either way."""
    return [F.col(k).desc_nulls_last() if o == "desc" else F.col(k).asc_nulls_last() for k, o in sorts]


def after_keys(sorts: list[tuple[str, str]], values: list) -> Column:
    """Rows behind `values` in the order of `sorts`, key by key."""
    out, same = F.lit(False), F.lit(True)
    for (k, o), v in zip(sorts, values):
        c = F.col(k)
        out = out | (same & ((c < F.lit(v)) if o == "desc" else (c > F.lit(v))))
        same = same & (c == F.lit(v))
    return F.coalesce(out, F.lit(False))


def search(corpus: Corpus | DataFrame, body: Search, id_key: str, size: int | None = SIZE, start: int = 0, sort: Iterable[str] = (), includes: Iterable[str] = (), track_total: bool = False) -> Hits:
    """Hits in order: by the sort keys ('field:dir', then the body's), or by score; ties by id. `_score` comes with scores.

    size 0 is the default size; without a size all hits come, in no order.
    """
    corpus = corpus if isinstance(corpus, Corpus) else Corpus(corpus)
    sorts = [(*s.rsplit(":", 1), "asc")[:2] for s in sort] + body.sorts
    scored = not sorts or body.least_score is not None
    match, score = compiled(corpus, body, scored)
    columns = corpus.rows.columns
    rows = _with_children(corpus.rows, body).where(match)
    for path, (inner, names) in body.inner.items():
        found = F.filter(F.col(path), lambda x: element_match(inner, x))  # noqa: B023
        rows = rows.withColumn(f"{path}_inner_hits", F.transform(found, lambda x: F.struct(*(x[n].alias(n) for n in names))) if names else found)  # noqa: B023
        columns = [*columns, f"{path}_inner_hits"]
    if scored:
        if body.function and body.function[0] == "random":
            score = (score + F.rand(body.function[1])) / 2
        elif body.function:
            score = score * F.expr(body.function[1])
        rows = rows.withColumn("_score", score)
        columns = [*columns, "_score"]
        if body.least_score is not None:
            rows = rows.where(F.col("_score") >= body.least_score)
    rows = rows.select(columns)
    order = (sorts or [("_score", "desc")]) + [(id_key, "asc")]
    if body.after is not None:
        rows = rows.where(after_keys(order, body.after))
    total = rows.count() if track_total else None
    if body.collapsed:
        rows = collapse(rows, body.collapsed[0], ordering(order), body.collapsed[1])
    rows = rows.orderBy(*ordering(order)).offset(start) if size is not None or start else rows
    rows = rows.limit(size or SIZE) if size is not None else rows
    return Hits(rows.select(*includes) if includes else rows, total)


def search_one(corpus, body: Search, id_key: str, **params) -> DataFrame:
    return search(corpus, body, id_key, **{**params, "size": 1}).rows


def top_k(rows: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group, with `rank`."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def collapse(rows: DataFrame, key: str, order: list[Column], sources: Iterable[str] = (), most: int = INNER_MAX) -> DataFrame:
    """The best row of each key, with the group's first `most` members (the chosen fields) as `inner_hits`."""
    names = tuple(sources) or tuple(c for c in rows.columns if c != key)
    ranked = top_k(rows, [key], order, most)
    member = F.struct(F.col("rank"), *(F.col(n) for n in names))
    groups = ranked.groupBy(F.col(key).alias("_key")).agg(F.min_by(F.struct(*rows.columns), "rank").alias("_best"), F.sort_array(F.collect_list(member)).alias("inner_hits"))
    return groups.select("_best.*", F.transform("inner_hits", lambda x: F.struct(*(x[n].alias(n) for n in names))).alias("inner_hits"))


def statistics(rows: DataFrame, fields: Iterable[str], body: Search | None = None, nested_path: str | None = None) -> DataFrame:
    """One row (field, count, min, max, avg, sum) a field, under a query; with a path, over its elements."""
    rows = matching(rows, body) if body else rows
    if nested_path:
        rows = rows.select(F.explode(nested_path).alias("_e")).select("_e.*")
    fields = list(fields)
    stats = [F.struct(F.lit(f).alias("field"), F.count(f).alias("count"), F.min(f).cast("double").alias("min"), F.max(f).cast("double").alias("max"), F.avg(f).alias("avg"), F.sum(f).cast("double").alias("sum")) for f in fields]
    return rows.agg(F.array(*stats).alias("s")).select(F.inline("s"))
