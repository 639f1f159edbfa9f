"""Personal data by weak supervision.

Strict rules find the base spans (email, ip, card, phone). A looser generator adds candidates: digit groups and addresses that
a rule let go, obfuscated addresses ("name (at) host (dot) tld"), and card and phone numbers that run into other digits or
lack a country code. On every candidate five labelers vote for, against or not at all: the strict rule, a checksum or range
test, a gazetteer (top-level domains, country calling codes, card number prefixes), the words just before, and the characters
around. All votes of the corpus are summed by pattern; expectation-maximisation over the patterns estimates each labeler's
reliability and gives each pattern a probability; these soft labels train the final span classifier, a logistic regression on
votes and form. A candidate that is no base span is added if its score is at least `LEAST`. Base spans always stay, and
nothing that is added overlaps them.

The patterns are bounded (kind, form and five votes of three values: under 4,000), so models are fitted on exact sums over the
whole corpus. Texts are scanned once, in place, never dealt out: the scan stores each document's few candidates, and both the
sums and the final choice are made from these. The words before a candidate are the last three within `NEAR` characters.

Defined cases: null text counts as empty; very long texts, also of digits, letters or signs alone, take time in proportion to
their length; rows that repeat or tie are returned each; a corpus without candidates has no model and adds nothing; no rows give
no rows; columns other than doc_id and text are not looked at. Positions are code points, end exclusive.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .shared import read, stored

KINDS = ("email", "ip", "card", "phone")
LEAST, VOTES = 0.7, 5
#: Forms: as the strict rule has it, or looser. NEAR: characters before a candidate in which words are looked for.
STRICT, LOOSE, NEAR = 0, 1, 30

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOOSE_HOST = re.compile(r" ?[A-Za-z0-9-]+(?: ?[(\[] ?dot ?[)\]] ?[A-Za-z0-9-]+|\.[A-Za-z0-9-]+)+")
_LOOSE_PHONE = re.compile(r"(?:(?<![0-9+])\+[0-9]{1,3}[ .-]?)?(?<![0-9])\(?[0-9]{3}\)?[ .-]{1,2}[0-9]{3}[ .-][0-9]{4}(?![0-9])")
_LOOSE_CARD = re.compile(r"(?<![0-9])[0-9]{4}([ -]?)[0-9]{4}\1[0-9]{4}\1[0-9]{3,4}(?![0-9])")
_AT = re.compile(r"[(\[] ?at ?[)\]]")

#: Top-level domains, country calling codes and words near personal data.
DOMAINS = frozenset("com org net edu gov mil int info biz io co me tv app dev example test de fr es it nl be at ch uk us ca au jp cn in br mx ru pl se no dk fi pt gr ie cz hu ro eu".split())
CALLING = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
CONTEXT = {
    "email": frozenset("email e-mail mail mailto contact write address courriel correo".split()),
    "ip": frozenset("ip address host server client from login addr adresse".split()),
    "card": frozenset("card visa mastercard amex credit debit carte tarjeta karte payment".split()),
    "phone": frozenset("phone tel telephone call mobile cell fax contact telefon teléfono téléphone".split()),
}
AGAINST = frozenset("version v release isbn issn doi order ref id no number section chapter hash token sha commit invoice".split())


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _emails(text: str):
    """Leftmost matches of the rule, found from each @ outwards: linear in the text."""
    at, end = text.find("@"), 0
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _HOST.match(text, at + 1)):
            yield start, m.end()
            end = m.end()
        at = text.find("@", at + 1)


def _loose_emails(text: str):
    """Obfuscated addresses, found from each "(at)" outwards."""
    end = 0
    for m in _AT.finditer(text):
        stop = m.start() - (text[m.start() - 1 : m.start()] == " ")
        start = stop
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if end <= start < stop and (host := _LOOSE_HOST.match(text, m.end())):
            yield start, host.end()
            end = host.end()


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _is_byte(part: str) -> bool:
    """Whether digits, of any number, stand for at most 255."""
    part = part.lstrip("0")
    return len(part) < 4 and int(part or "0") <= 255


def _shaped(text: str):
    """(kind, start, end, passes) for all matches of the rules' patterns."""
    for s, e in _emails(text):
        yield 0, s, e, True
    for m in _IP.finditer(text):
        yield 1, m.start(), m.end(), all(map(_is_byte, m.group().split(".")))
    for m in _CARD.finditer(text):
        d = _digits(m.group())
        yield 2, m.start(), m.end(), 14 <= len(d) <= 19 and luhn(d)
    for m in _PHONE.finditer(text):
        yield 3, m.start(), m.end(), 10 <= len(_digits(m.group())) <= 15


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the strict rules, in order of start, then kind."""
    return sorted(((k, s, e) for k, s, e, ok in _shaped(text) if ok), key=lambda x: (x[1], x[0]))


def candidates(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int, int]]]:
    """The base spans, and looser candidates (kind, start, end, form) that overlap none of them."""
    base, more = [], []
    for k, s, e, ok in _shaped(text):
        if ok:
            base.append((k, s, e))
        elif k != 2 or 13 <= len(_digits(text[s:e])) <= 19:
            more.append((k, s, e, STRICT))
    more += [(0, s, e, LOOSE) for s, e in _loose_emails(text)]
    more += [(3, m.start(), m.end(), LOOSE) for m in _LOOSE_PHONE.finditer(text)]
    shaped = {x[1:3] for x in more}
    more += [(2, m.start(), m.end(), LOOSE) for m in _LOOSE_CARD.finditer(text) if m.span() not in shaped]
    base.sort(key=lambda x: (x[1], x[0]))
    taken, free = sorted((s, e) for _, s, e in base), []
    i = 0
    for x in sorted(more, key=lambda x: x[1]):
        while i < len(taken) and taken[i][1] <= x[1]:
            i += 1
        if i == len(taken) or taken[i][0] >= x[2]:
            free.append(x)
    return base, free


def votes(text: str, kind: int, start: int, end: int, form: int, passes: bool) -> tuple[int, ...]:
    """-1, 0 or 1 from each labeler."""
    span, d = text[start:end], _digits(text[start:end])
    rule = 0 if form == LOOSE else 1 if passes else -1
    tail = re.split(r"[.\s\[\]()]+", span.rstrip(")] "))[-1].lower() if kind == 0 else ""
    if kind == 0:
        test = 1 if tail.isalpha() and 2 <= len(tail) <= 10 else -1
        listed = 1 if tail in DOMAINS else -1
    elif kind == 1:
        parts = span.split(".")
        test = 1 if all(len(p) < 4 and int(p) <= 255 for p in parts) else -1
        listed = -1 if any(len(p) > 1 and p[0] == "0" for p in parts) or parts[0] == "0" else 1
    elif kind == 2:
        test = 1 if luhn(d) else -1
        listed = 1 if d[0] in "3456" or d[:2] in ("22", "23", "24", "25", "26", "27") else -1
    else:
        test = 1 if 10 <= len(d) <= 15 and len(set(d)) > 2 else -1
        listed = 0 if form == LOOSE else 1 if any(d[:n] in CALLING for n in (1, 2)) else -1
    before = re.findall(r"[^\W\d_][\w-]*", text[max(0, start - NEAR) : start].lower())[-3:]
    near = 1 if CONTEXT[KINDS[kind]].intersection(before) else -1 if AGAINST.intersection(before) else 0
    left, right = text[start - 1 : start], text[end : end + 1]
    alone = -1 if left.isalnum() or right.isalnum() or left in ("+", "@", "_") else 1
    return rule, test, listed, near, alone


def code(kind: int, form: int, vote: tuple[int, ...]) -> int:
    n = kind * 2 + form
    for v in vote:
        n = n * 3 + v + 1
    return n


def decode(n: int) -> tuple[int, int, tuple[int, ...]]:
    vote = []
    for _ in range(VOTES):
        n, v = divmod(n, 3)
        vote.append(v - 1)
    return n // 2, n % 2, tuple(reversed(vote))


def coded(text: str):
    """The base spans; and (kind, start, end, pattern, whether base) of all candidates."""
    base, more = candidates(text)
    out = [(k, s, e, code(k, STRICT, votes(text, k, s, e, STRICT, True)), True) for k, s, e in base]
    return base, out + [(k, s, e, code(k, f, votes(text, k, s, e, f, False)), False) for k, s, e, f in more]


def reliabilities(patterns: list[int], counts: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """The probability that each pattern is personal data, and P(vote | label) by kind, labeler, label and vote."""
    kinds = np.array([decode(p)[0] for p in patterns])
    vote = np.array([decode(p)[2] for p in patterns]) + 1
    chance = 1 / (1 + np.exp(-(vote - 1).sum(axis=1) * 1.0))  # to start with, labelers count alike
    table = np.zeros((len(KINDS), VOTES, 2, 3))
    for _ in range(rounds):
        prior = np.zeros(len(KINDS))
        for k in range(len(KINDS)):
            w1, w0 = counts * chance * (kinds == k), counts * (1 - chance) * (kinds == k)
            prior[k] = (w1.sum() + 1) / (w1.sum() + w0.sum() + 2)
            for j in range(VOTES):
                for label, w in enumerate((w0, w1)):
                    seen = np.bincount(vote[:, j], weights=w, minlength=3)
                    # Labelers are taken to be better than chance: pseudo-counts lean that way.
                    lean = np.array([1.0, 1.0, 3.0]) if label else np.array([3.0, 1.0, 1.0])
                    table[k, j, label] = (seen + lean) / (seen.sum() + lean.sum())
        odds = np.log(prior / (1 - prior))[kinds]
        for j in range(VOTES):
            odds = odds + np.log(table[kinds, j, 1, vote[:, j]] / table[kinds, j, 0, vote[:, j]])
        chance = 1 / (1 + np.exp(-np.clip(odds, -50, 50)))
    return chance, table


def features(pattern: int) -> np.ndarray:
    kind, form, vote = decode(pattern)
    x = np.zeros(1 + len(KINDS) + 1 + 2 * VOTES)
    x[0], x[1 + kind], x[1 + len(KINDS)] = 1, 1, form
    for j, v in enumerate(vote):
        if v:
            x[2 + len(KINDS) + 2 * j + (v > 0)] = 1
    return x


def train(patterns: list[int], counts: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Weights of the span classifier, fitted to the soft labels of all candidates by Newton's method."""
    chance, _ = reliabilities(patterns, counts)
    x = np.array([features(p) for p in patterns])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        gradient = x.T @ (counts * (p - chance)) + ridge * w
        w = w - np.linalg.solve((x * (counts * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), gradient)
    return w


class Choice:
    """Which patterns of candidates are added as spans."""

    def __init__(self, weights: np.ndarray | None, least: float = LEAST):
        self.weights, self.limit, self.known = weights, float(np.log(least / (1 - least))), {}

    def __call__(self, pattern: int) -> bool:
        if pattern not in self.known:
            self.known[pattern] = self.weights is not None and bool(features(pattern) @ self.weights >= self.limit)
        return self.known[pattern]


def chosen(found: list[tuple], adds: Choice) -> tuple[list, list]:
    """Of candidates (kind, start, end, pattern, whether base): the base spans, and all spans, none added overlapping another."""
    base, added, end = [x[:3] for x in found if x[4]], [], -1
    for k, s, e, pattern, is_base in sorted(found, key=lambda x: x[1]):
        if not is_base and s >= end and adds(pattern):
            added.append((k, s, e))
            end = e
    return base, sorted(base + added, key=lambda x: (x[1], x[0]))


def spans(text: str, weights: np.ndarray | None, least: float = LEAST) -> tuple[list, list]:
    """The base spans, and all spans: those and what the classifier adds, none of which overlap."""
    return chosen(coded(text)[1], Choice(weights, least))


def scanned(docs: DataFrame) -> DataFrame:
    """(doc_id, found): five numbers for each candidate of a text: kind, start, end, pattern and whether it is a base span."""

    def scan(batches):
        for batch in batches:
            found = [[int(n) for x in coded(text)[1] for n in x] if text else [] for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.list_(pa.int64()))], names=["doc_id", "found"])

    return docs.select("doc_id", "text").mapInArrow(scan, "doc_id bigint, found array<bigint>")


def fit(rows: DataFrame) -> np.ndarray | None:
    """Weights learnt from every candidate in rows (found, as from scanned), or None if there is none."""
    at = F.sequence(F.lit(3), F.size("found") - 1, F.lit(5))
    each = rows.where(F.size("found") > 0).select(F.explode(F.transform(at, lambda i: F.get("found", i))).alias("pattern"))
    counted = each.groupBy("pattern").agg(F.count("*").alias("n")).orderBy("pattern").collect()  # under 4,000 rows
    return train([r.pattern for r in counted], np.array([r.n for r in counted], float)) if counted else None


def listed(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in found)


def personal_data(rows: DataFrame, weights: np.ndarray | None) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) for rows (doc_id, found); the counts are of base spans."""

    def scan(batches):
        adds = Choice(weights)
        for batch in batches:
            out = []
            for flat in batch.column("found").to_pylist():
                base, every = chosen(list(zip(*(flat[i::5] for i in range(5)))), adds)
                n = [0] * len(KINDS)
                for k, _, _ in base:
                    n[k] += 1
                out.append((*n, hashlib.sha256(listed(base).encode()).hexdigest(), listed(every)))
            columns = list(zip(*out)) if out else [[]] * 6
            kinds = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, kinds))], names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    return rows.mapInArrow(scan, "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string")


def masked(docs: DataFrame, weights: np.ndarray | None) -> DataFrame:
    """`docs` with every span replaced by its kind in angle brackets."""

    def scan(batches):
        adds = Choice(weights)
        for batch in batches:
            out = []
            for text in batch.column("text").to_pylist():
                if text:
                    parts, at = [], 0
                    for k, s, e in chosen(coded(text)[1], adds)[1]:
                        if s >= at:
                            parts += [text[at:s], f"<{KINDS[k]}>"]
                        at = max(at, e)
                    text = "".join([*parts, text[at:]])
                out.append(text)
            yield batch.set_column(batch.schema.get_field_index("text"), "text", pa.array(out, batch.schema.field("text").type))

    return docs.mapInArrow(scan, docs.schema)


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each document: counts and a hash of the base spans, and all spans."""
    rows = stored(scanned(read(spark, sf_dir, "documents")), "candidates")
    return personal_data(rows, fit(rows))
