"""The stages against plain versions of what they decide, and the whole run."""

import re

import corpus_pipeline
import pytest

from terravane.llm import quality


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


def test_stages_keep_the_columns(spark, docs):
    sf, here = "/root/testdata/sf0.001", docs
    for name, stage in corpus_pipeline.STAGES:
        before = here
        here = stage(spark, before, sf)
        ids = {r.doc_id for r in here.select("doc_id").collect()}
        assert ids <= {r.doc_id for r in before.select("doc_id").collect()}, name
        assert here.columns == (docs.columns if name != "sharding" else [*docs.columns, "shard", "slot"])
        texts = {(r.doc_id, r.text) for r in here.select("doc_id", "text").collect()}
        assert texts <= {(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()}


def test_quality_stage_agrees_with_the_scores(spark, docs):
    sf = "/root/testdata/sf0.001"
    good = {r.doc_id for r in quality.op2_quality_classifier(spark, sf).where("score >= 0.5").collect()}
    assert good == {r.doc_id for r in corpus_pipeline.quality_stage(spark, docs, sf).collect()}


def plain_near_dedup(rows):
    """The rows that stay, by brute force: (doc_id, text, ...) with one of each component at 0.8."""
    lower = lambda w: "".join(c.lower() if "A" <= c <= "Z" else c for c in w)
    words = [re.findall(r"[^\x20\x09-\x0D]+", r[1] or "") for r in rows]
    sets = [frozenset(tuple(map(lower, t[k : k + 5])) for k in range(max(1, len(t) - 4))) if t else frozenset() for t in words]
    distinct = sorted(set(sets), key=lambda s: (len(s), sorted(s)))
    label = {s: k for k, s in enumerate(distinct)}
    for a in distinct:
        for b in distinct:
            if label[a] != label[b] and 5 * len(a & b) >= 4 * len(a | b):
                low, high = sorted((label[a], label[b]))
                label = {s: low if x == high else x for s, x in label.items()}
    groups = {}
    for r, s in zip(rows, sets):
        groups.setdefault(label[s], []).append(r)
    return list(groups.values())


HARD = "doc_id long, text string, lang string, source string, n_chars long, row string, key string, root string, size string"


@pytest.fixture(scope="module")
def hard(spark, tmp_path_factory):
    """Nulls, empty and very long texts, ties, repeated rows and clashing names, with the other tables."""
    prose = lambda k, n: " ".join(f"w{(i * 7 + k) % 911}x{k}" for i in range(n))
    texts = [(1, None), (2, ""), (3, " \n"), (None, None), (None, prose(1, 60)), (None, prose(1, 60)), (4, prose(1, 60)), (5, prose(2, 40)), (5, prose(3, 40)), (5, prose(2, 40)), (5, prose(2, 40)), (6, prose(3, 41)), (7, "one"), (8, "ONE"), (9, prose(4, 400_000)), (10, prose(4, 400_000) + " end"), (None, prose(5, 30)), (None, prose(6, 30)), (11, prose(7, 30).replace(" ", "\n"))]
    rows = [(i, t, None if i == 7 else "en", None if n % 5 == 0 else f"s{n % 3}", None, "clash", "clash", "clash", "clash") for n, (i, t) in enumerate(texts)]
    at = str(tmp_path_factory.mktemp("hard"))
    spark.createDataFrame(rows, HARD).repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(1, prose(7, 12)), (2, None)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    spark.createDataFrame([(i, int(i != 7), 0) for i in range(12)] + [(None, 1, None)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at, rows


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_on_hard_rows(spark, hard, name, stage):
    at, rows = hard
    docs = spark.read.parquet(f"{at}/documents.parquet")
    got = stage(spark, docs, at)
    out = [tuple(r)[:9] for r in got.collect()]
    assert got.columns[:9] == docs.columns and set(out) <= set(rows)
    if "dedup" in name:
        groups = plain_near_dedup(rows)
        last = lambda r: (r[0] is None, r[0])
        assert len(out) == len(groups)
        for g in groups:
            least = min(map(last, g))
            assert sum(r in out for r in {r for r in g if last(r) == least}) == 1
    if "decontamination" in name:
        assert sorted(map(str, out)) == sorted(str(r) for r in rows if r[0] != 11)
    if "sharding" in name:
        assert sorted(map(str, out)) == sorted(map(str, rows))


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_on_empty_tables(spark, hard, name, stage):
    docs = spark.read.parquet(f"{hard[0]}/documents.parquet").limit(0)
    got = stage(spark, docs, hard[0])
    assert got.collect() == [] and got.columns[:9] == docs.columns


def test_near_dedup_stage_on_the_small_corpus(spark, docs):
    rows = [tuple(r) for r in docs.union(docs.limit(20)).collect()]
    kept = corpus_pipeline.near_dedup_stage(spark, docs.union(docs.limit(20)), "").collect()
    assert sorted(r.doc_id for r in kept) == sorted(min(r[0] for r in g) for g in plain_near_dedup(rows))


def test_run(spark):
    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    slots = {}
    for r in rows.collect():
        slots.setdefault(r.shard, []).append(r.slot)
    assert slots and all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_near_dedup_stage_finds_every_near_copy(spark):
    """Copies at a similarity of 0.8 to 0.9, and others just below, against brute force; fingerprints link few of them."""
    import numpy as np

    rng, texts = np.random.default_rng(5), []
    words = [f"w{i}" for i in range(3000)]
    for _ in range(60):
        one = list(rng.choice(words, 300))
        texts.append(one)
        for changed in (3, 6, 7):
            other = list(one)
            for at in rng.choice(300, changed, replace=False):
                other[at] = "changed"
            texts.append(other)
    texts += [["four", "words", "are", "one"], ["Four", "words", "are", "one"], [], ["a", "word"]]
    sets = [{tuple(w.lower() for w in t[k : k + 5]) for k in range(max(1, len(t) - 4))} if t else set() for t in texts]
    label = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if label[a] != label[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                label = [min(label[a], label[b]) if x in (label[a], label[b]) else x for x in label]
    rows = [(i, " ".join(t), "en", "s", len(t)) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = sorted(r.doc_id for r in corpus_pipeline.near_dedup_stage(spark, docs, "").collect())
    assert kept == sorted(set(label))
    assert 60 < len(kept) < 200


def test_near_dedup_stage_meets_at_anchors(spark, monkeypatch):
    """Sets whose fingerprints differ in three bits at most meet by the covering, and only there."""
    import numpy as np

    from terravane.llm import shingle_join

    rng, texts = np.random.default_rng(6), []
    for k in range(40):
        one = [f"w{i}" for i in rng.integers(0, 3000, 400)]
        texts += [one, [*one, "end"], ["start", *one, f"end{k}"]]
    prints = [shingle_join.fingerprint(shingle_join.shingles(" ".join(t).encode())) for t in texts]
    near = [(i, j) for k in range(40) for i in range(3 * k, 3 * k + 3) for j in range(i) if j >= 3 * k and (prints[i] ^ prints[j]).bit_count() <= 3]
    assert len({i // 3 for i, _ in near}) > 30
    label = list(range(len(texts)))
    for i, j in near:
        label = [min(label[i], label[j]) if x in (label[i], label[j]) else x for x in label]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    monkeypatch.setattr(shingle_join, "_meet", lambda batches: iter(()))  # nothing meets on shingles
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup_stage(spark, docs, "").collect()) == sorted(set(label))
    monkeypatch.undo()
    monkeypatch.setattr(shingle_join, "near_links", lambda prints, bits: spark.createDataFrame([], "src long, dst long"))
    assert {r.doc_id for r in corpus_pipeline.near_dedup_stage(spark, docs, "").collect()} > {3 * k for k in range(40)}


def test_the_driver_is_rid_of_steps_that_are_over(spark, monkeypatch):
    """While components are found in many rounds, the driver's garbage is collected, not only when its heap is full."""
    from terravane.llm import shared

    beans = spark.sparkContext._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    collected = lambda: sum(b.getCollectionCount() for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName())
    path = spark.createDataFrame([(i, i + 1) for i in range(64)], "src long, dst long")
    monkeypatch.setattr(shared, "TIDY_S", 0, raising=False)
    before = collected()
    assert {r.root for r in shared.components(path).collect()} == {0}
    assert collected() - before >= 5
    monkeypatch.setattr(shared, "TIDY_S", 3600)
    before = collected()
    shared.checkpointed(spark.range(10))
    assert collected() == before
