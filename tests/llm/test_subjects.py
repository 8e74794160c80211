"""Topic models: the parts of inference, held-out agreement with labels, and edge cases."""

import math

import numpy as np
import pytest

from spindrift.llm import subjects as S


def test_digamma():
    x = np.array([0.02, 0.5, 1.0, 3.3, 100.0])
    h = 1e-5
    want = [(math.lgamma(v + h) - math.lgamma(v - h)) / (2 * h) for v in x]
    assert S._digamma(x) == pytest.approx(want, rel=1e-5)


def test_tokeniser():
    t = S.Tokeniser()
    assert t("The <b>unit</b> is DRIFTING.\nNo 5").tolist() == [S.term_id("the"), S.term_id("unit"), S.term_id("drifting"), S.BREAK, S.BREAK]
    assert t("").tolist() == [] and t("... ?").tolist() == [S.BREAK, S.BREAK]
    assert S.term_id("unit") == S.Tokeniser()("Unit")[0] > 0


def test_document_frequencies(spark, monkeypatch):
    texts = ["spike spike unit. unit", "unit", "", "...", "probe spike"]
    rows = S.tokens(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(1))
    got = {r.id: r.n for r in S.document_frequencies(rows).collect()}
    assert got == {S.term_id("spike"): 2, S.term_id("unit"): 2, S.term_id("probe"): 1}


def test_lookup():
    rng = np.random.default_rng(1)
    for n in (1, 5, 2000):
        vocabulary = np.unique(rng.integers(1, 2**31, n)).astype(np.int32)
        ids = np.concatenate([vocabulary[::2], rng.integers(0, 2**31, 500).astype(np.int32)])
        at, there = S.Lookup(vocabulary)(ids)
        assert there.tolist() == [i in set(vocabulary.tolist()) for i in ids.tolist()] and (vocabulary[at[there]] == ids[there]).all()


def test_chunks_hold_whole_documents(monkeypatch):
    monkeypatch.setattr(S, "BATCH", 7)
    doc = np.repeat(np.arange(6), [3, 5, 1, 20, 2, 2])
    parts = list(S._chunks(doc))
    assert parts[0][0] == 0 and parts[-1][1] == len(doc) and all(b == c for (_, b), (c, _) in zip(parts, parts[1:], strict=False))
    assert all(doc[b - 1] != doc[b] for _, b in parts[:-1])
    assert list(S._chunks(doc[:0])) == []


def test_inference_separates_topics():
    weights = np.full((2, 6), 0.01, np.float32)
    weights[0, :3] = weights[1, 3:] = 0.3
    phi, gamma = S.infer(weights, np.array([0, 1, 2, 3, 4, 5, 0, 4]), np.array([1, 1, 1, 1, 5, 1, 1, 1]), np.array([0, 3, 6]))
    assert phi[0, 0] > 0.9 and phi[4, 1] > 4.5 and gamma[0, 0] > 2.7 and gamma[1, 1] > 6.3 and abs(gamma[2].sum() - 2) < 1e-4


def tables(spark, folder):
    return [spark.read.parquet(f"{folder}/{name}.parquet") for name in ("documents", "subject_areas", "doc_labels")]


def agreement(rows, labels):
    """F1 of found subjects against labels, over the labelled documents."""
    found, want = {}, {}
    for r in rows:
        found.setdefault(r.doc_id, set()).add(r.subject)
    for r in labels.collect():
        want.setdefault(r.doc_id, set()).add(r.subject)
    both = sum(len(found.get(i, set()) & s) for i, s in want.items())
    return 2 * both / (sum(map(len, want.values())) + sum(len(found.get(i, set())) for i in want))


def test_agreement_with_labels_that_were_held_out(spark, small):
    documents, areas, labels = tables(spark, small.replace("sf0.001", "sf0.1"))
    told, held_out = labels.where("pmod(xxhash64(doc_id), 2) = 0"), labels.where("pmod(xxhash64(doc_id), 2) = 1")
    rows = S.subjects(documents, areas, told).collect()
    assert all(0 < r.n_about <= r.n_sentences and r.share == pytest.approx(r.n_about / r.n_sentences) for r in rows)
    assert agreement(rows, held_out) > 0.93
    # without a fit the same start and the same map are worse
    tokens = S.written(S.tokens(documents), "test-tokens")
    begun, _ = S.fit(tokens, areas, told, rounds=0)
    assert agreement(S.assign(tokens, begun).collect(), held_out) < agreement(rows, held_out) - 0.05
    terms = S.topic_terms(documents, areas, told).collect()
    assert {r.subject for r in terms} == {r.subject for r in areas.collect()} | {None} and all(r.term for r in terms)


def test_subjects_come_from_the_table(spark, small):
    documents, areas, labels = tables(spark, small.replace("sf0.001", "sf0.01"))
    renamed = lambda df: df.where("subject <> 'anatomy'").replace("software", "code", "subject")
    found = {r.subject for r in S.subjects(documents, renamed(areas), renamed(labels)).select("subject").distinct().collect()}
    assert found == {r.subject for r in renamed(areas).collect()}
    assert {r.subject for r in S.subjects(documents, areas.limit(0), labels).collect()} == set()
    alone = {r.subject for r in S.subjects(documents, areas).select("subject").distinct().collect()}
    assert alone and alone <= {r.subject for r in areas.collect()}


def test_sums_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(S, "BLOCK", 3)
    monkeypatch.setattr(S, "SALTS", 2)

    def add(total, batch):
        for i in batch.column(0).to_pylist():
            total[i % 10] += [1, i]

    got = S._sum_over(spark.range(0, 1000, 1, 9), 10, 2, add)
    assert got.tolist() == [[100, sum(range(i, 1000, 10))] for i in range(10)]
    assert S._sum_over(spark.range(0), 10, 2, add).tolist() == [[0, 0]] * 10


def test_groups_of_terms(monkeypatch):
    monkeypatch.setattr(S, "GROUPS", 6)
    monkeypatch.setattr(S, "WIDE_GROUP", 0.3)
    rng = np.random.default_rng(3)
    middles = rng.choice([-1.0, 1.0], (6, S.PROFILE))
    profiles = np.repeat(middles, 20, axis=0) + rng.normal(0, 0.2, (120, S.PROFILE))
    groups = S.anchors(profiles, np.full(120, 500.0))
    assert {frozenset(g // 20) for g in groups} == {frozenset([k]) for k in range(6)}
    assert S.anchors(profiles[:0], np.empty(0)) == []


def test_edges(spark, small):
    _, areas, labels = tables(spark, small)
    schema = "doc_id bigint, text string, subject string, ids string"
    anatomy = "The thalamic nucleus was stained near the midline. "
    docs = [(1, anatomy * 4, "x", "y"), (1, anatomy * 4, "x", "y"), (2, None, "x", "y"), (3, "", "x", "y"), (4, "!!! ... 12", "x", "y"), (None, anatomy * 4, "x", "y"), (5, anatomy * 3000, "x", "y"), (6, "Cake and coffee were served at noon outside.", "x", "y")]
    df = spark.createDataFrame(docs, schema)
    rows = S.subjects(df, areas, labels).collect()
    assert {r.doc_id for r in rows} <= {1, 5, 6}
    assert S.subjects(df.limit(0), areas, labels).collect() == [] and S.subjects(df.where("doc_id IN (2, 3, 4)"), areas, labels).collect() == []
    assert S.topic_terms(df.limit(0), areas, labels).collect() == []
    odd = spark.createDataFrame([(None, "anatomy"), (1, None), (1, "no such subject"), (99, "anatomy"), (1, "anatomy"), (1, "anatomy")], "doc_id bigint, subject string")
    assert {r.doc_id for r in S.subjects(df, areas, odd).collect()} <= {1, 5, 6}
