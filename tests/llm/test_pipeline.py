"""The pipeline against plain versions of its stages, on whole small tables."""

from __future__ import annotations

import corpus_pipeline as pipeline
from proofset.llm import packing, quality
from proofset.llm.common import documents
from tests.llm import test_exact_dedup, test_near_dedup, test_packing, test_pii


def test_stages(spark):
    d = "/root/testdata/sf0.001"
    docs = documents(spark, d)
    columns = docs.columns
    good = {r.doc_id for r in quality.query(spark, d).collect() if r.predicted == 1}
    texts = {r.doc_id: r.text for r in docs.collect()}
    steps = dict(pipeline.STAGES)
    assert list(steps) == ["quality", "exact_dedup", "near_dedup", "pii", "packing"]

    out = steps["quality"](spark, docs, d)
    kept = {r.doc_id: r.text for r in out.collect()}
    assert out.columns == columns and kept == {i: texts[i] for i in good}

    out = steps["exact_dedup"](spark, out, d)
    want = {i for i, _, _, stays, _ in test_exact_dedup.brute(list(kept.items())) if stays}
    kept = {r.doc_id: r.text for r in out.collect()}
    assert out.columns == columns and set(kept) == want

    out = steps["near_dedup"](spark, out, d)
    want = {i for i, _, _, stays in test_near_dedup.brute(list(kept.items())) if stays}
    kept = {r.doc_id: r.text for r in out.collect()}
    assert out.columns == columns and set(kept) == want

    out = steps["pii"](spark, out, d)
    clean = {r.doc_id: (r.text, r.n_chars) for r in out.collect()}
    assert out.columns == columns and set(clean) == set(kept)
    assert all(not test_pii.brute(t) and n == len(t) for t, n in clean.values())
    assert all(clean[i][0] == t for i, t in kept.items() if not test_pii.brute(t) and "-" not in t and not any(c.isdigit() for c in t))

    rows = steps["packing"](spark, out, d).collect()
    lengths = {}
    for r in rows:
        lengths[r.doc_id] = lengths.get(r.doc_id, 0) + r.length
    assert lengths == {i: len(test_packing.ids_of(t)) + 1 for i, (t, _) in clean.items()}
    assert len({r.sequence_id for r in rows}) == len(test_packing.plain_best_fit([r.length for r in rows], packing.CAPACITY))


def test_run(spark):
    d = "/root/testdata/sf0.001"
    assert pipeline.ORACLE_SQL is None and pipeline.run(spark, d).count() > 100
