"""The pipeline against plain versions of its stages, and its stages on odd tables."""

from __future__ import annotations

import math

import corpus_pipeline
from tests.conftest import SF_SMALL
from tests.llm import plain


def test_pipeline_matches_plain_stages(spark, small):
    docs = {r.doc_id: r for r in small.orderBy("doc_id").collect()}
    kept = plain.kept_by_quality([(k, r.text, r.lang) for k, r in docs.items()], plain.Measures())
    texts = plain.lines_left({k: docs[k].text for k in docs if k in kept})
    groups = plain.near_groups({k: plain.fingerprint(t) for k, t in texts.items()})
    texts = {k: t for k, t in texts.items() if groups[k] == k}
    items = {r.item_id: r.text for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect()}
    held = {d for d, _ in plain.leaks(texts, items)}
    wanted = plain.mix([(k, t, docs[k].source) for k, t in texts.items() if k not in held])
    found = {r.doc_id: (r.size, r.source_size, r.target, r.taken) for r in corpus_pipeline.run(spark, SF_SMALL).collect()}
    assert found.keys() == wanted.keys()
    assert all(found[k][:2] == v[:2] and math.isclose(found[k][2], v[2]) and found[k][3] == v[3] for k, v in wanted.items())


def test_stages_on_odd_and_empty_tables(spark, odd, empty):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for docs in (odd, empty):
            out = stage(spark, docs, SF_SMALL)
            assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
            assert out.count() <= docs.count()
    assert corpus_pipeline.STAGES[-1][1](spark, empty, SF_SMALL).count() == 0
