import re
from collections import defaultdict

from conftest import SMALL
from fixtures import empty, odd
from test_dedup_and_mix import _brute_components, _brute_lines

import corpus_pipeline
from factloom.llm import mixing, sentencepiece_viterbi, shared, toxicity


def test_stages_equal_brute_force(spark):
    """Each stage against a plain computation over what its predecessor kept."""
    docs = shared.table(spark, SMALL, "documents")
    model = toxicity.fit(docs, shared.table(spark, SMALL, "labels"))
    stages = dict(corpus_pipeline.STAGES)
    rows = docs.collect()
    scores = model.score([r.text for r in rows])
    kept = stages["toxicity"](spark, docs, SMALL)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r, s in zip(rows, scores, strict=True) if s < toxicity.THRESHOLD}

    lined = stages["line_dedup"](spark, kept, SMALL)
    want = _brute_lines([(r.doc_id, r.text) for r in kept.collect()])
    assert lined.columns == docs.columns and {r.doc_id: r.text or "" for r in lined.collect()} == {i: t for i, (_, t) in want.items()}

    single = stages["near_dedup"](spark, lined, SMALL)
    alike = _brute_components([(r.doc_id, r.text) for r in lined.collect()], 5, 80)
    assert single.columns == docs.columns and {r.doc_id for r in single.collect()} == {i for i, (_, c) in alike.items() if i == c}

    mixed = stages["mixing"](spark, single, SMALL)
    words, target = defaultdict(int), {r.source: r.target for r in mixing.mix(single).collect()}
    for r in mixed.collect():
        words[r.source] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
    assert mixed.columns == docs.columns and {s: int(t) for s, t in target.items() if t >= 1} == dict(words)

    codec = sentencepiece_viterbi.Codec(sentencepiece_viterbi.read_model(sentencepiece_viterbi.MODEL))
    coded = stages["sentencepiece"](spark, mixed, SMALL).collect()
    assert sorted((r.doc_id, r.ids) for r in coded) == sorted((r.doc_id, codec.encode(r.text).tolist()) for r in mixed.collect()) and all(r.round_trip for r in coded)


def test_run_applies_all_stages(spark):
    got = corpus_pipeline.run(spark, SMALL)
    assert got.columns == ["doc_id", "lang", "source", "ids", "n_tokens", "round_trip"] and got.count() > 100 and got.where("NOT round_trip").count() == 0


def test_stages_take_odd_rows_and_empty_tables(spark):
    for docs in (odd(spark), empty(spark)):
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SMALL)
        assert docs.columns == ["doc_id", "lang", "source", "ids", "n_tokens", "round_trip"]
