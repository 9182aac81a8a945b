"""The pipeline's stages: each one's decisions, from its own input."""

import corpus_pipeline as p
from edgewalk.llm import mixing, secrets, simhash, toxicity
from edgewalk.llm.common import checkpointed, table


def test_stages(spark, tiny):
    docs = table(spark, tiny, "documents")
    model = toxicity.fit_toxicity(docs, table(spark, tiny, "labels"))
    bad = {r.doc_id for r in toxicity.score_toxicity(docs, model).where("predicted = 1").collect()}
    kept = checkpointed(p.drop_toxic(spark, docs, tiny))
    assert {r.doc_id for r in kept.select("doc_id").collect()} == {r.doc_id for r in docs.select("doc_id").collect()} - bad
    groups = {r.doc_id: r.component_id for r in simhash.near_copy_components(kept).collect()}
    once = checkpointed(p.drop_near_copies(spark, kept, tiny))
    assert sorted(r.doc_id for r in once.select("doc_id").collect()) == sorted(set(groups.values()))
    safe = checkpointed(p.redact_secrets(spark, once, tiny))
    assert secrets.scan_secrets(safe).where("exists(spans, s -> s.kind <> 'assign')").count() == 0
    mixed = checkpointed(p.mix_sources(spark, safe, tiny))
    assert mixed.columns == docs.columns and sorted(map(tuple, mixed.collect())) == sorted(map(tuple, safe.collect()))
    last = p.encode_pieces(spark, mixed, tiny).collect()
    assert len(last) == mixed.count() and all(r.n_ids == len(r.ids) for r in last)
    order = {r.row.doc_id: (r.source, r.slot, r.place) for r in mixing.scheduled(safe).collect()}
    assert {r.doc_id: (r.source, r.slot, r.place) for r in last} == order


def test_run(spark, tiny):
    out = p.run(spark, tiny)
    assert out.columns == ["doc_id", "source", "slot", "place", "ids", "n_ids"] and out.count() > 100
    assert len(p.STAGES) == 5
