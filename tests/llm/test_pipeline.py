"""The pipeline against brute-force versions of its stages."""

import corpus_pipeline
from chainlake.llm import toxicity
from tests.llm.test_decontaminate import brute
from tests.llm.test_packing import ids
from tests.llm.test_simhash import below_broadcasts, brute_fingerprint, brute_roots, plans  # noqa: F401


def test_equals_brute_force(spark, small_dir):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    labels = spark.read.parquet(f"{small_dir}/labels.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{small_dir}/benchmark.parquet").collect()]
    rows = {r.doc_id: r.text for r in docs.collect()}
    model = toxicity.fit(docs, labels)
    scores, _, _ = toxicity.score_texts(model, [(t or "").encode() for t in rows.values()], toxicity.Emissions(model))
    left = {i: t for (i, t), s in zip(rows.items(), scores) if s < 0.5}
    assert 0 < len(left) < len(rows)
    fps = {i: brute_fingerprint(t) for i, t in left.items()}
    roots = brute_roots(list(fps), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 2)
    left = {i: t for i, t in left.items() if roots[i] == i}
    leaked = {r[0] for r in brute(list(left.items()), items)}
    assert leaked
    left = {i: t for i, t in left.items() if i not in leaked}
    got = corpus_pipeline.run(spark, small_dir).collect()
    length = {}
    for r in got:
        length[r.doc_id] = length.get(r.doc_id, 0) + r.length
    assert length == {i: len(ids(t or "")) + 1 for i, t in left.items()}


def test_stages_keep_columns(spark, small_dir):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, small_dir).columns == docs.columns, name
        assert stage(spark, docs.limit(0), small_dir).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), small_dir).count() == 0


def test_near_duplicate_stage_broadcasts_nothing_exploded(spark, small_dir, plans):  # noqa: F811
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    corpus_pipeline.remove_near_duplicates(spark, docs, small_dir).count()
    exploded = [p for p in plans if "Generate explode" in p]
    assert exploded and not any("Generate explode" in x for p in exploded for x in below_broadcasts(p))
