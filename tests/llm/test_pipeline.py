"""The pipeline's stages, each against a plain version on its own input."""

import plain

import corpus_pipeline
from tabml.llm import mixing, quality_rules, queries, rule_ensemble
from tabml.session import materialize


def test_stages_one_by_one(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "quality classifier", "near duplicates", "mixing", "packing"]

    ruled = materialize(stages["quality rules"](spark, docs, folder), "t")
    kept = {r.id for r in quality_rules.assess(docs).where("kept").collect()}
    assert ruled.columns == columns and {r.doc_id for r in ruled.collect()} == kept and 0 < len(kept) < docs.count()

    scored = materialize(stages["quality classifier"](spark, ruled, folder), "t")
    model = queries.quality_model(spark, folder)
    want = {r.id for r in rule_ensemble.score(model, ruled).where(f"score >= {queries.THRESHOLD}").collect()}
    assert scored.columns == columns and {r.doc_id for r in scored.collect()} == want

    single = materialize(stages["near duplicates"](spark, scored, folder), "t")
    rows = [(r.doc_id, r.text) for r in scored.collect()]
    stay = {r.doc_id for r in single.collect()}
    assert single.columns == columns and single.count() == len(stay)
    assert stay == set(plain.similar_groups(rows, 0.8).values())

    mixed = materialize(stages["mixing"](spark, single, folder), "t")
    times = {r.id: r.taken // r.size for r in mixing.mix(single, whole_documents=True).collect() if r.size and r.taken}
    counted = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert mixed.columns == columns and counted == times

    pieces = stages["packing"](spark, mixed, folder)
    texts = {r.doc_id: r.text for r in single.collect()}
    ids = dict(zip(texts, map(len, plain.token_ids(texts.values(), queries.tokenizer_path()))))
    total = pieces.selectExpr("sum(length)", "count(distinct sequence_id)").first()
    tokens = sum(ids[d] * n for d, n in times.items())
    assert total[0] == tokens and tokens <= 2048 * total[1] <= 1.1 * tokens + 12 * 2048 * 8


def test_run_equals_the_stages(spark, folder):
    rows = corpus_pipeline.run(spark, folder)
    assert rows.columns[:3] == ["id", "start", "length"] and rows.count() > 100
