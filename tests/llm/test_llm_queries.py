"""The registered queries over the smallest tables, against plain versions."""

import duckdb
import plain

from tabml.llm import queries


def rows_of(folder, table, columns):
    return duckdb.sql(f"SELECT {columns} FROM '{folder}/{table}.parquet'").fetchall()


def test_warc(spark, folder):
    got = [tuple(r) for r in queries.op1_warc(spark, folder).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()]
    assert sorted(got, key=repr) == plain.warc(rows_of(folder, "pages", "page_id, url, html"))


def test_packing(spark, folder):
    docs = rows_of(folder, "documents", "doc_id, text")
    plain.check_packing(docs, [tuple(r) for r in queries.op4_packing(spark, folder).collect()], queries.tokenizer_path())


def test_simhash(spark, folder):
    docs = rows_of(folder, "documents", "doc_id, text")
    got = sorted(tuple(r) for r in queries.op5_simhash(spark, folder).collect())
    assert got == sorted((d, f"{p:016x}", c) for d, p, c in plain.near_duplicates(docs))


def test_quality_rules(spark, folder):
    texts = dict(rows_of(folder, "documents", "doc_id, text"))
    got = queries.op7_quality_rules(spark, folder).collect()
    assert len(got) == len(texts)
    for r in got:
        own = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
        assert own == plain.base_rules(texts[r.doc_id])
        assert not (r.kept and r.base_failed)


def test_quality_rules_keep_good_documents(spark, folder):
    good = {d for d, q in rows_of(folder, "labels", "doc_id, quality") if q == 1}
    lost = [r.doc_id for r in queries.op7_quality_rules(spark, folder).where("not kept and not base_failed").collect()]
    assert not good & set(lost)


def test_licenses_find_every_notice(spark, folder):
    texts = dict(rows_of(folder, "documents", "doc_id, text"))
    got = {(r.doc_id, r.license): r for r in queries.op8_licenses(spark, folder).collect()}
    from tabml.llm.licenses import TEMPLATES
    for name in ("MIT-notice", "Apache-2.0-notice", "GPL-3.0-notice", "CC-BY-NC-4.0-notice"):
        holding = {d for d, t in texts.items() if TEMPLATES[name] in t}
        assert holding == {d for d, n in got if n == name}
        for d in holding:
            r = got[d, name]
            assert texts[d][r.begin:r.end] == TEMPLATES[name] and r.coverage == 1.0


def test_classifier_on_the_held_out_fold(spark, folder):
    folder = folder.replace("sf0.001", "sf0.01")        # the smallest table has too few labels to learn from and to measure on
    quality = dict(rows_of(folder, "labels", "doc_id, quality"))
    got = [r for r in queries.op10_quality_classifier(spark, folder).collect() if r.doc_id in quality]
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    held = [r for r in got if r.held_out]
    assert held and sum(r.predicted == quality[r.doc_id] for r in held) >= 0.95 * len(held)
