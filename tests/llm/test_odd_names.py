"""Extra columns whose names hold dots, blanks and backticks stay as they are."""

import corpus_pipeline
from tabml.llm import chat, mixing, quality_rules, queries, rule_ensemble, simhash, url_filter

ODD = {"a.b": "1", "two words": "2", "back`tick": "3", "text.x": "4"}


def with_odd(df):
    for name, value in ODD.items():
        df = df.selectExpr("*", f"'{value}' AS `{name.replace('`', '``')}`")
    return df


def check(df, rows=None):
    got = [r.asDict() for r in df.collect()]
    assert got and all({k: r[k] for k in ODD} == ODD for r in got)
    assert rows is None or len(got) == rows


def test_rows_keep_their_odd_columns(spark, folder):
    docs = with_odd(spark.read.parquet(f"{folder}/documents.parquet"))
    check(quality_rules.passing(docs))
    check(rule_ensemble.accepted(queries.quality_model(spark, folder), docs))
    check(mixing.mixed(docs))
    check(simhash.representatives(docs.limit(40)))
    pages = with_odd(spark.read.parquet(f"{folder}/pages.parquet"))
    rules = spark.createDataFrame(queries.URL_RULES, "host string, path string, verdict string")
    check(url_filter.judge(pages, rules), pages.count())


def test_chats_keep_their_odd_columns(spark, folder):
    rows = spark.read.parquet(f"{folder}/conversations.parquet")
    records = chat.records(rows)
    check(chat.format_chats(with_odd(records), records.columns[1:]), records.count())


def test_stages_take_odd_columns(spark, folder):
    docs = with_odd(spark.read.parquet(f"{folder}/documents.parquet")).limit(60)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        check(stage(spark, docs, folder))
