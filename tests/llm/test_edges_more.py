"""Edge cases of the other operators."""

import gzip
import random

import plain
import pytest
from pyspark.sql import functions as F

from tabml.llm import chat, licenses, quality_rules, rule_ensemble, topk, url_filter, warc
from tabml.llm.files import open_folder

PAGES = "page_id long, url string, html string, digest string, shard int"


def pages(spark, rows):
    return spark.createDataFrame([(p, u, h, "d", 1) for p, u, h in rows], PAGES)


ODD_PAGES = [
    (5, "http://a/é ü\r\nX: y", "same"), (3, None, "same"), (9, "u", "same"), (3, None, "same"), (None, "n", "same"), (None, "n2", "alone"),
    (1, "u", None), (2, "u", ""), (7, "u", "\r\n\r\nWARC/1.1\r\n"), (8, "u", "é" * 300_000), (-4, "u", "minus"), (1 << 60, "u", "big"), ((1 << 60) + 1, "u", "big")]


@pytest.mark.parametrize("settings", [{}, {"shard_bytes": 50, "roll_bytes": 300}, {"min_revisit_bytes": 3}])
def test_archives_read_back(spark, settings):
    manifest, folder = warc.archive(pages(spark, ODD_PAGES), **settings)
    rows = warc.read(manifest, folder).collect()
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows), key=repr)
    assert got == plain.warc(ODD_PAGES, settings.get("min_revisit_bytes", 0))
    texts = sorted((r.page_id or 0, bytes(r.payload).decode()) for r in rows if r.record_type == "response" and r.page_id != 3)
    assert set(texts) <= {(p or 0, h or "") for p, _, h in ODD_PAGES}
    if "roll_bytes" in settings:
        assert manifest.count() > 3


def test_archives_are_equal_on_every_run_and_open_with_gzip(spark):
    contents = []
    for rows in (ODD_PAGES, ODD_PAGES[::-1]):
        manifest, folder = warc.archive(pages(spark, rows).repartition(4), shard_bytes=200_000, roll_bytes=1000)
        store, path = open_folder(folder)
        files = {r.name: store.open_input_stream(f"{path}/{r.name}", compression=None).read() for r in manifest.collect()}
        assert all(gzip.decompress(data).startswith(b"WARC/1.1\r\n") for data in files.values())
        assert not store.get_file_info(f"{path}/_temporary").is_file
        contents.append(files)
    assert contents[0] == contents[1]


def test_no_pages_no_files(spark):
    manifest, folder = warc.archive(pages(spark, []))
    assert manifest.count() == 0 and warc.read(manifest, folder).count() == 0


def plain_top(vectors, k):
    import math
    good = [(i, [math.floor(64 * x) for x in v]) for i, v in vectors if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, own in {(i, tuple(v)) for i, v in good if i is not None and i % 20 == 0}:
        scored = sorted((-sum(a * b for a, b in zip(own, v)), i is None, i or 0) for i, v in good if i != q)
        out += [(q, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(scored[:k])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("block,queries,k", [(4096, 1024, 20), (7, 2, 5), (1, 1, 3)])
def test_top_k_equals_all_scores(spark, monkeypatch, block, queries, k):
    monkeypatch.setattr(topk, "BLOCK", block)
    monkeypatch.setattr(topk, "QUERIES", queries)
    pick = random.Random(block)
    vectors = [(i, [pick.gauss(0, 0.3) for _ in range(8)]) for i in range(90)] + [(i, [0.5] * 8) for i in range(100, 130)]
    vectors += [(140, None), (141, [None] * 8), (142, [float("nan")] * 8), (143, [float("inf")] * 8), (160, []), (161, [1.0]), (180, [0.0] * 8),
                (None, [0.4] * 8), (20, vectors[20][1]), (0, [0.1] * 8), (200, [3e9] * 8), (201, [-3e9] * 8)]
    df = spark.createDataFrame([(i, v, 1, 1) for i, v in vectors], "vec_id long, embedding array<double>, rank int, block int")
    index = topk.build_index(topk.quantised(df, "vec_id", "embedding"), block)
    found = topk.search(index, topk.quantised(df.where("vec_id % 20 = 0"), "vec_id", "embedding"), k, queries)
    assert sorted((tuple(r) for r in found.collect()), key=repr) == plain_top(vectors, k)
    assert topk.exact_top_k(df.limit(0), df, "vec_id").count() == 0


def test_urls(spark):
    rules = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("b.net", "/", "block"), ("b.net", "/", "allow"), ("Case.ORG", "/X", "block"), ("org", "", "block")]
    urls = ["http://a.net/x", "https://www.EXAMPLE.net/en/1?q#f", "http://example.net/EN/", "http://net", "http://net/", "http://notnet/", "x", None, "",
            "a://b://c.net/", "http://q.case.org/Xy", "http://case.org/x", "http://org?x", "http://.net/a", "http://b.net//", "HTTP://é.org/ü", "://net/" + "z" * 100_000,
            "http://net\n/x"]
    df = spark.createDataFrame([(i, u, "old", "old") for i, u in enumerate(urls + urls[:3])], "page_id long, url string, host string, verdict string")
    listed = spark.createDataFrame(rules, "host string, path string, verdict string")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

    def told(url):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        end = min((rest.index(c) for c in "/?#" if c in rest), default=len(rest))
        host, tail = rest[:end].translate(lower), rest[end:]
        path = tail[:min((tail.index(c) for c in "?#" if c in tail), default=len(tail))]
        fits = [(len(h + p), len(h), h.translate(lower) + p, v) for h, p, v in rules
                if host and (host == h.translate(lower) or host.endswith("." + h.translate(lower))) and path.startswith(p)]
        best = max(fits, default=(0, 0, None, "allow"))
        return host, path, best[2], best[3]
    for r in url_filter.judge(df, listed).collect():
        assert (r.host, r.path, r.rule, r.verdict) == told(r.url), r.url
    assert url_filter.judge(df, listed.limit(0), default="block").where("verdict = 'block' and rule is null").count() == df.count()
    assert url_filter.judge(df.limit(0), listed).count() == 0


def test_bloom_filter_never_loses_a_key(spark):
    import numpy as np
    keys = spark.range(2000).select(F.col("id").cast("string").alias("key"))
    words = url_filter.build_filter(keys, "key")
    hashes = np.array([r[0] for r in spark.range(20000).select(F.xxhash64(F.col("id").cast("string"))).collect()])
    found = url_filter.probe(words, hashes)
    assert found[:2000].all() and found[2000:].mean() < 0.02
    assert len(url_filter.build_filter(keys, "key", max_bytes=640)) == 10


TURNS = "conv_id long, turn long, role string, text string, id string, layout string"


def test_chats_read_back(spark):
    odd = r"\### Assistant: </turn> ok <\/turn> <\\/turn> ### #### ##\# x" + "\n</turn>\n### User: : \\"
    rows = [(1, 1, "assistant", odd), (1, 0, "user", odd * 50), (2, 0, "system", odd), (2, 1, "user", None), (2, 2, "assistant", ""), (3, 0, "tool: x", odd),
            (3, 0, "tool: x", odd), (3, None, "</turn>", "late"), (4, 0, None, None), (5, 0, "assistant", "a"), (5, 1, "assistant", "<"), (5, 2, "Assistant", "/turn>"),
            (None, 0, "user", "no id"), (6, 0, "@user", ":\\ x: y"), (7, 0, "user", "hi"), (7, 1, "assistant", "x" * 200_000)] + [(8, i, "assistant", f"t{i}") for i in range(300)]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], TURNS)
    records = chat.records(df)
    done = chat.format_chats(records, records.columns[1:])
    got = done.select("id", chat.read_turns(F.col("formatted")).alias("turns"), chat.masked_text(F.col("formatted"), F.col("loss_spans")).alias("loss"), "layout").collect()
    assert {r.layout for r in got} == {"prompt", "instruction", "messages"} and len(got) == 9
    for r in got:
        own = sorted((turn is None, turn or 0, role or "", text or "") for conv, turn, role, text in rows if conv == r.id)
        assert [tuple(t) for t in r.turns] == [o[2:] for o in own]
        assert r.loss == "".join(o[3] for o in own if o[2] == "assistant")
    assert chat.format_chats(records.limit(0), records.columns[1:]).count() == 0


def test_layouts_are_told_by_their_paths(spark):
    df = spark.read.json(spark.sparkContext.parallelize([
        '{"k":1,"messages":[{"role":"user","content":"a"},{"role":"assistant","content":null}]}', '{"k":2,"prompt":"p","response":"r"}',
        '{"k":3,"instruction":"i","input":"n","output":"o"}', '{"k":4,"conversations":[{"from":"human","value":"h"},{"from":"gpt","value":"g"}]}',
        '{"k":5,"question":"q","answer":"a","system":"s"}', '{"k":6,"prompt":"p","completion":"c"}', '{"k":7,"prompt":"p"}', '{"k":8}',
        '{"k":9,"prompt":"p","response":"r","question":"q"}']))
    got = {r.k: (r.layout, [tuple(t) for t in r.turns] if r.turns is not None else None)
           for r in chat.canonical(df, [c for c in df.columns if c != "k"]).collect()}
    assert got == {
        1: ("messages", [("user", "a"), ("assistant", "")]), 2: ("prompt", [("user", "p"), ("assistant", "r")]),
        3: ("instruction", [("user", "i"), ("user", "n"), ("assistant", "o")]), 4: ("share", [("user", "h"), ("assistant", "g")]),
        5: ("question", [("system", "s"), ("user", "q"), ("assistant", "a")]), 6: ("completion", [("user", "p"), ("assistant", "c")]),
        7: (None, None), 8: (None, None), 9: (None, None)}


DOCS = "doc_id long, text string, stats string, n_words int, kept string, id string"
TEXTS = [None, "", " \n ", "one", "a b c d e " * 30, "x " * 2000, "the of and to a in is it with that " + "word " * 3, "l1 w\nl1 w\n\nl2\r\nl1 w\n l1 w", "é😀 # $$ |<>&%*",
         "\x0b\x0c a\tb\x1cc\u00a0d", " ".join(f"w{i % 700}" for i in range(20_000)), "a a a a a a", "p q r s t u p q r s t v q r s t u"]


def documents(spark, texts):
    return spark.createDataFrame([(i if i != 3 else None, t, "s", 1, "k", "i") for i, t in enumerate(texts)], DOCS)


def test_quality_rules_on_odd_texts(spark):
    df = documents(spark, TEXTS + TEXTS[4:6])
    got = sorted(tuple(r)[1:7] for r in quality_rules.assess(df).collect())
    assert got == sorted(plain.base_rules(t) for t in TEXTS + TEXTS[4:6])
    kept = quality_rules.assess(df).where("kept").count()
    assert quality_rules.passing(df).columns == df.columns and quality_rules.passing(df).count() == kept
    assert quality_rules.assess(df.limit(0)).count() == 0


def test_quality_rules_stay_out_of_python(spark):
    for df in (quality_rules.assess(documents(spark, TEXTS)), quality_rules.passing(documents(spark, TEXTS))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_classifier_without_or_with_one_class_of_labels(spark):
    df = documents(spark, TEXTS)
    for labels, low, high in (([], 0.5, 0.5), ([(1, 1), (2, 1), (4, None), (5, 7)], 0.7, 1.0)):
        model = rule_ensemble.fit(df, spark.createDataFrame(labels, "doc_id long, quality int"))
        rows = rule_ensemble.score(model, df).collect()
        assert len(rows) == len(TEXTS) and all(low <= r.score <= high for r in rows)
    assert rule_ensemble.score(model, df.limit(0)).count() == 0


def test_classifier_learns_rules(spark):
    good, bad = "the cat and the dog of this town", "### $$$ cat&&& dog%%% of|||"
    pick = random.Random(5)
    texts = [" ".join(pick.choices((good if i % 3 else bad).split(), k=30)) for i in range(300)]
    df = documents(spark, texts).withColumn("doc_id", F.coalesce("doc_id", F.lit(3)))
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(300)] * 2 + [(None, 1)], "doc_id long, quality int")
    model = rule_ensemble.fit(df, labels)
    assert model.rules and all((r.score >= 0.5) == (r.id % 3 > 0) for r in rule_ensemble.score(model, df).collect())
    kept = rule_ensemble.accepted(model, df)
    assert kept.columns == df.columns and {r.doc_id % 3 for r in kept.collect()} == {1, 2}
    few = rule_ensemble.sampled(df.select(F.col("doc_id").alias("doc"), "text"), labels, "doc_id", "quality", 50)
    assert 20 < few.count() < 90


def test_licenses_near_and_partial(spark):
    mit = licenses.TEMPLATES["MIT-grant"]
    words = mit.split()
    texts = [None, "", "free text " * 5000 + mit + " more " * 3000, mit.replace("obtaining a copy", "getting one copy"), " ".join(words[:8]),
             " ".join(words[: int(len(words) * 0.8)]), mit.upper(), mit + " x " + mit, "Released under the MIT license", "any license of the year"]
    df = spark.createDataFrame([(i, t, 1.0, 2) for i, t in enumerate(texts)], "doc_id long, text string, coverage double, begin int")
    got = {}
    for r in licenses.scan(df).collect():
        got.setdefault((r.id, r.license), []).append(r)
    assert set(got) == {(2, "MIT-grant"), (3, "MIT-grant"), (5, "MIT-grant"), (6, "MIT-grant"), (7, "MIT-grant"), (8, "MIT-notice")}
    assert texts[2][got[2, "MIT-grant"][0].begin:got[2, "MIT-grant"][0].end] == mit.rstrip(",")
    assert len(got[7, "MIT-grant"]) == 2 and got[3, "MIT-grant"][0].coverage < 1
    assert licenses.scan(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        licenses.scan(df, templates={"x": "two words"})
