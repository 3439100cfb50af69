"""Token files: exact round trips, order, damage, and single documents."""

import glob
import os
import struct

import pytest
import zstandard

import plain

from tabml.llm import queries, shards, token_files

PATH = queries.tokenizer_path()


def wanted(docs, end=2):
    """[(id, start, n_tokens, crc, ids)] in order: ids ascending, NULL last; ties may come in any order."""
    ids = plain.token_ids([t for _, t in docs], PATH, end)
    rows, start = [], 0
    for (doc, _), own in sorted(zip(docs, ids), key=lambda r: (r[0][0] is None, r[0][0] or 0)):
        rows.append((doc, start, len(own), plain.crc(own), own))
        start += len(own)
    return rows


def rows_of(df):
    return [(r.id, r.start, r.n_tokens, r.ids_crc32, list(struct.unpack(f"<{r.n_tokens}I", r.ids))) for r in df.orderBy("start").collect()]


def test_query_equals_the_library(spark, folder):
    docs = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(tuple(r) for r in queries.op13_token_files(spark, folder).collect())
    assert got == sorted(r[:4] for r in wanted(docs))


DOCS = [(9, "Plain words, twice. Plain words!"), (-3, "ÀÉ ß <|endoftext|> x"), (0, ""), (4, None), (1 << 60, "token " * 5000), (5, "\n \t"), (2, "漢字 and émoji 🙂 and combinińg")]


@pytest.fixture(scope="module")
def small(spark):
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in DOCS], "doc_id long, text string, `none` string, `a.ids` int").repartition(3)
    return token_files.store(df, PATH)


def test_odd_texts(small):
    assert rows_of(token_files.read(small)) == wanted(DOCS)


def test_many_shards_give_the_same_rows(spark):
    docs = DOCS + [(i, f"word{i} " * (i % 7)) for i in range(10, 90)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    files = token_files.store(df, PATH, shard_bytes=400)
    names = files.manifest.orderBy("shard").collect()
    assert len(names) > 8 and rows_of(token_files.read(files)) == wanted(docs)
    at = 0
    for r in names:
        assert r.first_id == at
        at += r.ids


def test_repeated_ids_null_ids_and_repeated_rows(spark):
    docs = [(7, "same text here")] * 300 + [(7, f"other {i}") for i in range(20)] + [(None, "nobody")] * 40 + [(1, "first")]
    files = token_files.store(spark.createDataFrame(docs, "doc_id long, text string"), PATH, shard_bytes=2000)
    got = rows_of(token_files.read(files))
    assert [r[0] for r in got] == [1] + [7] * 320 + [None] * 40
    assert sorted(r[3] for r in got) == sorted(r[3] for r in wanted(docs))
    assert [r[1] for r in got] == [sum(r[2] for r in got[:i]) for i in range(len(got))]
    sizes = [r.documents for r in files.manifest.collect()]
    assert len(sizes) > 10 and max(sizes) < 60                       # one hot id is many files


def test_no_rows_and_one_row(spark):
    empty = token_files.store(spark.createDataFrame([], "doc_id long, text string"), PATH)
    assert empty.manifest.count() == 0 and token_files.read(empty).count() == 0 and token_files.index(empty).count() == 0
    one = token_files.store(spark.createDataFrame([(1, None)], "doc_id long, text string"), PATH)
    assert rows_of(token_files.read(one)) == wanted([(1, None)])


def test_single_documents_by_index(spark, small):
    told = {r.id: (r.start, r.n_tokens) for r in token_files.index(small).collect()}
    rows = {r[0]: r for r in wanted(DOCS)}
    assert told == {d: r[1:3] for d, r in rows.items()}
    asked = spark.createDataFrame([(4,), (1 << 60,), (77,), (4,)], "id long")
    assert rows_of(token_files.fetch(small, asked)) == [rows[4], rows[1 << 60]]


def test_a_frame_needs_only_dictionary_and_index(small):
    """The format as the module describes it, read by hand."""
    [name] = [r.name for r in small.manifest.collect()]
    folder = small.folder.removeprefix("file://").removeprefix("file:")
    with open(f"{folder}/{name}", "rb") as f:
        data = f.read()
    with open(f"{folder}/{small.dictionary}.zdict", "rb") as f:
        dictionary = f.read()
    assert data[:5] == data[-5:] == b"TIDS\x01" and data[5] == 2 and data[6:38].hex() == small.dictionary
    count, place, ids = struct.unpack("<3q", data[-29:-5])
    begins, before, keys = (struct.unpack(f"<{count}q", data[place + 8 * count * k:place + 8 * count * (k + 1)]) for k in range(3))
    rows = wanted(DOCS)
    unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))
    for i, (doc, start, n, crc, own) in enumerate(rows):
        raw = unpacker.decompress(data[begins[i]:(*begins, place)[i + 1]])
        assert (keys[i], before[i]) == (doc, start) and list(struct.unpack(f"<{n}H", raw)) == own
    assert ids == sum(r[2] for r in rows) and sum(data[place + 24 * count:place + 25 * count]) == 0


def test_damage_is_told(spark):
    files = token_files.store(spark.createDataFrame([(1, "some words")], "doc_id long, text string"), PATH)
    folder = files.folder.removeprefix("file://").removeprefix("file:")
    [name] = glob.glob(f"{folder}/*.zdict")
    with open(name, "ab") as f:
        f.write(b"x")
    with pytest.raises(Exception, match="damaged"):
        token_files.read(files).collect()
    assert os.path.exists(name)


def test_a_trained_dictionary_helps_short_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    files = token_files.store(docs, PATH)
    raw = token_files.read(files).selectExpr("sum(n_tokens) * 2").first()[0]
    assert len(token_files._dictionary(files.folder, files.dictionary)) > 1000
    assert files.manifest.selectExpr("sum(bytes)").first()[0] < 0.9 * raw + 25 * len(DOCS) + 25 * docs.count()


def test_borders_part_equal_bytes(spark):
    rows = spark.range(20_000).selectExpr("false none", "id % 50 key", "xxhash64(id) tie", "case when id % 100 = 0 then 5000 else 50 end size")
    borders = shards.byte_borders(rows, 100_000)
    sizes = rows.withColumn("shard", shards.shard_of(borders)("none", "key", "tie")).groupBy("shard").sum("size").collect()
    total = sum(r[1] for r in sizes)
    assert borders == sorted(set(borders)) and total / 100_000 <= len(sizes) <= 1.5 * total / 100_000 + 2 and max(r[1] for r in sizes) < 150_000
