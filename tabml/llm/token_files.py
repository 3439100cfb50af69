"""Files of token ids, each document compressed alone with a dictionary that all share.

A file (``.tids``) is: header (magic, bytes per id, SHA-256 of the dictionary), one zstandard frame per
document, then the index: begin of each frame, ids before each document in the file, document ids and which
of them are NULL, as little-endian arrays; last the number of documents, the index's place and the magic.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabml.llm.files import open_folder
from tabml.llm.packing import WordIds, slices
from tabml.llm.shards import byte_borders, tie
from tabml.session import materialize, scratch_path

MAGIC = b"TIDS\x01"
HEADER = len(MAGIC) + 1 + 32
#: bytes of text per shard (a file, written by one task); each document counts some bytes more
SHARD_BYTES, ROW_BYTES = 64 << 20, 64
#: the dictionary learns from about so many bytes of texts that a hash picks, none of them longer than SAMPLE_TEXT
SAMPLE_BYTES, SAMPLE_TEXT, DICTIONARY_BYTES = 4 << 20, 1 << 16, 112 << 10
LEVEL = 3
#: bytes of ids that are sent on at once, bytes of a file that are read at once
BATCH_BYTES, READ_BYTES = 4 << 20, 4 << 20


@dataclass(frozen=True)
class TokenFiles:
    """A folder of token files: ``manifest`` has a row per file (name, shard, documents, ids, first_id, bytes, digest)."""

    folder: str
    manifest: DataFrame
    dictionary: str
    width: int


def _serialized(ids, width: int) -> bytes:
    return ids.astype(f"<u{width}").tobytes()


def _encoder(path: str, end: int, width: int, borders: list):
    """(none, key, tie, shard, ids) from (none, key, tie, text)."""
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        words = WordIds(path)
        for batch in batches:
            shards = pa.array([bisect_right(borders, row) for row in zip(*(c.to_pylist() for c in batch.columns[:3]))], pa.int32())
            texts = batch.column(3).cast(pa.large_string())
            for a, b in slices(texts):
                ids = pa.array([_serialized(x, width) for x in words.encode(texts[a:b], end)], pa.binary())
                yield pa.RecordBatch.from_arrays([*(c[a:b] for c in batch.columns[:3]), shards[a:b], ids], ["none", "key", "tie", "shard", "ids"])
    return run


def _trainer(path: str, end: int, width: int, size: int):
    """One row with the dictionary, from the sample's texts."""
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import zstandard

        words, samples = WordIds(path), []
        for batch in batches:
            texts = batch.column(0).cast(pa.large_string())
            samples += [_serialized(x, width) for a, b in slices(texts) for x in words.encode(texts[a:b], end)]
        try:
            data = zstandard.train_dictionary(size, samples).as_bytes()
        except (zstandard.ZstdError, ValueError):              # too few samples: their bytes are the dictionary
            data = b"".join(samples)[-size:]
        yield pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], ["dictionary"])
    return run


def _compressor(data: bytes):
    import zstandard
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(data) if len(data) > 8 else None)


def _decompressor(data: bytes):
    import zstandard
    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data) if len(data) > 8 else None)


class _File:
    """A file under a name of this attempt's own: what lost attempts leave is never named in a manifest."""

    def __init__(self, folder: str, shard: int, width: int, dictionary: str):
        import hashlib
        import uuid
        from array import array

        self.store, self.path = open_folder(folder)
        self.shard, self.name = shard, f"part-{shard:06d}-{uuid.uuid4().hex}.tids"
        self.out, self.digest, self.size, self.ids = self.store.open_output_stream(f"{self.path}/{self.name}", compression=None), hashlib.sha256(), 0, 0
        self.begins, self.before, self.keys, self.nones = array("q"), array("q"), array("q"), array("b")
        self._put(MAGIC + bytes([width]) + bytes.fromhex(dictionary))

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.digest.update(data)
        self.size += len(data)

    def add(self, none: bool, key: int, count: int, frame: bytes) -> None:
        for column, value in ((self.begins, self.size), (self.before, self.ids), (self.keys, key), (self.nones, none)):
            column.append(value)
        self._put(frame)
        self.ids += count

    def close(self) -> tuple:
        import numpy as np

        count, place = len(self.begins), self.size
        for column in (self.begins, self.before, self.keys):
            self._put(np.array(column, "<i8").tobytes())
        self._put(self.nones.tobytes() + np.array([count, place, self.ids], "<i8").tobytes() + MAGIC)
        self.out.close()
        return self.name, self.shard, count, self.ids, self.size, self.digest.hexdigest()


def _writer(folder: str, data: bytes, width: int):
    """Rows come sorted by (shard, none, key, tie)."""
    def run(batches: Iterator) -> Iterator:
        import hashlib

        import pyarrow as pa

        packer, dictionary, file, done = _compressor(data), hashlib.sha256(data).hexdigest(), None, []
        for batch in batches:
            for shard, none, key, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if file is None or file.shard != shard:
                    done += [file.close()] if file else []
                    file = _File(folder, shard, width, dictionary)
                file.add(none, key, len(ids) // width, packer.compress(ids))
        done += [file.close()] if file else []
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], ["name", "shard", "documents", "ids", "bytes", "digest"])
    return run


def write(df: DataFrame, folder: str, tokenizer: str, id: str = "doc_id", text: str = "text", end: int = 2, shard_bytes: int = SHARD_BYTES) -> TokenFiles:
    """Write the token ids of every text, and ``end`` after them, to ``folder`` in ascending order of ids.

    Rows are range-sorted by id into shards of about ``shard_bytes`` bytes of text, NULL ids last; rows
    with equal ids follow a hash of their text. The zstandard dictionary is trained on the ids of a sample
    (SAMPLE_BYTES) and only decides how well documents shrink. Ids take two bytes where the vocabulary allows.
    Spark keeps the rows of successful attempts only, and the manifest names only their files.

    NULL or empty text: the end token alone. Repeated rows: each is written; ids or rows that repeat very
    often are split over shards. No rows: no files. A very long text is held by its task once, as ids.
    Other columns are not looked at. ``tokenizer``: as for packing.
    """
    import hashlib

    from tokenizers import Tokenizer

    spark = df.sparkSession
    width = 2 if max(Tokenizer.from_file(tokenizer).get_vocab_size(), end + 1) <= 1 << 16 else 4
    content = F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")
    rows = df.select(F.col(id).isNull().alias("none"), F.coalesce(F.col(id).cast("long"), F.lit(0).cast("long")).alias("key"), content)
    rows = rows.withColumn("tie", tie(F.col("text")))
    sizes = rows.select("none", "key", "tie", F.octet_length("text").cast("long").alias("size"))
    keys = materialize(sizes, "token-keys")
    total = keys.agg(F.sum("size")).first()[0] or 0
    borders = byte_borders(keys.withColumn("size", F.col("size") + ROW_BYTES), shard_bytes)

    chance = F.pmod(F.xxhash64("tie", F.lit(11)), F.lit(1 << 30))
    sample = rows.where((F.octet_length("text") <= SAMPLE_TEXT) & (chance < int(min(1.0, SAMPLE_BYTES / max(total, 1)) * (1 << 30)))).select("text")
    [learnt] = materialize(sample, "token-sample").coalesce(1).mapInArrow(_trainer(tokenizer, end, width, DICTIONARY_BYTES), "dictionary binary").collect() or [(b"",)]
    data = bytes(learnt[0])
    dictionary = hashlib.sha256(data).hexdigest()

    store, path = open_folder(folder)
    store.create_dir(path, recursive=True)
    with store.open_output_stream(f"{path}/{dictionary}.zdict", compression=None) as out:
        out.write(data)
    encoded = rows.select("none", "key", "tie", "text").mapInArrow(
        _encoder(tokenizer, end, width, borders), "none boolean, key long, tie long, shard int, ids binary")
    dealt = encoded.repartitionById(len(borders) + 1, F.col("shard")).sortWithinPartitions("shard", "none", "key", "tie")
    files = dealt.select("shard", "none", "key", "ids").mapInArrow(
        _writer(folder, data, width), "name string, shard long, documents long, ids long, bytes long, digest string")
    files = materialize(files, "token-files")
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)          # a row per shard
    files.withColumn("first_id", F.coalesce(F.sum("ids").over(earlier), F.lit(0).cast("long"))).withColumns(
        {"dictionary": F.lit(dictionary), "width": F.lit(width)}).write.json(f"{folder}/_manifest")
    return open_files(spark, folder)


MANIFEST = "name string, shard long, documents long, ids long, bytes long, digest string, first_id long, dictionary string, width int"


def open_files(spark: SparkSession, folder: str) -> TokenFiles:
    """The token files that a folder's manifest names."""
    manifest = spark.read.schema(MANIFEST).json(f"{folder}/_manifest")
    first = manifest.first()
    return TokenFiles(folder, manifest.drop("dictionary", "width"), first.dictionary if first else "", first.width if first else 2)


def _dictionary(folder: str, name: str) -> bytes:
    import hashlib

    store, path = open_folder(folder)
    with store.open_input_stream(f"{path}/{name}.zdict", compression=None) as stream:
        data = stream.read()
    if hashlib.sha256(data).hexdigest() != name:
        raise ValueError(f"{name}.zdict is damaged")
    return data


class _Index:
    """The index of an open file; a wrong dictionary or a damaged file raises."""

    def __init__(self, file, dictionary: str, width: int):
        import numpy as np

        size, tail = file.size(), 24 + len(MAGIC)
        if file.read_at(HEADER, 0) != MAGIC + bytes([width]) + bytes.fromhex(dictionary):
            raise ValueError("the file was written with another dictionary or is no token file")
        last = file.read_at(tail, size - tail)
        if last[24:] != MAGIC:
            raise ValueError("the file ends early")
        count, place, ids = np.frombuffer(last[:24], "<i8").tolist()
        data = file.read_at(25 * count, place)
        part = lambda k: np.frombuffer(data, "<i8", count, 8 * k * count)
        self.begins, self.before, self.keys = np.append(part(0), place), np.append(part(1), ids), part(2)
        self.nones, self.count = np.frombuffer(data, "u1", count, 24 * count), count

    def key(self, i: int):
        return None if self.nones[i] else int(self.keys[i])


DOCUMENT = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()),
    T.StructField("ids_crc32", T.LongType()), T.StructField("ids", T.BinaryType())])


def _emitted(documents: Iterator[tuple], width: int, payload: bool) -> Iterator:
    """Arrow batches from (id, start, serialized ids)."""
    import zlib

    import numpy as np
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    schema, rows, held = pa.schema(to_arrow_schema(DOCUMENT)), [], 0

    def batch():
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
    for id, start, raw in documents:
        raw = np.frombuffer(raw, f"<u{width}").astype("<u4").tobytes()
        rows.append((id, start, len(raw) // 4, zlib.crc32(raw), raw if payload else None))
        held += 200 + len(raw) * payload
        if held > BATCH_BYTES:
            yield batch()
            rows, held = [], 0
    if rows:
        yield batch()


def _frames(file, index: _Index) -> Iterator[tuple]:
    """(place, frame) of all documents, read_bytes of the file at a time; a longer frame alone."""
    i = 0
    while i < index.count:
        j = max(i + 1, int(index.begins.searchsorted(index.begins[i] + READ_BYTES, "right")) - 1)
        data = file.read_at(int(index.begins[j] - index.begins[i]), int(index.begins[i]))
        for k in range(i, j):
            yield k, data[int(index.begins[k] - index.begins[i]):int(index.begins[k + 1] - index.begins[i])]
        i = j


def _reader(folder: str, dictionary: str, width: int, payload: bool):
    """Documents of whole files, from (name, first_id)."""
    def run(batches: Iterator) -> Iterator:
        def documents():
            unpacker, (store, path) = None, open_folder(folder)
            for batch in batches:
                for name, first in zip(*(c.to_pylist() for c in batch.columns)):
                    unpacker = unpacker or _decompressor(_dictionary(folder, dictionary))
                    with store.open_input_file(f"{path}/{name}") as file:
                        index = _Index(file, dictionary, width)
                        for i, frame in _frames(file, index):
                            raw = unpacker.decompress(frame)
                            if len(raw) != width * int(index.before[i + 1] - index.before[i]):
                                raise ValueError(f"document {i} of {name} is damaged")
                            yield index.key(i), first + int(index.before[i]), raw
        yield from _emitted(documents(), width, payload)
    return run


def read(files: TokenFiles, payload: bool = True) -> DataFrame:
    """(id, start, n_tokens, ids_crc32, ids) of every document: ``start`` counts the ids of all documents before it,
    ``ids`` are little-endian unsigned 32-bit numbers (NULL without ``payload``). A file is one task's."""
    names = files.manifest.select("name", "first_id")
    spread = names.repartition(max(1, names.count()), "name")
    return spread.mapInArrow(_reader(files.folder, files.dictionary, files.width, payload), DOCUMENT)


def index(files: TokenFiles) -> DataFrame:
    """(id, name, place, start, n_tokens) of every document, from the files' indexes alone."""
    folder, dictionary, width = files.folder, files.dictionary, files.width

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        store, path = open_folder(folder)
        for batch in batches:
            for name, first in zip(*(c.to_pylist() for c in batch.columns)):
                with store.open_input_file(f"{path}/{name}") as file:
                    own = _Index(file, dictionary, width)
                ids = pa.array(own.keys, mask=own.nones.astype(bool))
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array([name] * own.count), pa.array(range(own.count), pa.int64()), pa.array(own.before[:-1] + first),
                     pa.array(own.before[1:] - own.before[:-1])], ["id", "name", "place", "start", "n_tokens"])
    names = files.manifest.select("name", "first_id")
    return names.repartition(max(1, names.count()), "name").mapInArrow(run, "id long, name string, place long, start long, n_tokens long")


def fetch(files: TokenFiles, wanted: DataFrame, id: str = "id") -> DataFrame:
    """As ``read``, of the documents whose ids are among ``wanted`` only: each one's frame is read alone by its
    place in the index. NULL finds the documents without id."""
    folder, dictionary, width = files.folder, files.dictionary, files.width

    def run(batches: Iterator) -> Iterator:
        def documents():
            unpacker, (store, path) = None, open_folder(folder)
            name, file = None, None
            for batch in batches:
                for other, i, start in zip(*(c.to_pylist() for c in batch.columns)):
                    unpacker = unpacker or _decompressor(_dictionary(folder, dictionary))
                    if other != name:
                        name, file = other, store.open_input_file(f"{path}/{other}")
                        own = _Index(file, dictionary, width)
                    yield own.key(i), start, unpacker.decompress(file.read_at(int(own.begins[i + 1] - own.begins[i]), int(own.begins[i])))
        yield from _emitted(documents(), width, True)
    asked = wanted.select(F.col(id).cast("long").alias("asked")).distinct()
    found = index(files).join(asked, F.col("id").eqNullSafe(F.col("asked")), "left_semi")
    spread = found.select("name", "place", "start").repartition("name").sortWithinPartitions("name", "place")
    return spread.mapInArrow(run, DOCUMENT)


def store(df: DataFrame, tokenizer: str, **settings) -> TokenFiles:
    """Write ``df`` to a new folder below the shared one."""
    return write(df, scratch_path(df.sparkSession, "token-files"), tokenizer, **settings)
