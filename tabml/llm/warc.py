"""A deterministic sharded WARC writer, and a reader of its archives."""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import quote

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabml.llm.common import spread_join
from tabml.llm.files import open_folder
from tabml.session import materialize, scratch_path

#: payload bytes per shard (one task), and compressed bytes after which a shard begins a new file
SHARD_BYTES, ROLL_BYTES = 64 << 20, 16 << 20
#: the date of every record unless told otherwise: archives of equal rows are equal to the byte
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: the place of rows without an id
LAST = (1 << 63) - 1
#: keys per shard, about, in the sample that finds the shards' borders
KEYS_PER_SHARD = 64


def _base32(raw: bytes) -> str:
    import base64
    return base64.b32encode(raw).decode()


def _record_id(page, digest: str) -> str:
    return f"<urn:x-page:{'' if page is None else page}:{digest}>"


def _record(page, url, payload: bytes, digest: str, refers_to, date: str) -> bytes:
    """One uncompressed record. Headers and digests are made anew from url and payload; characters
    that a header can't hold are percent-encoded, a NULL url is about:blank."""
    import hashlib

    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if refers_to is not None else 'response'}", f"WARC-Record-ID: {_record_id(page, digest)}",
        f"WARC-Date: {date}", f"WARC-Target-URI: {quote(url, safe=URL_SAFE) if url is not None else 'about:blank'}",
        f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{_base32(hashlib.sha1(block).digest())}"]
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_record_id(refers_to, digest)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


URL_SAFE = "!#$%&'()*+,-./:;=?@[]_~"


class _Shard:
    """Files of one shard: opened under temporary names, closed when they have grown enough."""

    def __init__(self, folder: str, shard: int, roll: int, attempt: str):
        self.store, self.path = open_folder(folder)
        self.shard, self.roll, self.attempt, self.count, self.out = shard, roll, attempt, 0, None

    def write(self, record: bytes):
        import hashlib
        import zlib

        if self.out is None:
            self.name = f"part-{self.shard:06d}-{self.count:05d}.warc.gz"
            self.temporary = f"_temporary/{self.name}-{self.attempt}"
            self.out, self.size, self.records, self.digest = self.store.open_output_stream(f"{self.path}/{self.temporary}", compression=None), 0, 0, hashlib.sha1()
        packer = zlib.compressobj(6, zlib.DEFLATED, 31)          # a gzip member per record, without a time
        data = packer.compress(record) + packer.flush()
        self.out.write(data)
        self.digest.update(data)
        self.size += len(data)
        self.records += 1
        return self.close() if self.size >= self.roll else None

    def close(self):
        if self.out is None:
            return None
        self.out.close()
        self.out, self.count = None, self.count + 1
        return (self.name, self.temporary, self.shard, self.size, self.records, self.digest.hexdigest())


def _writer(folder: str, roll: int, date: str):
    def run(batches: Iterator) -> Iterator:
        """Rows come sorted by shard, page and digest; a revisit's original comes right before it."""
        import uuid

        import pandas as pd

        columns = ["name", "temporary", "shard", "bytes", "records", "digest"]
        attempt, shard, told = uuid.uuid4().hex, None, None
        for batch in batches:
            done = []
            data = batch.to_pydict()
            for number, page, digest, kind, refers_to, url, html in zip(*(data[c] for c in ("shard", "page", "digest", "kind", "refers_to", "url", "html"))):
                if shard is None or shard.shard != number:
                    done.append(shard and shard.close())
                    shard, told = _Shard(folder, number, roll, attempt), None
                if kind == 0:
                    told = (page, digest, refers_to)
                    continue
                origin = told[2] if told and told[:2] == (page, digest) else None
                raw = bytes.fromhex(digest)
                done.append(shard.write(_record(page, url, html or b"", _base32(raw), origin, date)))
            yield from _arrow(pd.DataFrame([d for d in done if d], columns=columns))
        if shard and (last := shard.close()):
            yield from _arrow(pd.DataFrame([last], columns=columns))
    return run


def _arrow(pdf):
    import pyarrow as pa

    if len(pdf):
        yield pa.RecordBatch.from_pandas(pdf, preserve_index=False)


def _commit(folder: str):
    def run(batches: Iterator) -> Iterator:
        """Temporary names become final ones; files that have their final name are left alone."""
        store, path = open_folder(folder)
        for pdf in batches:
            for name, temporary in zip(pdf["name"], pdf["temporary"]):
                from pyarrow import fs
                if store.get_file_info(f"{path}/{name}").type == fs.FileType.NotFound:
                    store.move(f"{path}/{temporary}", f"{path}/{name}")
            yield pdf[["name", "shard", "bytes", "records", "digest"]]
    return run


def _borders(rows: DataFrame, shards: int) -> list[int]:
    """The first page of every shard but the first, from keys that a hash picks: the same on every
    run, and about KEYS_PER_SHARD a shard on the driver."""
    total = rows.where("page is not null").count()
    share = min(1.0, shards * KEYS_PER_SHARD / max(total, 1))
    picked = rows.where("page is not null").where(F.pmod(F.xxhash64("page", "digest"), F.lit(1 << 30)) < int(share * (1 << 30)))
    keys = [r["page"] for r in picked.select("page").orderBy("page", "digest").collect()]
    return sorted({keys[len(keys) * i // shards] for i in range(1, shards)}) if keys else []


def write(df: DataFrame, folder: str, id: str = "page_id", url: str = "url", html: str = "html", min_revisit_bytes: int = 0,
          shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES, date: str = DATE) -> DataFrame:
    """Write a record per row to ``folder``; returns its manifest (name, shard, bytes, records, digest).

    Of equal payloads of at least ``min_revisit_bytes`` bytes the one with the smallest id is a
    response, the others are revisits of it; rows that repeat id and payload of a response are responses
    too. Rows are range-sorted by id into shards of about ``shard_bytes`` of payload, a shard's files end
    at ``roll_bytes`` compressed bytes, and records are gzip members of their own. Equal rows give equal
    files. A task writes under temporary names and returns them; Spark keeps the rows of its successful
    attempt only as the manifest, and then the named files get their final names. What failed attempts
    left is never named and goes with the temporary folder.

    NULL html: an empty payload. NULL url: about:blank. NULL id: last in order, never the original of
    a revisit; without an id in the group all are responses. No rows: no files and an empty manifest.
    Other columns are not written.
    """
    spark = df.sparkSession
    payload = F.coalesce(F.col(html).cast("string"), F.lit("")).cast("binary")
    rows = df.select(F.col(id).cast("long").alias("page"), F.col(url).cast("string").alias("url"), payload.alias("html"))
    rows = rows.withColumn("digest", F.sha1("html"))
    keys = materialize(rows.select("page", "digest", F.length("html").alias("size")), "warc-keys")
    payload_bytes = keys.agg(F.sum("size")).first()[0] or 0
    borders = _borders(keys, max(1, -(-payload_bytes // shard_bytes)))
    shards = len(borders) + 1

    equal = keys.where(F.col("size") >= min_revisit_bytes).groupBy("digest").agg(F.min("page").alias("origin"), F.count("*").alias("n"))
    revisits = spread_join(keys, equal.where("n > 1 and origin is not null"), ["digest"]).where("page is null or page <> origin")
    marks = revisits.select("page", "digest", F.lit(0).alias("kind"), F.col("origin").alias("refers_to"),
                            F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("html")).distinct()
    records = rows.select("page", "digest", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("refers_to"), "url", "html")
    known = spark.sparkContext.broadcast(borders)       # one long per shard

    @F.pandas_udf("int")
    def shard_of(page):
        import numpy as np
        return page.map(lambda p: int(np.searchsorted(known.value, p, side="right")))

    dealt = marks.union(records).withColumn("shard", shard_of(F.coalesce("page", F.lit(LAST))))
    dealt = dealt.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", F.col("page").asc_nulls_last(), "digest", "kind", "url")
    store, path = open_folder(folder)
    store.create_dir(f"{path}/_temporary", recursive=True)
    schema = "name string, temporary string, shard long, bytes long, records long, digest string"
    manifest = materialize(dealt.mapInArrow(_writer(folder, roll_bytes, date), schema), "warc-manifest")
    spread = manifest.repartition(max(1, min(manifest.count(), spark.sparkContext.defaultParallelism)))
    final = materialize(spread.mapInPandas(_commit(folder), "name string, shard long, bytes long, records long, digest string"), "warc-final")
    final.orderBy("name").write.mode("overwrite").json(f"{folder}/_manifest")
    store.delete_dir(f"{path}/_temporary")
    return final


def _members(stream) -> Iterator[tuple[int, bytes]]:
    """(offset, content) of the gzip members of a stream, a member at a time."""
    import zlib

    offset, data = 0, b""
    while True:
        data = data or stream.read(1 << 20)
        if not data:
            return
        begin, parts, opener = offset, [], zlib.decompressobj(31)
        while not opener.eof:
            data = data or stream.read(1 << 20)
            if not data:
                raise ValueError(f"the member at byte {begin} ends early")
            parts.append(opener.decompress(data))
            offset += len(data) - len(opener.unused_data)
            data = opener.unused_data
        yield begin, b"".join(parts)


def _page_of(record_id: str | None):
    page = record_id.split(":")[2] if record_id else ""
    return int(page) if page else None


def _parse(raw: bytes) -> tuple:
    """(page_id, url, type, payload, payload_bytes, digest, refers_to) of a record; a wrong digest raises."""
    import hashlib

    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[:int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(next(line.split(b": ")[1] for line in http.split(b"\r\n") if line.startswith(b"Content-Length")))
    digest, response = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"] == "response"
    if "sha1:" + _base32(hashlib.sha1(block).digest()) != fields["WARC-Block-Digest"] or response and (
            size != len(payload) or _base32(hashlib.sha1(payload).digest()) != digest):
        raise ValueError(f"digest of {fields['WARC-Record-ID']} does not match")
    return (_page_of(fields["WARC-Record-ID"]), fields["WARC-Target-URI"], fields["WARC-Type"], payload if response else None, size, digest,
            _page_of(fields.get("WARC-Refers-To")))


def _reader(folder: str, payloads: bool, schema):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        store, path = open_folder(folder)

        def batch_of(rows: list[tuple]):
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        for batch in batches:
            for name in batch.column(0).to_pylist():
                with store.open_input_stream(f"{path}/{name}", compression=None) as stream:
                    rows, held = [], 0
                    for offset, raw in _members(stream):
                        page, url, kind, payload, size, digest, origin = _parse(raw)
                        rows.append((page, url, kind, payload if payloads else None, size, digest, origin, name, offset))
                        held += len(raw) if payloads else 200
                        if held > 4 << 20:
                            yield batch_of(rows)
                            rows, held = [], 0
                    if rows:
                        yield batch_of(rows)
    return run


def read(manifest: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """(page_id, url, record_type, payload, payload_bytes, payload_digest, refers_to, file, offset) of the
    records in a manifest's files, each file read by one task as a stream. Digests are checked; revisits
    have no payload, but its size and digest."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    files = manifest.select("name")
    spread = files.repartition(max(1, files.count()), "name")
    schema = T.StructType([
        T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("record_type", T.StringType()),
        T.StructField("payload", T.BinaryType()), T.StructField("payload_bytes", T.LongType()), T.StructField("payload_digest", T.StringType()),
        T.StructField("refers_to", T.LongType()), T.StructField("file", T.StringType()), T.StructField("offset", T.LongType())])
    return spread.mapInArrow(_reader(folder, payloads, pa.schema(to_arrow_schema(schema))), schema)


def archive(df: DataFrame, **settings) -> tuple[DataFrame, str]:
    """Write ``df`` to a new folder below the shared one; returns the manifest and the folder."""
    folder = scratch_path(df.sparkSession, "warc")
    return write(df, folder, **settings), folder
