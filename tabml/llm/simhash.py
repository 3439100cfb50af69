"""SimHash near-duplicates by meet-in-the-middle ball hashing."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations
from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabml.llm.common import fresh, own_columns, spread_join
from tabml.llm.components import components
from tabml.llm.files import open_folder
from tabml.session import materialize, release

#: shingle hashes that are counted at once, which bounds the memory of a very long text
SLICE = 1 << 16
SEED = 42


def _print_of(hashes) -> int:
    """SimHash of a set of shingle hashes: the bits that are set in over half of them."""
    import numpy as np

    ones = np.zeros(64, np.int64)
    for start in range(0, len(hashes), SLICE):
        ones += np.unpackbits(hashes[start:start + SLICE].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


def _fingerprint(raw: bytes | None, shingle: int) -> int:
    import numpy as np
    from xxhash import xxh64_intdigest

    words = (raw or b"").lower().split()          # bytes: lowers A-Z only, splits at the six ASCII gaps
    if not words:
        return 0
    size = min(shingle, len(words))
    total = len(words) - size + 1
    ones = np.zeros(64, np.int64)
    for start in range(0, total, SLICE):
        part = words[start:start + SLICE + size - 1]
        shingles = map(b" ".join, zip(*(part[i:] for i in range(size))))
        hashes = np.fromiter((xxh64_intdigest(s, SEED) for s in shingles), np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > total, bitorder="little").view(np.int64)[0])


def _fingerprints(shingle: int):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            texts = batch.column(2).cast(pa.binary())
            prints = pa.array([_fingerprint(x.as_py(), shingle) for x in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), prints], ["id", "mark", "fingerprint"])
    return run


def fingerprints(df: DataFrame, id: str, text: str, shingle: int = 3) -> DataFrame:
    """(id, mark, fingerprint): 64 bits as a signed long, one row per input row; ``mark`` hashes the
    text. A bit is set when it is set in over half of the XXH64 hashes of the word shingles, repeats
    included; a shorter text is one shingle. NULL and wordless texts get 0."""
    rows = df.select(F.col(id).alias("id"), F.xxhash64(F.col(text)).alias("mark"), F.col(text).cast("string").alias("text"))
    schema = T.StructType([T.StructField("id", rows.schema["id"].dataType), T.StructField("mark", T.LongType()),
                           T.StructField("fingerprint", T.LongType())])
    return rows.mapInArrow(_fingerprints(shingle), schema)


def _ball(radius: int) -> Column:
    """Masks of all bit sets of at most ``radius`` bits, the empty one included."""
    masks = [sum(1 << b for b in bits) for r in range(radius + 1) for bits in combinations(range(64), r)]
    return F.array(*[F.lit(m - (1 << 64) if m >> 63 else m) for m in masks])


def links(prints: DataFrame, radius: int = 2) -> DataFrame:
    """(a, b), a > b: links that connect all distinct fingerprints within ``radius`` bits.

    Every fingerprint emits all variants within half the radius. Two fingerprints within the
    radius share a variant, and all that share one lie within the radius of each other, so a
    bucket holds at most one ball of fingerprints and its smallest member linked to the others
    stands for all its pairs. Links are deduplicated and their distance is verified.
    """
    if radius < 0 or radius % 2:
        raise ValueError("radius must be even: half of it is the radius of the emitted balls")
    variants = prints.select("fingerprint", F.explode(_ball(radius // 2)).alias("mask")).select(
        "fingerprint", F.col("fingerprint").bitwiseXOR(F.col("mask")).alias("variant"))
    met = variants.withColumn("least", F.min("fingerprint").over(Window.partitionBy("variant")))
    pairs = met.where("fingerprint > least").select(F.col("fingerprint").alias("a"), F.col("least").alias("b")).distinct()
    return pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)


def _grouped(rows: DataFrame, links_of) -> DataFrame:
    """(id, mark, node, root, component) from materialized (id, mark, node): ``links_of`` gives links
    between the classes (node, least: the smallest id of the class), root names the group by a node."""
    classes = materialize(rows.groupBy("node").agg(F.min("id").alias("least")), "simhash-classes")
    edges = materialize(links_of(classes), "simhash-links")
    linked = classes.join(components(edges).withColumnRenamed("root", "found"), "node", "left")
    linked = linked.withColumn("root", F.coalesce("found", "node"))
    least = linked.groupBy("root").agg(F.min("least").alias("component"))
    labels = materialize(spread_join(linked, least, ["root"]).select("node", "root", "component"), "simhash-labels")
    return spread_join(rows.select("id", "mark", "node"), labels, ["node"])


def _by_fingerprint(df: DataFrame, id: str, text: str, shingle: int, radius: int) -> DataFrame:
    rows = materialize(fingerprints(df, id, text, shingle).withColumnRenamed("fingerprint", "node"), "simhash")
    return _grouped(rows, lambda classes: links(classes.select(F.col("node").alias("fingerprint")), radius))


def near_duplicates(df: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = 3, radius: int = 2) -> DataFrame:
    """(id, fingerprint, component): one row per input row.

    Rows belong together when a chain of fingerprints, each within ``radius`` bits of the next,
    joins them; ``component`` is the smallest id of the group. Exact copies share a fingerprint
    and are one class from the start, so a group of copies of any size costs one row.

    NULL or wordless text: fingerprint 0, linked like any other. NULL id: the row keeps its
    NULL id and is never the smallest; a group of only NULL ids has component NULL. Repeated
    rows: each is returned. No rows: no rows. Other columns are not looked at.
    """
    return _by_fingerprint(df, id, text, shingle, radius).select("id", F.col("node").alias("fingerprint"), "component")


#: shingles are counted in one text of SAMPLE, in SLOTS counters that shingles share by their hash
SAMPLE, SLOTS = 16, 1 << 21
#: counters that lie in one row of the shared folder
BLOCK = 1 << 15
#: a shingle counted OFTEN more than chance tells is common; entries of other shingles that a task brings together, about
OFTEN, ENTRIES = 4, 1 << 18
#: heads that a bucket has in the first rounds: each round has MORE times as many as the one before
MORE = 16
#: counters of a sketch; nodes that a worker remembers having seen; bytes of keys that may be broadcast
SKETCH, SEEN, SMALL_BYTES = 256, 1 << 17, 64 << 20
#: bytes of a text that are split at once, texts whose sets are sent on at once
RUN_BYTES, SET_ROWS = 1 << 18, 1 << 10
GAP_BYTE = re.compile(rb"[\x20\x09-\x0D]")
#: sizes beyond are not told to buckets, which then rule nothing out by them
LARGE = (1 << 16) - 1


def _word_runs(raw: bytes) -> Iterator[list[bytes]]:
    """The words of a text, RUN_BYTES of it at a time."""
    start = 0
    while start < len(raw):
        gap = GAP_BYTE.search(raw, start + RUN_BYTES)
        end = gap.start() if gap else len(raw)
        yield raw[start:end].split()
        start = end


def _shingles(raw: bytes | None, shingle: int) -> tuple:
    """(hash of the words in order, sorted distinct hashes of the shingles); wordless texts have none."""
    import numpy as np
    from xxhash import xxh64, xxh64_intdigest

    whole, parts, tail, count = xxh64(seed=SEED), [], [], 0
    for words in filter(None, _word_runs((raw or b"").lower())):
        whole.update((b" " if count else b"") + b" ".join(words))
        count += len(words)
        tail += words
        if len(tail) >= shingle:
            parts.append(np.unique(np.fromiter((xxh64_intdigest(b" ".join(s), SEED) for s in zip(*(tail[i:] for i in range(shingle)))), np.uint64)))
            tail = tail[len(tail) - shingle + 1:]
    if not count:
        return 0, np.zeros(0, np.int64)
    if count < shingle:
        parts.append(np.array([xxh64_intdigest(b" ".join(tail), SEED)], np.uint64))
    return int(np.uint64(whole.intdigest()).view(np.int64)), np.unique(np.concatenate(parts)).view(np.int64)


def _sketch(hashes) -> bytes:
    """How many shingles fall to each of SKETCH counters: what two texts share is at most the sum of the lesser counts."""
    import numpy as np
    return np.minimum(np.bincount(hashes.view(np.uint64) % np.uint64(SKETCH), minlength=SKETCH), LARGE).astype("<u2").tobytes()


def _texts(shingle: int):
    """(id, mark, node, size, sketch, fingerprint) of all rows."""
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            found = [(n, len(h), _sketch(h), _print_of(h)) for n, h in (_shingles(x.as_py(), shingle) for x in batch.column(2).cast(pa.binary()))]
            node, size, sketch, prints = zip(*found) if found else ([], [], [], [])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(node, pa.int64()), pa.array(size, pa.int64()), pa.array(sketch, pa.binary()),
                 pa.array(prints, pa.int64())], ["id", "mark", "node", "size", "sketch", "fingerprint"])
    return run


def _sets(shingle: int):
    """(node, shingles) from (node, text)."""
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in (b[i:i + SET_ROWS] for b in batches for i in range(0, b.num_rows, SET_ROWS)):
            found = [_shingles(x.as_py(), shingle)[1] for x in batch.column(1).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], ["node", "shingles"])
    return run


def _prefix(hashes, counts, similarity: float):
    """(shingles, counts) of the rarest shingles of a text, so many that each text with the wanted overlap has one
    of its own rarest among them: all texts order by (count, hash)."""
    import numpy as np

    if not len(hashes):
        return hashes, hashes
    count = counts[hashes.view(np.uint64) % np.uint64(len(counts))]
    order = np.lexsort((hashes, count))[:len(hashes) - ceil(similarity * len(hashes) - 1e-9) + 1]
    return hashes[order], count[order]


ENTRY = [("print", "<i8"), ("node", "<i8"), ("size", "<u2"), ("left", "<u2")]


def _entries(shingle: int, similarity: float, counted: str, groups: int):
    """(group, entries): a text's rarest shingles, packed by range of their hash. Common shingles are in
    buckets of their own for certain or nearly so: they take no part in looking for those that occur once.
    ``counted`` is where the counts lie."""
    slots, block = SLOTS, BLOCK

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        seen: set = set()
        counts, chance = _read_counts(counted, slots, block)
        turn = TaskContext.get().partitionId() << 20

        def packed(held):
            nonlocal turn
            turn += 1
            whole = np.concatenate(held)
            group = np.where(whole["common"], -1 - turn, ((whole["print"].view(np.uint64) >> np.uint64(33)).astype(np.int64) * groups) >> 31)
            order = np.argsort(group, kind="stable")
            whole, group = whole[order], group[order]
            starts = np.flatnonzero(np.diff(group, prepend=group[0] - 1))
            cells = [b"".join(np.ascontiguousarray(part[name].astype(kind)).tobytes() for name, kind in ENTRY) for part in np.split(whole, starts[1:])]
            return pa.RecordBatch.from_arrays([pa.array(group[starts]), pa.array(cells, pa.binary())], ["bundle", "entries"])
        held, size = [], 0
        for batch in batches:
            for x in batch.column(0).cast(pa.binary()):
                node, hashes = _shingles(x.as_py(), shingle)
                if node in seen:
                    continue
                if len(seen) < SEEN:
                    seen.add(node)
                rare, count = _prefix(hashes, counts, similarity)
                entry = np.zeros(len(rare), [*ENTRY, ("common", "?")])
                entry["print"], entry["node"], entry["common"] = rare, node, count >= chance + OFTEN
                entry["size"], entry["left"] = min(len(hashes), LARGE), np.minimum(len(hashes) - np.arange(len(rare)), LARGE)
                held.append(entry)
                size += len(rare)
                if size > 1 << 17:
                    yield packed(held)
                    held, size = [], 0
        if size:
            yield packed(held)
    return run


def _unpacked(cells: bytes):
    import numpy as np

    width, at, out = sum(np.dtype(kind).itemsize for _, kind in ENTRY), 0, {}
    count = len(cells) // width
    for name, kind in ENTRY:
        out[name] = np.frombuffer(cells, kind, count, at)
        at += count * np.dtype(kind).itemsize
    return out


def _shared(table):
    """(print, node, size, left) of a group's entries: each once, those of shingles that occur in one text only are left out."""
    import numpy as np
    import pyarrow as pa

    parts = [_unpacked(x) for x in table["entries"].to_pylist()]
    whole = {name: np.concatenate([p[name] for p in parts]) for name, _ in ENTRY}
    order = np.lexsort((whole["node"], whole["print"]))
    whole = {name: x[order] for name, x in whole.items()}
    first = np.ones(len(order), bool)
    first[1:] = (whole["print"][1:] != whole["print"][:-1]) | (whole["node"][1:] != whole["node"][:-1])
    whole = {name: x[first] for name, x in whole.items()}
    alone = np.ones(len(whole["print"]), bool)
    if table["bundle"][0].as_py() < 0:
        alone[:] = False
    else:
        same = whole["print"][1:] == whole["print"][:-1]
        alone[1:] &= ~same
        alone[:-1] &= ~same
    return pa.table({name: pa.array(x[~alone].astype(np.int64)) for name, x in whole.items()})


def _counts(docs: DataFrame, shingle: int) -> DataFrame:
    """(block, counts) in the shared folder: how often the shingles of each slot occur in a sample of the distinct texts,
    BLOCK slots a row, blocks without any left out. Counts only say in which order shingles are tried, so the result
    does not depend on them. Tasks read them for themselves (``_read_counts``); the driver never holds them."""
    sample = docs.where(F.pmod("mark", F.lit(SAMPLE)) == 0).groupBy("mark").agg(F.min("text").alias("text"))
    found = sample.select("mark", "text").mapInArrow(_sets(shingle), "node long, shingles array<long>")
    slots = found.select(F.explode("shingles").alias("shingle")).groupBy(F.call_function("mod", _unsigned("shingle"), F.lit(SLOTS)).cast("int").alias("slot"))
    size = BLOCK

    def packed(table):
        import numpy as np
        import pyarrow as pa

        counts = np.zeros(size, "<u4")
        counts[table["slot"].to_numpy() % size] = np.minimum(table["n"].to_numpy(), np.iinfo(np.uint32).max)
        return pa.table({"block": table["block"][:1], "counts": pa.array([counts.tobytes()], pa.binary())})
    blocks = slots.agg(F.count("*").alias("n")).withColumn("block", F.floor(F.col("slot") / size).cast("int"))
    return materialize(blocks.groupBy("block").applyInArrow(packed, "block int, counts binary"), "simhash-counts")


@lru_cache(maxsize=1)
def _read_counts(uri: str, slots: int, size: int) -> tuple:
    """(counts, chance) of what ``_counts`` wrote: rare shingles hardly fill a slot beyond chance. A worker keeps
    them for its next task."""
    import numpy as np
    from pyarrow import dataset

    store, path = open_folder(uri)
    counts = np.zeros(-(-slots // size) * size, "<u4")
    for batch in dataset.dataset(path, filesystem=store, format="parquet").to_batches():
        for block, cells in zip(batch.column("block").to_pylist(), batch.column("counts")):
            counts[block * size:(block + 1) * size] = np.frombuffer(cells.as_buffer(), "<u4")
    counts = counts[:slots]
    usual = float(np.median(counts))
    return counts, usual + 6 * usual ** 0.5


def _unsigned(name: str) -> Column:
    """The low bits of a long as a number that is not negative (SLOTS divides 2^62)."""
    return F.col(name).bitwiseAND(F.lit((1 << 62) - 1))


def _enough(shared: Column, sizes: Column, similarity: float) -> Column:
    """May ``shared`` shingles of ``sizes`` in both texts reach the similarity?"""
    return shared * (1 + similarity) + 1e-6 >= similarity * sizes


def _with_heads(members: DataFrame, heads: DataFrame, similarity: float) -> DataFrame:
    """(a, b), a > b: members of a bucket with its heads, unless they are joined already or cannot overlap enough."""
    both = spread_join(members, heads.toDF("print", "other", "length", "behind", "joined"), ["print"])
    known = F.greatest("size", "length") < LARGE
    possible = _enough(F.least("left", "behind"), F.col("size") + F.col("length"), similarity)
    both = both.where((F.col("root") != F.col("joined")) & (possible | ~known))
    return both.select(F.greatest("node", "other").alias("a"), F.least("node", "other").alias("b")).distinct()


def _possible(similarity: float):
    """(a, b) of the pairs whose sketches do not rule out the similarity."""
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), "<u2").reshape(-1, SKETCH) for i in (4, 5))
            most = np.minimum(x, y).sum(axis=1, dtype=np.int64)
            sizes = batch.column(2).to_numpy() + batch.column(3).to_numpy()
            keep = (most * (1 + similarity) + 1e-6 >= similarity * sizes) | ((x == LARGE) & (y == LARGE)).any(axis=1)
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep)) for c in batch.columns[:2]], ["a", "b"])
    return run


def _small(keys: DataFrame, width: int = 40) -> DataFrame:
    """Rows of about ``width`` bytes, broadcast if all of them are few."""
    return F.broadcast(keys) if keys.count() * width <= SMALL_BYTES else keys


class _Confirmed:
    """Exact comparison of pairs of nodes: whole sets are made and moved only of texts whose sketches leave it open."""

    def __init__(self, docs: DataFrame, one: DataFrame, shingle: int, similarity: float):
        self.docs, self.one, self.shingle, self.similarity = docs, one, shingle, similarity

    def __call__(self, pairs: DataFrame) -> DataFrame:
        sketches = self.one.select("node", "size", "sketch")
        met = spread_join(pairs, sketches.toDF("a", "size_a", "x"), ["a"])
        met = spread_join(met, sketches.toDF("b", "size_b", "y"), ["b"]).select("a", "b", "size_a", "size_b", "x", "y")
        open_pairs = materialize(met.mapInArrow(_possible(self.similarity), "a long, b long"), "simhash-open")
        nodes = open_pairs.select(F.col("a").alias("node")).union(open_pairs.select("b")).distinct()
        wanted = materialize(self.one.select("node", "key", "mark").join(nodes, "node"), "simhash-wanted")
        texts = self.docs.join(_small(wanted), ["key", "mark"]).groupBy("node").agg(F.first("text").alias("text"))
        sets = materialize(texts.select("node", "text").mapInArrow(_sets(self.shingle), "node long, shingles array<long>"), "simhash-sets")
        both = spread_join(spread_join(open_pairs, sets.toDF("a", "x"), ["a"]), sets.toDF("b", "y"), ["b"])
        shared = F.size(F.array_intersect("x", "y"))
        good = both.where(shared / (F.size("x") + F.size("y") - shared) >= self.similarity).select("a", "b")
        found = materialize(good, "simhash-links")
        for part in (open_pairs, wanted, sets):
            release(part)
        return found


def _simhash_links(prints: DataFrame, radius: int = 2) -> DataFrame:
    """(a, b), a > b: pairs of texts (node, fingerprint) that SimHash holds for near copies. Each text meets the
    smallest of its own fingerprint, and these meet where their fingerprints are linked."""
    heads = prints.groupBy("fingerprint").agg(F.min("node").alias("head"))
    same = spread_join(prints, heads, ["fingerprint"]).where("node > head").select(F.col("node").alias("a"), F.col("head").alias("b"))
    near = links(heads.select("fingerprint"), radius).withColumnsRenamed({"a": "x", "b": "y"})
    near = near.join(heads.toDF("x", "a"), "x").join(heads.toDF("y", "b"), "y")
    return same.union(near.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))


def _with_roots(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Rows with the root that the links ``found`` give their node."""
    roots = components(found).withColumnRenamed("root", "found")
    return spread_join(rows.drop("root"), roots, ["node"], "left").withColumn("root", F.coalesce("found", "node")).drop("found")


def _similar_links(members: DataFrame, confirmed, similarity: float, near: DataFrame) -> DataFrame:
    """(a, b), a > b: ``near``, links that are known, and more that connect all texts of a bucket that overlap enough.

    Each round compares all members of a bucket with some heads, drops the heads, and then the
    buckets whose members are all joined by now: a group of near copies is done after one round,
    a bucket of unlike texts when each was a head. The first round has one head, each later one MORE
    times as many as the one before, so a bucket of m unlike texts takes about log m rounds.
    """
    links, seen, heads_now = near, None, 1
    while not members.isEmpty():
        salt = F.pmod(F.xxhash64("node", F.lit(heads_now)), F.lit(heads_now))
        heads = members.groupBy("print", salt.alias("salt")).agg(F.min(F.struct("node", "size", "left", "root")).alias("head"))
        heads = materialize(heads.select("print", "head.*"), "simhash-heads")
        pairs = _with_heads(members, heads, similarity)
        pairs = materialize(pairs if seen is None else pairs.join(seen, ["a", "b"], "left_anti"), "simhash-pairs")
        seen = pairs if seen is None else seen.union(pairs)
        found = confirmed(pairs)
        links = links.union(found)
        rest = members.join(heads.select("print", "node"), ["print", "node"], "left_anti")
        if not found.isEmpty():
            rest = _with_roots(rest, links)
        rest = materialize(rest.select("print", "node", "size", "left", "root"), "simhash-rest")
        mixed = rest.groupBy("print").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least < most").select("print")
        before, members = members, materialize(spread_join(rest, mixed, ["print"]).select(*rest.columns), "simhash-members")
        for part in (before, heads, rest):
            release(part)
        heads_now *= MORE
    return links


def _by_similarity(df: DataFrame, id: str, text: str, shingle: int, similarity: float) -> DataFrame:
    if not 0 < similarity <= 1:
        raise ValueError("similarity must be above 0 and at most 1")
    docs = df.select(F.col(id).alias("id"), F.xxhash64(F.col(text)).alias("mark"), F.col(text).cast("string").alias("text"))
    long = T.LongType()
    schema = T.StructType([T.StructField("id", docs.schema["id"].dataType), T.StructField("mark", long), T.StructField("node", long),
                           T.StructField("size", long), T.StructField("sketch", T.BinaryType()),
                           T.StructField("fingerprint", long)])
    rows = materialize(docs.mapInArrow(_texts(shingle), schema), "simhash")
    key = F.coalesce(F.col("id").cast("string"), F.lit("")).alias("key")

    def links_of(classes: DataFrame) -> DataFrame:
        # one row stands for each class; texts that repeat with their id are one again at the end
        one = rows.groupBy("node").agg(F.min(F.struct(key, "mark", "size", "sketch", "fingerprint")).alias("one")).select("node", "one.*")
        one = materialize(one, "simhash-texts")
        confirmed = _Confirmed(docs.select(key, "mark", "text"), one, shingle, similarity)
        pairs = materialize(_simhash_links(one.where("size > 0").select("node", "fingerprint")), "simhash-pairs")
        near = confirmed(pairs)
        release(pairs)
        total = one.agg(F.sum("size")).first()[0] or 0
        groups = max(1, int(total * (1 - similarity)) // ENTRIES)
        counts = _counts(docs, shingle)
        entries = docs.select("text").mapInArrow(_entries(shingle, similarity, counts.scratch, groups), "bundle long, entries binary")
        members = entries.groupBy("bundle").applyInArrow(_shared, "print long, node long, size long, left long")
        members = materialize(_with_roots(members, near).select("print", "node", "size", "left", "root"), "simhash-members")
        release(counts)
        found = _similar_links(members, confirmed, similarity, near)
        release(one)
        return found
    return _grouped(rows, links_of)


def similar_texts(df: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """(id, component) per row: groups of texts whose word shingles overlap by ``similarity`` or more.

    SimHash comes first: texts within two bits of each other (``links``) meet, and what whole sets confirm is
    joined. Its balls reach very near copies only, so prefix filtering then finds every other pair: shingles have one order, rare ones first, and of two texts that
    overlap enough the rarest shingle they share lies among the first of both. Pairs that meet are ruled
    out by bounds on what they share, else confirmed by the whole sets of shingle hashes (64 bits). Texts
    that differ only in case (A-Z) and white space are one from the start.

    Edge cases are those of ``near_duplicates``; wordless texts are equal to each other.
    """
    return _by_similarity(df, id, text, shingle, similarity).select("id", "component")


def representatives(df: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of ``df`` with all their columns, of which exactly one per group of similar texts
    stays: that with the smallest id, NULL last; of texts that share this id the one with the
    smallest hash, and one of the rows that repeat id and text. Rows that stay do not move, unless the
    keys of those that go are too many to be broadcast."""
    none, key, mark = fresh(df.columns, "none", "key", "mark")
    order = F.struct(F.col("id").isNull().alias("none"), F.coalesce(F.col("id").cast("string"), F.lit("")).alias("key"), "mark")
    ranked = F.struct(F.col("id").isNull().alias("none"), "id", "mark", order.alias("at"))
    grouped = materialize(_by_similarity(df, id, text, shingle, similarity).select("root", "id", "mark"), "simhash-groups")
    first = grouped.groupBy("root").agg(F.min(ranked).alias("first")).select("first.at.*").withColumn("stays", F.lit(True))
    keys = grouped.select(order.alias("at")).select("at.*").groupBy("none", "key", "mark").agg(F.count("*").alias("n"))
    told = keys.join(first, ["none", "key", "mark"], "left").where("stays is null or n > 1")
    told = materialize(told.toDF(none, key, mark, "n", "stays"), "simhash-told")
    rows = df.withColumns({none: F.col(id).isNull(), key: F.coalesce(F.col(id).cast("string"), F.lit("")), mark: F.xxhash64(F.col(text))})
    single = rows.join(_small(told.select(none, key, mark)), [none, key, mark], "left_anti").select(*own_columns(df))
    twice = rows.join(_small(told.where("stays").select(none, key, mark)), [none, key, mark], "left_semi")
    kept = twice.groupBy(none, key, mark).agg(F.first(F.struct(*own_columns(df))).alias("row")).select("row.*")
    return single.union(kept)
