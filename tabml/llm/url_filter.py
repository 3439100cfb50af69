"""URL rules: a blocked Bloom filter of listed keys in front of an exact hash join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabml.llm.common import ascii_lower, fresh, named, spread_join
from tabml.session import materialize

#: filter bits per listed key, and the most bytes of a filter; beyond them only more rows are joined
BITS_PER_KEY, MAX_FILTER_BYTES = 16, 64 << 20
#: odd multipliers below 2^31, one for each of the eight words of a block, where they pick a bit
SALTS = [0x47B6137B, 0x44974D91, 0x0824AD5B, 0x22B7289D, 0x705495C7, 0x2DF1424B, 0x1EFC4947, 0x5C6BFB31]


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; else empty."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _block(hash: Column, blocks: int) -> Column:
    return F.shiftrightunsigned(hash, 32) % blocks


def build_filter(keys: DataFrame, key: str, bits_per_key: int = BITS_PER_KEY, max_bytes: int = MAX_FILTER_BYTES):
    """Blocks of eight 64-bit words as a numpy array: every key sets one bit in each word of its
    block. Blocks are combined by Spark; the driver gets at most ``max_bytes``."""
    import numpy as np

    hashes = keys.select(F.xxhash64(key).alias("h")).distinct()
    count = hashes.count()
    blocks = max(1, min(max_bytes // 64, -(-count * bits_per_key // 512)))
    low = F.col("h").bitwiseAND(F.lit(0xFFFFFFFF))
    bits = [F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"),
                                     F.shiftrightunsigned((low * F.lit(s)).bitwiseAND(F.lit(0xFFFFFFFF)), 26).cast("int"))).alias(f"w{i}")
            for i, s in enumerate(SALTS)]
    rows = hashes.groupBy(_block(F.col("h"), blocks).alias("block")).agg(*bits).toPandas()
    words = np.zeros((blocks, 8), np.uint64)
    if len(rows):
        words[rows["block"].to_numpy(np.int64)] = rows[[f"w{i}" for i in range(8)]].to_numpy(np.int64).view(np.uint64)
    return words


def probe(words, hashes):
    """Which hashes may be listed; never wrong about those that are."""
    import numpy as np

    h = hashes.astype(np.int64).view(np.uint64)
    own = words[(h >> np.uint64(32)) % np.uint64(len(words))]
    low = h & np.uint64(0xFFFFFFFF)
    found = np.ones(len(h), bool)
    for i, salt in enumerate(SALTS):
        bit = ((low * np.uint64(salt)) & np.uint64(0xFFFFFFFF)) >> np.uint64(26)
        found &= (own[:, i] >> bit) & np.uint64(1) == 1
    return found


def _pass_filter(shared):
    def run(batches):
        for pdf in batches:
            yield pdf[probe(shared.value, pdf["hash"].to_numpy())]
    return run


def judge(df: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """``df`` with host, path, rule and verdict after its columns (they replace columns of the same
    names). ``rules`` has host, path and verdict (allow or block).

    A rule fits its host and all subdomains when the url's path starts with the rule's; the longest
    fitting rule wins, of equally long ones that with the longer host. Every distinct host and path
    yields its keys: the host's suffixes with the path's beginnings of those lengths that the list
    knows. The Bloom filter drops nearly all that are not listed and the exact join the rest, so
    urls meet the list once however often they repeat, and pages never meet it.

    NULL urls and those without :// have empty host and path, no rule and the default verdict. A
    rule listed with both verdicts blocks. An empty list leaves every verdict to the default.
    Repeated rows are all judged.
    """
    listed = rules.select(ascii_lower(F.coalesce("host", F.lit(""))).alias("h"), F.coalesce("path", F.lit("")).alias("p"), "verdict")
    listed = materialize(listed.groupBy(F.concat("h", "p").alias("key")).agg(
        F.max("verdict").alias("verdict"), F.max(F.length("h")).alias("host_chars"), F.max(F.length("p")).alias("path_chars")), "url-rules")
    lengths = [r[0] for r in listed.select("path_chars").distinct().orderBy("path_chars").collect()]     # a few lengths
    shared = df.sparkSession.sparkContext.broadcast(build_filter(listed, "key"))

    seen = df.select(host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path")).where("host <> ''").distinct()
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size("labels")), lambda i: F.array_join(F.slice("labels", i, F.size("labels")), "."))
    heads = F.filter(F.array(*[F.lit(n).cast("int") for n in lengths]), lambda n: n <= F.length("path")) if lengths else F.array().cast("array<int>")
    asked = seen.withColumn("labels", labels).withColumn("suffix", F.explode(suffixes)).withColumn("chars", F.explode(heads))
    asked = asked.select("host", "path", F.concat("suffix", F.substring("path", F.lit(1), F.col("chars"))).alias("key"))
    asked = asked.withColumn("hash", F.xxhash64("key"))
    possible = asked.mapInPandas(_pass_filter(shared), asked.schema)

    hits = spread_join(possible.drop("hash"), listed, ["key"])
    place = F.struct(F.length("key").alias("chars"), "host_chars", "key")
    [both] = fresh(df.columns, "both")
    won = hits.groupBy(F.concat("host", F.lit(" "), "path").alias(both)).agg(
        F.max_by("key", place).alias("rule"), F.max_by("verdict", place).alias("verdict"))
    rest = [named(c) for c in df.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    own = df.select(*rest, host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    own = own.withColumn(both, F.concat("host", F.lit(" "), "path"))
    told = spread_join(own, won, [both], "left")
    return told.select(*rest, "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
