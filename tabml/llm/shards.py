"""Ranges of sorted rows with about equal bytes, for writers of sorted files."""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: keys per shard, about, on the driver: a shard is off its bytes by an eighth or so
KEYS_PER_SHARD = 64
#: low bits of a tie by which repeated rows are parted
SALT = 24


def tie(content: Column) -> Column:
    """Order of rows with equal ids: a hash of their content, then a number that parts repeated rows."""
    salt = F.xxhash64(F.monotonically_increasing_id()).bitwiseAND(F.lit((1 << SALT) - 1))
    return F.xxhash64(content).bitwiseAND(F.lit(-1 << SALT)).bitwiseOR(salt)


def byte_borders(keys: DataFrame, shard_bytes: int) -> list[tuple]:
    """The first (none, key, tie) of every shard but the first, of (none, key, tie, size).

    Rows are picked by a hash with a chance in proportion to their size, large ones always, so the picked
    rows stand for equal bytes each. One key may span many shards, as ties part its rows.
    """
    unit = max(1, shard_bytes // KEYS_PER_SHARD)
    chance = F.pmod(F.xxhash64("tie", "key", F.lit(7)), F.lit(1 << 40)) * (unit / (1 << 40))
    picked = keys.where(chance < F.col("size")).select("none", "key", "tie", F.greatest("size", F.lit(unit)).alias("weight")).toArrow()
    rows = sorted(zip(*(picked[c].to_pylist() for c in picked.column_names)))
    borders, held = [], 0
    for none, key, at, weight in rows:
        if held and held + weight > shard_bytes:
            borders.append((none, key, at))
            held = 0
        held += weight
    return borders


def shard_of(borders: list[tuple]):
    """A function of (none, key, tie): the number of a row's shard."""
    known = borders                                        # three values per shard

    @F.pandas_udf("int")
    def shard(none, key, at):
        import pandas as pd
        return pd.Series([bisect_right(known, row) for row in zip(none.tolist(), key.tolist(), at.tolist())], dtype="int32")
    return shard
