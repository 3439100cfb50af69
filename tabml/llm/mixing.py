"""Mixing sources to target weights by hash order, prefix sums and one cut per source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabml.llm.common import fresh, own_columns, spread_join, words_of
from tabml.session import materialize

#: documents per range of keys; a source has as many ranges as it needs
RANGE_ROWS = 4096
#: the plan is broadcast up to so many sources and characters of their names
BROADCAST_SOURCES, BROADCAST_CHARS = 10_000, 1_000_000
#: keys are the first 13 hex digits of an md5: whole numbers below 2^52
KEY_SPAN = float(1 << 52)


def _key(id: Column, text: Column, seed: str) -> Column:
    """Hash-random place of a document in its source's order; the same on every run."""
    told = F.concat(F.lit(seed + "|"), F.coalesce(id.cast("string"), F.lit("")), F.lit("|"), F.md5(F.coalesce(text, F.lit(""))))
    return F.conv(F.substring(F.md5(told), 1, 13), 16, 10).cast("long")


def targets(sources: DataFrame, weights=(1, 2, 3), cap: int = 3) -> DataFrame:
    """(source, source_size) → the same with ``target``: all sizes shared by weight, where no
    source exceeds ``cap`` times its size and the excess is reshared among the others.

    Sources by code point, NULL last, weigh ``weights`` in turn. Sorted by capacity per weight,
    the sources that reach their cap are the first ones; the rest share what is left by weight.
    One row per source, so the running sums here are over the list of sources only.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source"))
    turn = F.array(*[F.lit(float(w)) for w in weights])
    weighed = sources.withColumn("place", place).withColumn("weight", F.get(turn, (F.col("place") - 1) % len(weights)))
    weighed = weighed.withColumn("most", cap * F.col("source_size").cast("double"))
    before = Window.orderBy(F.col("most") / F.col("weight"), "place").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    told = weighed.select(
        "*", F.row_number().over(Window.orderBy(F.col("most") / F.col("weight"), "place")).alias("turn"),
        (F.sum("source_size").over(every).cast("double") - F.coalesce(F.sum("most").over(before), F.lit(0.0))).alias("left"),
        (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))).alias("weights"))
    open_turn = F.when(F.col("most") * F.col("weights") > F.col("weight") * F.col("left"), F.struct("turn", "left", "weights"))
    told = told.withColumn("open", F.min(open_turn).over(every))
    shared = F.col("weight") * F.col("open.left") / F.col("open.weights")
    target = F.when(F.col("open").isNotNull() & (F.col("turn") >= F.col("open.turn")), shared).otherwise(F.col("most"))
    return told.select("source", "source_size", target.alias("target"))


def _sized(df: DataFrame, id: str, text: str, source: str, size: Column | None, seed: str) -> DataFrame:
    words = F.size(words_of(F.col(text))).cast("long") if size is None else size.cast("long")
    return df.select(F.col(id).alias("id"), F.col(source).alias("source"), words.alias("size"), _key(F.col(id), F.col(text), seed).alias("key"))


def plan(rows: DataFrame, weights=(1, 2, 3), cap: int = 3) -> DataFrame:
    """One row per source of (source, size, key): source_size, target, full ``epochs``, the ``cut``
    key, the words ``rest`` that remain for documents at the cut, and their ``cut_size`` in all.

    Documents before the cut are taken once more than ``epochs``, those after it not. Prefix sums
    are taken over ranges of keys, which split a source of any size, and over single keys only
    in the one range that holds the cut.
    """
    units = materialize(rows.groupBy("source", "key").agg(F.sum("size").alias("size"), F.count("*").alias("n")), "mix-units")
    sources = units.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum("n").alias("n"))
    aims = targets(sources.select("source", "source_size"), weights, cap).withColumnsRenamed({"source": "s", "source_size": "of"})
    aims = materialize(sources.join(aims, F.col("source").eqNullSafe(F.col("s")), "left").drop("s", "of"), "mix-targets")
    whole = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(whole / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    aims = aims.withColumn("epochs", epochs).withColumn("budget", whole - F.col("epochs") * F.col("source_size"))
    aims = aims.withColumn("ranges", F.ceil(F.col("n") / RANGE_ROWS)).drop("n")

    def keyed(df: DataFrame) -> DataFrame:      # NULL is a source like any other
        return df.withColumns({"some": F.col("source").isNotNull(), "name": F.coalesce(F.col("source").cast("string"), F.lit(""))}).drop("source")

    aims = keyed(aims)
    ranged = spread_join(keyed(units), aims.select("some", "name", "ranges", "budget"), ["some", "name"])
    ranged = ranged.withColumn("range", F.least(F.floor(F.col("key") / F.lit(KEY_SPAN) * F.col("ranges")), F.col("ranges") - 1))
    sums = ranged.groupBy("some", "name", "range").agg(F.sum("size").alias("words"), F.max("budget").alias("budget"))
    up_to = Window.partitionBy("some", "name").orderBy("range")
    sums = sums.withColumn("until", F.sum("words").over(up_to)).withColumn("before", F.col("until") - F.col("words"))
    cut_range = materialize(sums.where("before <= budget and until > budget").select("some", "name", "range", "before"), "mix-ranges")
    inside = spread_join(ranged, cut_range, ["some", "name", "range"])
    in_order = Window.partitionBy("some", "name").orderBy("key")
    inside = inside.withColumn("from", F.col("before") + F.sum("size").over(in_order) - F.col("size"))
    cuts = inside.where("from <= budget and from + size > budget").select(
        "some", "name", F.col("key").alias("cut"), (F.col("budget") - F.col("from")).alias("rest"), F.col("size").alias("cut_size"))
    return materialize(aims.join(cuts, ["some", "name"], "left").drop("budget", "ranges"), "mix-plan")


def _with_plan(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Rows with their source's plan: broadcast while the plan is known to be small, so that
    texts stay where they are; a join whose hot sources can be split beyond that."""
    told = sources.agg(F.count("*"), F.sum(F.length("name"))).first()
    if told[0] <= BROADCAST_SOURCES and (told[1] or 0) <= BROADCAST_CHARS:
        return rows.join(F.broadcast(sources), ["some", "name"])
    return spread_join(rows, sources, ["some", "name"])


def _taken(whole_documents: bool) -> Column:
    """Words that the mix takes of a document, all repeats counted."""
    at_cut = F.floor(F.col("rest") * F.col("size") / F.col("cut_size"))
    if whole_documents:
        at_cut = F.when(2 * F.col("rest") >= F.col("cut_size"), F.col("size")).otherwise(F.lit(0))
    more = F.when(F.col("key") < F.col("cut"), F.col("size")).when(F.col("key") == F.col("cut"), at_cut).otherwise(F.lit(0))
    return (F.col("epochs") * F.col("size") + more).cast("long")


def mix(df: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", weights=(1, 2, 3), cap: int = 3,
        size: Column | None = None, whole_documents: bool = False, seed: str = "mix") -> DataFrame:
    """(id, source, size, source_size, target, taken) per row of ``df``.

    Every source is ordered by hash keys and read again and again up to its target; the document
    at the cut is taken in part, so the words taken are the target rounded to whole words, or as
    a whole if that comes nearer and ``whole_documents`` is set. Keys come from id and text, so
    reruns agree.

    NULL text has size 0 and is taken 0 times; a NULL source is a source, the last one; a source
    without words has target 0. Rows repeated with id and text share a key: at the cut they share
    the rest in proportion. No rows: no rows. Other columns are not looked at.
    """
    rows = materialize(_sized(df, id, text, source, size, seed), "mix-rows")
    named = rows.withColumns({"some": F.col("source").isNotNull(), "name": F.coalesce(F.col("source").cast("string"), F.lit(""))})
    told = _with_plan(named, plan(rows.select("source", "size", "key"), weights, cap))
    return told.select("id", "source", "size", "source_size", "target", _taken(whole_documents).alias("taken"))


def mixed(df: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", weights=(1, 2, 3), cap: int = 3,
          seed: str = "mix") -> DataFrame:
    """The mix itself: rows of ``df`` with all their columns, each as often as whole documents of
    the mix take it (see ``mix``). Documents without words stay out, as no budget asks for them."""
    rows = _sized(df, id, text, source, None, seed)
    sources = plan(rows.select("source", "size", "key"), weights, cap)
    names = fresh(df.columns, "some", "name", "size", "key")
    some, name, size, key = names
    own = df.withColumns({
        some: F.col(source).isNotNull(), name: F.coalesce(F.col(source).cast("string"), F.lit("")),
        size: F.size(words_of(F.col(text))).cast("long"), key: _key(F.col(id), F.col(text), seed)})
    packed = own.select(F.struct(*own_columns(df)).alias("row"), *[F.col(n).alias(m) for n, m in zip(names, ("some", "name", "size", "key"))])
    told = _with_plan(packed, sources).where("size > 0")
    times = (_taken(True) / F.col("size")).cast("int")
    return told.select("row", F.explode(F.array_repeat(F.lit(1), times)).alias("again")).select("row.*")
