"""Statistics of whole texts in built-in functions; the input of quality rules and classifier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabml.llm.common import WORD, fresh, own_columns, words_of

#: frequent function words, by language (fixed values)
STOP_WORDS = {
    "en": "a an and are as at be by for from in is it of on or that the this to was with",
    "de": "als auf das dem den der des die ein eine für im in ist mit nicht sich und von zu",
    "fr": "au ce dans de des du en est et il la le les par pas pour que qui un une",
    "es": "con de del el en es la las lo los no para por que se su un una y",
}
SYMBOLS = "[#*$%&|<>]"


def stop_words() -> list[str]:
    return sorted({w for words in STOP_WORDS.values() for w in words.split()})


def ratio(a: Column, b: Column) -> Column:
    """a / b as double, 0 where b is 0."""
    return F.when(b > 0, a.cast("double") / b).otherwise(F.lit(0.0))


def once(value: Column) -> Column:
    """A column that is computed once a row: filters on it are not pushed below, where they would
    compute every step again for each use (a generator of exactly one row)."""
    return F.explode(F.array(value))


def _repeated(words: str, df: DataFrame, window: int) -> tuple[DataFrame, Column]:
    """Words inside windows that occur twice or more in the text: windows are hashed; only texts
    with equal hashes sort (hash, place) packed in a long, compare neighbours in full and add up
    what the found places cover."""
    hashes, bits, packed, places = fresh(df.columns, "hashes", "bits", "packed", "places")
    size = F.size(words)
    df = df.withColumn(hashes, F.when(size >= window, F.transform(
        F.sequence(F.lit(0), size - window), lambda i: F.xxhash64(*[F.get(F.col(words), i + k) for k in range(window)]))))
    df = df.withColumn(bits, F.length(F.bin(F.size(hashes))).cast("int"))
    pack = F.sort_array(F.transform(F.col(hashes), lambda h, i: F.call_function("shiftleft", h, F.col(bits)).bitwiseOR(i.cast("long"))))
    df = df.withColumn(packed, F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), pack))
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), F.col(bits)) - 1
    place = lambda v: v.bitwiseAND(mask).cast("int")
    hash_at = lambda j: F.get(F.col(hashes), place(F.get(F.col(packed), j)))
    equal = F.filter(F.col(packed), lambda v, j: F.coalesce(hash_at(j) == hash_at(j - 1), F.lit(False)) | F.coalesce(hash_at(j) == hash_at(j + 1), F.lit(False)))
    df = df.withColumn(places, F.when(F.col(packed).isNotNull(), F.sort_array(F.transform(equal, place))))
    covered = F.aggregate(
        F.transform(F.col(places), lambda p, j: F.least(F.lit(window), F.coalesce(F.get(F.col(places), j + 1) - p, F.lit(window)))),
        F.lit(0).cast("long"), lambda a, x: a + x)
    return df, F.coalesce(covered, F.lit(0).cast("long"))


#: fields of the statistics, all whole numbers
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MORE = ["n_chars", "n_stop_words", "n_lines", "n_distinct_words", "n_upper", "n_marks", "n_digits", "n_bars"]


def with_stats(df: DataFrame, text: str, into: str, more: bool = True, window: int = 5) -> DataFrame:
    """``df`` with a struct column ``into`` of the statistics of ``text``; NULL counts as empty.

    Words are runs without ASCII white space, characters are code points. word_chars: characters in
    words; n_dup_lines: lines with a word that equal an earlier line; n_repeat_words: words in windows
    of ``window`` words found twice or more, the first included; with ``more`` also characters, stop
    words, lines with a word, distinct words, upper-case letters, ! and ? marks, digits and bars.
    """
    columns = own_columns(df)
    whole, words, lines = fresh(df.columns, "whole", "words", "lines")
    df = df.withColumn(whole, F.coalesce(F.col(text).cast("string"), F.lit("")))
    df = df.withColumn(words, words_of(F.col(whole)))
    df = df.withColumn(lines, F.filter(F.split(F.col(whole), "\n"), lambda line: line.rlike(WORD)))
    df, repeated = _repeated(words, df, window)
    found = lambda pattern: F.regexp_count(F.col(whole), F.lit(pattern)).cast("long")
    fields = {
        "n_words": F.size(words).cast("long"),
        "word_chars": F.char_length(F.array_join(words, "")).cast("long"),
        "n_symbols": found(SYMBOLS),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        "n_repeat_words": repeated,
        "n_stop_words": F.size(F.filter(F.col(words), lambda w: F.lower(w).isin(*stop_words()))).cast("long"),
        "n_lines": F.size(lines).cast("long"),
        "n_chars": F.char_length(whole).cast("long"),
    }
    if more:
        fields |= {
            "n_distinct_words": F.size(F.array_distinct(words)).cast("long"),
            "n_upper": found(r"\p{Lu}"), "n_marks": found("[!?]"), "n_digits": found("[0-9]"), "n_bars": found(r"\|"),
        }
    return df.select(*columns, once(F.struct(*[c.alias(n) for n, c in fields.items()])).alias(into))
