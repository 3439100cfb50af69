"""Harmonic packing of tokenized documents into fixed-length sequences."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: a piece may leave this share of its slot empty; else it is cut to the next smaller slot
TOLERANCE = 1 / 32
#: runs of letters whose ids a worker remembers, and bytes of text that are looked up at once
KNOWN_RUNS, LOOKUP_BYTES = 120_000, 1 << 20
#: bytes of ids that are sent back at once
BATCH_BYTES = 4 << 20
#: a word of letters that normalisation leaves alone but for their case, then punctuation that starts no contraction
PLAIN = r"^(?P<run>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<rest>[.,;:!?*#$%&()|]*)$"


class _Ragged:
    """Growing arrays of ids, one after the other."""

    def __init__(self):
        import numpy as np

        self.count = self.used = 0
        self.starts, self.lengths, self.ids = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64), np.zeros(1 << 14, np.uint32)

    def extend(self, lengths, ids) -> None:
        import numpy as np

        def room(a, n):
            return a if n <= len(a) else np.concatenate([a, np.zeros(max(n, 2 * len(a)) - len(a), a.dtype)])
        n, m = self.count + len(lengths), self.used + len(ids)
        self.starts, self.lengths, self.ids = room(self.starts, n), room(self.lengths, n), room(self.ids, m)
        self.starts[self.count:n] = self.used + np.cumsum(lengths) - lengths
        self.lengths[self.count:n], self.ids[self.used:m] = lengths, ids
        self.count, self.used = n, m

    def take(self, places):
        """(ids of the places in a row, length of each)."""
        import numpy as np

        lengths = self.lengths[places]
        stops = np.cumsum(lengths)
        total = int(stops[-1]) if len(places) else 0
        return self.ids[np.arange(total) + np.repeat(self.starts[places] - (stops - lengths), lengths)], lengths


class WordIds:
    """Token ids of texts, by word. The tokenizer drops white space and never looks across it,
    so ids of a text are the ids of its words in a row, and each word is encoded once.

    Words are split, told apart and cut into a letter run and the punctuation behind it by Arrow, many
    at a time; Python looks at distinct lower-case runs only. Runs that are new to the worker are encoded
    together without the tokenizer's normalisation, which would not change them. Other words go through
    the whole tokenizer, and so do all if a probe shows that the short way gives other ids.
    """

    def __init__(self, path: str):
        import numpy as np
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.short = Tokenizer(self.tokenizer.model)                    # the same vocabulary, held once
        self.short.normalizer = normalizers.Sequence([])
        self.short.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.final = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items():
            self.final[i] = token.endswith("</w>")
        probe = "Plain, ÀÉÿß words! Of### unequal LENGTH, x and internationalisation;"
        self.plain = True
        self.forget()
        self.plain = self.encode([probe.encode()], 1)[0].tolist() == [*self._whole(probe), 1]
        self.forget()

    def forget(self) -> None:
        self.run_ids, self.run_places = _Ragged(), {"": 0}
        self.run_ids.extend([0], [])

    def _whole(self, word: str) -> list[int]:
        return self.tokenizer.encode(word, add_special_tokens=False).ids

    def _add_whole(self, words: list[str]) -> None:
        each = [self._whole(w) for w in words]
        self.run_ids.extend([len(e) for e in each], [i for e in each for i in e])

    def _add_runs(self, runs: list[str]) -> None:
        import numpy as np

        for start in range(0, len(runs), 256):
            part = runs[start:start + 256]
            ids = np.array(self.short.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.flatnonzero(self.final[ids]) + 1
            if len(ends) == len(part) and ends[-1] == len(ids):
                self.run_ids.extend(np.diff(ends, prepend=0), ids)
            else:                                                   # not told apart by word ends: one by one
                self._add_whole(part)

    def _places(self, column, add, mark: str = ""):
        """Places in ``run_ids`` of the strings of a column; ``add`` encodes those that are new. Words that are
        encoded whole are known under a name that no run has."""
        import numpy as np

        told = column.dictionary_encode()
        strings = told.dictionary.to_pylist()
        names = [mark + x for x in strings] if mark else strings
        at = list(map(self.run_places.get, names))
        if None in at:
            new = [i for i, p in enumerate(at) if p is None]
            first = self.run_ids.count
            add([strings[i] for i in new])
            for p, i in enumerate(new, first):
                at[i] = self.run_places[names[i]] = p
        return np.array(at, np.int64)[told.indices.to_numpy()]

    def encode(self, texts, end: int) -> list:
        """Ids of UTF-8 texts (an Arrow array of strings, or bytes) as arrays of unsigned 32-bit numbers,
        each with ``end`` after it; NULL is empty."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        if not isinstance(texts, pa.Array):
            texts = pa.array(texts, pa.large_binary()).cast(pa.large_string())
        split = pc.ascii_split_whitespace(texts)
        told = split.flatten().dictionary_encode()
        if len(self.run_places) > KNOWN_RUNS:
            self.forget()
        parts = pc.extract_regex(told.dictionary, PLAIN)
        plain = parts.is_valid() if self.plain else pa.array(np.zeros(len(parts), bool))
        own, runs = plain.to_numpy(zero_copy_only=False), parts.filter(plain)
        places = np.zeros((len(parts), 2), np.int64)
        places[own, 0] = self._places(pc.utf8_lower(runs.field("run")), self._add_runs)
        places[own, 1] = self._places(runs.field("rest"), self._add_runs)
        places[~own, 0] = self._places(told.dictionary.filter(pc.invert(plain)), self._add_whole, "\n")
        ids, lengths = self.run_ids.take(places[told.indices.to_numpy()].ravel())
        sums = np.concatenate([[0], np.cumsum(lengths)])
        stops = sums[2 * np.cumsum(pc.list_value_length(split).fill_null(0).to_numpy())].tolist()
        return [np.append(ids[a:b], np.uint32(end)) for a, b in zip([0, *stops[:-1]], stops)]


def slices(texts) -> Iterator[tuple[int, int]]:
    """Ranges of an Arrow array of texts with a bounded number of bytes; a longer text is alone."""
    import pyarrow.compute as pc

    start, size = 0, 0
    for i, length in enumerate(pc.binary_length(texts).fill_null(0).to_pylist()):
        if i > start and size + length > LOOKUP_BYTES:
            yield start, i
            start, size = i, 0
        size += length
    if len(texts) > start:
        yield start, len(texts)


def cut_lengths(length: int, capacity: int, tolerance: float = TOLERANCE) -> list[int]:
    """Lengths that a document is cut into: whole sequences, then pieces that nearly fill a
    reciprocal of the capacity each."""
    pieces = [capacity] * (length // capacity)
    rest = length % capacity
    while rest:
        count = capacity // rest
        piece = rest if capacity - count * rest <= tolerance * capacity else capacity // (count + 1)
        pieces.append(piece)
        rest -= piece
    return pieces


class _Bins:
    """Bins of one worker: those of class k close when they hold k pieces."""

    def __init__(self, first: int, capacity: int):
        self.next, self.capacity, self.open = first, capacity, {}

    def put(self, piece: tuple) -> list[tuple]:
        count = self.capacity // len(piece[2])
        held = self.open.setdefault(count, [])
        held.append(piece)
        if len(held) < count:
            return []
        del self.open[count]
        return self._close(held, count)

    def _close(self, pieces: list[tuple], count: int) -> list[tuple]:
        rows, offset = [], 0
        for id, start, ids, tokens in pieces:
            rows.append((id, start, len(ids), ids.tobytes(), tokens, self.next, offset, count))
            offset += len(ids)
        self.next += 1
        return rows

    def rest(self) -> Iterator[list[tuple]]:
        """What never filled a bin of its class (a bounded number of pieces) goes end to end into
        full sequences; the remainder becomes sequences whose lengths are powers of two."""
        pieces = [p for count in sorted(self.open) for p in self.open[count]]
        left = sum(len(p[2]) for p in pieces)
        rooms = [self.capacity] * (left // self.capacity) + [1 << b for b in range(left.bit_length(), -1, -1) if (left % self.capacity) >> b & 1]
        pieces.reverse()
        for room in rooms:
            bin = []
            while room:
                id, start, ids, tokens = pieces.pop()
                if len(ids) > room:
                    pieces.append((id, start + room, ids[room:], tokens))
                    ids = ids[:room]
                bin.append((id, start, ids, tokens))
                room -= len(ids)
            yield self._close(bin, 0)


def _packer(path: str, capacity: int, end: int, schema):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        words = WordIds(path)
        bins = _Bins(TaskContext.get().partitionId() << 40, capacity)

        def batch_of(rows: list[tuple]):
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        rows, held = [], 0
        for batch in batches:
            names, texts = batch.column(0), batch.column(1).cast(pa.large_string())
            for a, b in slices(texts):
                for id, ids in zip(names[a:b].to_pylist(), words.encode(texts[a:b], end)):
                    start = 0
                    for length in cut_lengths(len(ids), capacity):
                        rows += bins.put((id, start, ids[start:start + length], len(ids)))
                        start += length
                    held += 4 * len(ids)
                    if held > BATCH_BYTES:
                        if rows:
                            yield batch_of(rows)
                        rows, held = [], 0
        for more in bins.rest():
            rows += more
        if rows:
            yield batch_of(rows)
    return run


def pack(df: DataFrame, tokenizer: str, id: str = "doc_id", text: str = "text", capacity: int = 2048, end: int = 1) -> DataFrame:
    """(id, start, length, ids, doc_tokens, sequence_id, offset, class): one row per piece.

    ``ids`` holds the piece's tokens as little-endian unsigned 32-bit numbers. A document is its
    tokens, then ``end``. Class k takes pieces of lengths in (capacity/(k+1), capacity/k], and a
    bin of it is full with k pieces. Cuts are free, so a remainder that would waste more than
    1/32 of its slot is cut at the next reciprocal. Workers fill bins on their own partition
    without any exchange; what stays over in a worker (class 0) is laid end to end, and its tail
    becomes sequences of power-of-two length. Sequence ids name partition and bin.

    NULL or empty text: the end token alone. NULL ids and repeated rows are packed like others.
    No rows: no rows. A very long text is held by its task once, as ids. Other columns are not
    looked at. ``tokenizer`` is a file for the tokenizers library whose words end in </w>, which
    drops white space.
    """
    import pyarrow as pa

    rows = df.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text"))
    schema = T.StructType([
        T.StructField("id", rows.schema["id"].dataType), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
        T.StructField("ids", T.BinaryType()), T.StructField("doc_tokens", T.LongType()), T.StructField("sequence_id", T.LongType()),
        T.StructField("offset", T.LongType()), T.StructField("class", T.LongType())])
    from pyspark.sql.pandas.types import to_arrow_schema
    return rows.mapInArrow(_packer(tokenizer, capacity, end, pa.schema(to_arrow_schema(schema))), schema)
