"""License scans: winnowed template fingerprints pick candidates, banded alignment tells spans."""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabml.llm.license_texts import TEMPLATES

#: words per fingerprint and fingerprints per window: a shared run of GRAM + WINDOW - 1 words is always met
GRAM, WINDOW = 3, 2
#: how far an alignment may drift from its diagonal, and the covered share of a template that is reported
BAND, COVERAGE = 6, 0.7
#: words of all templates together, which bounds what every task holds
MAX_TEMPLATE_WORDS = 200_000

TOKEN = re.compile(rb"[^\x20\x09-\x0D]+")
#: templates of so many words are looked for in every window, longer ones by their fingerprints
SHORT = 16
#: the word before a license's short name in a source file
SPDX = b"spdx-license-identifier"
EDGE = b".,;:!?\"'()[]{}<>"


def _plain(word: bytes) -> bytes:
    return word.strip(EDGE) or word


def _hashes(ids):
    """A number per GRAM of template words; those with a word that no template has get the largest."""
    import numpy as np

    n = len(ids) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, good = np.zeros(n, np.uint64), np.ones(n, bool)
    for k in range(GRAM):
        part = ids[k:k + n].astype(np.uint64)
        good &= part > 0
        out = (out ^ (part * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(29)
    out[~good] = np.iinfo(np.uint64).max
    return out


def _winnowed(hashes):
    """Places of the smallest hash of every WINDOW, the last of equal ones."""
    import numpy as np

    if len(hashes) <= WINDOW:
        return np.array([len(hashes) - 1 - int(np.argmin(hashes[::-1]))]) if len(hashes) else np.zeros(0, np.int64)
    views = np.lib.stride_tricks.sliding_window_view(hashes, WINDOW)
    return np.unique(np.arange(len(views)) + WINDOW - 1 - np.argmin(views[:, ::-1], axis=1))


def _aligned(template, text, shift: int, band: int):
    """Banded local alignment of a template to the words of a text around one diagonal:
    (matched template words, first, last matched word of the text)."""
    width = 2 * band + 1
    score, match, first, last = ([[0] * width for _ in range(len(template) + 1)] for _ in range(4))
    top = (0, 0, -1, -1)
    for i in range(1, len(template) + 1):
        for d in range(width):
            j = i - 1 + shift + d - band                # word of the text that meets template word i
            options = []
            if 0 <= j < len(text):
                same = template[i - 1] == text[j]
                s, m, f = score[i - 1][d], match[i - 1][d], first[i - 1][d]
                options.append((s + (2 if same else -1), m + same, (f if m else j) if same else f, j if same else last[i - 1][d]))
            if d + 1 < width:
                options.append((score[i - 1][d + 1] - 1, match[i - 1][d + 1], first[i - 1][d + 1], last[i - 1][d + 1]))
            if d:
                options.append((score[i][d - 1] - 1, match[i][d - 1], first[i][d - 1], last[i][d - 1]))
            s, m, f, l = max(options, default=(0, 0, 0, 0))
            if s <= 0 or not m:
                s, m, f, l = 0, 0, 0, 0
            score[i][d], match[i][d], first[i][d], last[i][d] = s, m, f, l
            if (s, m) > top[:2]:
                top = (s, m, f, l)
    return top[1:]


def _between(spans: list[tuple[int, int]], low: int, high: int) -> list[tuple[int, int]]:
    """The parts of low to high that no span covers; spans are in order and apart."""
    parts = []
    for first, end in spans[max(0, bisect_left(spans, (low, low)) - 1):]:
        if first >= high:
            break
        if first > low:
            parts.append((low, first))
        low = max(low, end)
    return parts + [(low, high)] if low < high else parts


class _Index:
    """Templates as word numbers and the inverted index of their winnowed fingerprints."""

    def __init__(self, templates: dict[str, str]):
        import numpy as np

        self.words: dict[bytes, int] = {}
        self.templates = []
        for name, text in sorted(templates.items()):
            self.templates.append((name, [self.words.setdefault(_plain(w), len(self.words) + 1) for w in text.encode().lower().split()]))
        self.postings: dict[int, list[tuple[int, int]]] = {}
        for t, (_, words) in enumerate(self.templates):
            hashes = _hashes(np.array(words, np.int64))
            for place in range(len(hashes)) if len(hashes) < 2 * WINDOW else _winnowed(hashes).tolist():
                self.postings.setdefault(int(hashes[place]), []).append((t, place))
        self.keys = np.array(sorted(self.postings), np.uint64)
        self.sizes = np.array([len(words) for _, words in self.templates])
        self.holds = np.zeros((len(self.templates), len(self.words) + 1), bool)      # which words a template has
        for t, (_, words) in enumerate(self.templates):
            self.holds[t, words] = True

    def _dense(self, ids, band: int, coverage: float) -> list[tuple[int, int]]:
        """(template, diagonal) wherever a window that an alignment can reach holds as many words of a template as
        it must cover: no place is missed that shares no fingerprint, as its matches are too far apart."""
        import numpy as np

        found, member = [], self.holds[:, ids]
        for t in np.flatnonzero((self.sizes <= SHORT) & (member.sum(axis=1) >= np.ceil(coverage * self.sizes - 1e-9))).tolist():
            need, span = int(np.ceil(coverage * self.sizes[t] - 1e-9)), int(self.sizes[t]) + 2 * band
            places = np.flatnonzero(member[t])
            first, last = places[:len(places) - need + 1], places[need - 1:]
            near = last - first < span
            told, least = -span, need - int(self.sizes[t]) + len(set(self.templates[t][1]))
            for i in np.flatnonzero(near).tolist():
                low, high = int(last[i]) - span + 1, int(first[i])                             # windows that begin from low to high
                if len(set(ids[places[places.searchsorted(low):places.searchsorted(high + span)]].tolist())) < least:
                    continue                                                                   # repeats of a few words
                for begin in (*range(max(low, told + band + 1), high, band + 1), high):        # a band reaches as far to both sides
                    if begin > told:
                        told = begin
                        found.append((t, begin + band))
        return found

    def scan(self, raw: bytes, band: int, coverage: float) -> list[tuple]:
        import numpy as np

        words = raw.lower().split()
        get = self.words.get
        ids = np.array([get(w) or get(_plain(w), 0) for w in words], np.int64)
        hashes = _hashes(ids)
        met = np.flatnonzero(np.isin(hashes, self.keys))
        found: dict[tuple[int, int], int] = {}
        for place in met.tolist():
            for t, at in self.postings[int(hashes[place])]:
                found.setdefault((t, place - at), place)
        near = [key for key in self._dense(ids, band, coverage) if key not in found] if len(ids) else []
        rows, text, spans = [], ids.tolist(), None
        told: dict[int, list[tuple[int, int]]] = {}            # spans of a template, in order
        for t, shift in sorted(found) + near:
            name, template = self.templates[t]
            own = told.setdefault(t, [])
            parts = _between(own, max(0, shift - band), min(len(text), shift + len(template) + band))
            while parts:
                low, high = parts.pop()
                if high - low < coverage * len(template):
                    continue
                matched, first, last = _aligned(template, text[low:high], shift - low, band)
                if matched and matched >= coverage * len(template):
                    if spans is None:
                        spans = [m.span() for m in TOKEN.finditer(raw)]
                    first, end = low + first, low + last + 1
                    insort(own, (first, end))
                    parts += [(low, first), (end, high)]
                    a, b = spans[first][0], spans[end - 1][1]
                    rows.append((name, matched, len(template), first, end, len(raw[:a].decode()), len(raw[:b].decode())))
        return _closest(rows) + _identifiers(raw, words)


def _closest(rows: list[tuple]) -> list[tuple]:
    """Of places that overlap, those of a like template that fits less are left out: a version 3 notice is no
    version 2 notice, though all words but one are the same."""
    rows = sorted(rows, key=lambda r: r[3:5])
    keep = [True] * len(rows)
    for i, a in enumerate(rows):
        for j in range(i + 1, len(rows)):
            b = rows[j]
            if b[3] >= a[4]:
                break
            for k, (one, other) in ((i, (a, b)), (j, (b, a))):
                if other[1] * one[2] > one[1] * other[2] and 5 * other[2] >= 4 * one[2]:
                    keep[k] = False
    return [r for r, kept in zip(rows, keep) if kept]


def _identifiers(raw: bytes, words: list[bytes]) -> list[tuple]:
    """Places of ``SPDX-License-Identifier: name``."""
    if SPDX not in raw.lower():
        return []
    places = [i for i, w in enumerate(words[:-1]) if _plain(w) == SPDX]
    if not places:
        return []
    spans, rows = [m.span() for m in TOKEN.finditer(raw)], []
    for i in places:
        a, b = spans[i][0], spans[i + 1][1]
        name = _plain(raw[spans[i + 1][0]:b]).decode()
        rows.append((f"SPDX:{name}", 2, 2, i, i + 2, len(raw[:a].decode()), len(raw[:b].decode())))
    return rows


def _scanner(shared, band: int, coverage: float, schema):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        index = _Index(shared.value)
        for batch in batches:
            rows = [(id.as_py(), *row) for id, text in zip(batch.column(0), batch.column(1).cast(pa.binary()))
                    for row in index.scan(text.as_py() or b"", band, coverage)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
    return run


def scan(df: DataFrame, id: str = "doc_id", text: str = "text", templates: dict[str, str] | None = None, band: int = BAND,
         coverage: float = COVERAGE) -> DataFrame:
    """(id, license, matched_words, template_words, coverage, first_word, end_word, begin, end): one row
    per place where the best local alignment of a template (2 for a word that fits, -1 for one that does not,
    drifting by ``band`` words at most) covers at least ``coverage`` of the template's words.

    Words are compared in lower case (A-Z) without punctuation at their ends. Every fingerprint of a
    text that the inverted index of winnowed template fingerprints knows makes a candidate; so does every
    window with enough words of a template of at most SHORT words, as scattered changes leave no
    fingerprint there (a longer one is met by any run of GRAM + WINDOW - 1 words). A banded alignment
    around the candidate's diagonal tells matched words and span (words and characters, end exclusive).
    Of overlapping places of templates of about one length only those stay that fit best. The two words
    ``SPDX-License-Identifier: name`` give a row with license ``SPDX:name``.

    Texts are scanned whole, each in its own task without any exchange; what tasks share is the templates, at
    most MAX_TEMPLATE_WORDS words. A very long text is held by its task as a few numbers per word and template.
    NULL and empty texts give no rows. NULL ids and repeated rows are scanned like others. No rows: no rows.
    Templates under three words are refused. Other columns are not looked at.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    import pyarrow as pa

    templates = TEMPLATES if templates is None else templates
    sizes = [len(t.split()) for t in templates.values()]
    if sum(sizes) > MAX_TEMPLATE_WORDS or any(n < GRAM for n in sizes):
        raise ValueError(f"templates need {GRAM} words each and may have {MAX_TEMPLATE_WORDS} together")
    rows = df.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text"))
    schema = T.StructType([T.StructField("id", rows.schema["id"].dataType), T.StructField("license", T.StringType()),
                           *[T.StructField(n, T.LongType()) for n in ("matched_words", "template_words", "first_word", "end_word", "begin", "end")]])
    shared = df.sparkSession.sparkContext.broadcast(templates)
    found = rows.mapInArrow(_scanner(shared, band, coverage, pa.schema(to_arrow_schema(schema))), schema)
    return found.withColumn("coverage", F.col("matched_words") / F.col("template_words"))
