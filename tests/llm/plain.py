"""Plain versions of the operators on Python lists, to hold the queries against."""

import base64
import hashlib
import itertools
import re
import zlib
from collections import Counter

import xxhash

GAP = re.compile(r"[\x20\x09-\x0D]+")


def words(text):
    return [w for w in GAP.split(text or "") if w]


def warc(pages, least=0):
    """page → (bytes, digest, type, refers_to) for (page, url, html) rows."""
    digest = lambda h: base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()
    first = {}
    for page, _, html in pages:
        if page is not None:
            first[digest(html)] = min(page, first.get(digest(html), page))
    out = []
    for page, _, html in pages:
        size, d = len((html or "").encode()), digest(html)
        origin = first.get(d) if size >= least else None
        revisit = origin is not None and page != origin
        out.append((page, size, d, "revisit" if revisit else "response", origin if revisit else None))
    return sorted(out, key=repr)


def fingerprint(text, size=3):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = words(lowered)
    if not w:
        return 0
    shingles = [" ".join(w[i:i + size]) for i in range(max(1, len(w) - size + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near_duplicates(docs, size=3, radius=2):
    """[(doc, fingerprint, component)] by comparing all fingerprints."""
    prints = [fingerprint(t, size) for _, t in docs]
    distinct = sorted(set(prints))
    root = {p: p for p in distinct}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p
    for a, b in itertools.combinations(distinct, 2):
        if (a ^ b).bit_count() <= radius and find(a) != find(b):
            root[max(find(a), find(b))] = min(find(a), find(b))
    least = {}
    for (doc, _), p in zip(docs, prints):
        if doc is not None:
            least[find(p)] = min(doc, least.get(find(p), doc))
    return [(doc, p, least.get(find(p))) for (doc, _), p in zip(docs, prints)]


def similar_groups(docs, least, size=5):
    """doc → smallest doc of its group, by comparing the shingle sets of all texts."""
    sets, root = {}, {d: d for d, _ in docs}
    for d, text in docs:
        w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[d] = frozenset(tuple(w[i:i + size]) for i in range(max(1, len(w) - size + 1)))

    def find(d):
        while root[d] != d:
            d = root[d]
        return d
    for a, b in itertools.combinations(sorted(sets), 2):
        if len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]) and find(a) != find(b):
            root[max(find(a), find(b))] = min(find(a), find(b))
    return {d: find(d) for d in root}


def base_rules(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = text or ""
    w = words(text)
    lines = [line for line in text.split("\n") if words(line)]
    windows = Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if windows[tuple(w[i:i + 5])] > 1 for j in range(i, i + 5)}
    n, repeated = len(w), len(covered)
    return (n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), repeated, n < 10 or 100 * repeated > 20 * n)


def token_ids(texts, path, end=1):
    from tokenizers import Tokenizer
    return [e.ids + [end] for e in Tokenizer.from_file(path).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def crc(ids):
    return zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))


def check_packing(docs, pieces, path, capacity=2048, most_padding=0.03):
    """Every id in exactly one piece, sequences gapless and within capacity, little padding. ``pieces``:
    (doc, start, length, crc, doc_tokens, sequence, offset); doc ids must differ."""
    ids = dict(zip([d for d, _ in docs], token_ids([t for _, t in docs], path)))
    by_doc, by_sequence = {}, {}
    for doc, start, length, checksum, total, sequence, offset in pieces:
        assert length > 0 and total == len(ids[doc]) and checksum == crc(ids[doc][start:start + length])
        by_doc.setdefault(doc, []).append((start, length))
        by_sequence.setdefault(sequence, []).append((offset, length))
    assert by_doc.keys() == ids.keys()
    for doc, parts in by_doc.items():
        at = 0
        for start, length in sorted(parts):
            assert start == at
            at += length
        assert at == len(ids[doc])
    padding = tokens = 0
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
        tokens += at
        padding += 0 if at & (at - 1) == 0 else capacity - at
    assert padding <= most_padding * (tokens + padding)
    return padding / max(1, tokens + padding)
