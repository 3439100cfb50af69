"""Edge cases of the operators on documents: NULLs, empty and long texts, repeats, empty tables."""

import random

import plain
import pytest
from pyspark.sql import functions as F

from tabml.llm import mixing, packing, simhash
from tabml.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, component long, size long, ids string"


def frame(spark, docs):
    rows = [(d, t, None, s, None, 7, 7, "x") for d, t, s in docs]
    return spark.createDataFrame(rows, SCHEMA)


def invented(n, seed=1):
    pick = random.Random(seed)
    word = lambda: "".join(pick.choice("abcdeéß") for _ in range(pick.randint(1, 6)))
    return [" ".join(word() for _ in range(pick.randint(0, 60))) for _ in range(n)]


@pytest.fixture(scope="module")
def docs():
    texts = invented(60)
    near = [texts[5] + " end", texts[5] + " End", texts[5]]
    long = " ".join(invented(400, seed=2))
    odd = [None, "", " \n\t ", "one", "one two", "ONE\ttwo\x0bthree", "a b", "\U0001F600 ok", long, long]
    every = texts + near + odd
    rows = [(i, t, random.Random(i).choice(["a", "b", None])) for i, t in enumerate(every)]
    return rows + [rows[3], (None, texts[5], "a"), (None, None, None), (None, "lonely words of no id", "b")]


def test_near_duplicates_equal_all_comparisons(spark, docs):
    found = simhash.near_duplicates(frame(spark, docs)).collect()
    got = sorted(((r.id, r.fingerprint % (1 << 64), r.component) for r in found), key=repr)
    assert got == sorted(plain.near_duplicates([d[:2] for d in docs]), key=repr)


def test_chains_of_fingerprints_join_and_wide_balls_too(spark):
    chain = [0b0, 0b11, 0b1111, 0b111111, 1 << 63, (1 << 63) | (1 << 62) | 7 << 40]
    prints = spark.createDataFrame([(c - (1 << 64) if c >> 63 else c,) for c in chain], "fingerprint long")
    assert {tuple(sorted(r)) for r in simhash.links(prints).collect()}
    from tabml.llm.components import components
    roots = {r.node: r.root for r in components(simhash.links(prints)).collect()}
    assert len({roots[c] for c in (0, 3, 15, 63)}) == 1 and ((1 << 63 | 1 << 62 | 7 << 40) - (1 << 64)) not in roots
    assert {r.node for r in components(simhash.links(prints, 4)).collect()} >= {0, 15, 63}
    with pytest.raises(ValueError):
        simhash.links(prints, 3)


def test_components_of_a_long_path(spark):
    from tabml.llm.components import components
    order = random.Random(3).sample(range(1000), 200)
    edges = spark.createDataFrame([(max(a, b), min(a, b)) for a, b in zip(order, order[1:])], "a long, b long")
    assert {r.root for r in components(edges).collect()} == {min(order)}


def test_one_row_of_each_group_stays(spark, docs):
    pick = random.Random(8)
    base = [f"w{pick.randint(0, 400)}" for _ in range(120)]
    near = [(500 + i, " ".join([*base[:i], f"new{i}", *base[i + 1:]]).title(), "s") for i in range(20, 60)]
    every = docs + near + [(499, " ".join(base), "s"), (600, " ".join(reversed(base)), "s")]
    kept = simhash.representatives(frame(spark, every))
    assert kept.columns == frame(spark, every).columns
    rows = kept.collect()
    ids = [r.doc_id for r in rows if r.doc_id is not None]
    assert len(ids) == len(set(ids)) and {499, 600} <= set(ids) and not set(range(520, 560)) & set(ids)
    groups = plain.similar_groups([(d, t) for d, t, _ in every if d is not None], 0.8)
    assert set(ids) == set(groups.values())
    assert sorted(r.text for r in rows if r.doc_id is None) == ["lonely words of no id"]


def test_nothing_in_nothing_out(spark):
    empty = frame(spark, [])
    assert simhash.near_duplicates(empty).count() == 0 and simhash.representatives(empty).count() == 0
    assert mixing.mix(empty).count() == 0 and mixing.mixed(empty).count() == 0
    assert packing.pack(empty, tokenizer_path()).count() == 0


def test_packing_places_every_id_once(spark, docs):
    numbered = [(i, t, s) for i, (_, t, s) in enumerate(docs)]
    pieces = packing.pack(frame(spark, numbered).repartition(3, "doc_id"), tokenizer_path())
    rows = pieces.select("id", "start", "length", F.crc32("ids"), "doc_tokens", "sequence_id", "offset").collect()
    plain.check_packing([d[:2] for d in numbered], [tuple(r) for r in rows], tokenizer_path())
    whole = packing.pack(frame(spark, docs), tokenizer_path())
    assert whole.where("id is null and start = 0").count() == 3 and whole.where("id = 3 and start = 0").count() == 2


def test_word_ids_equal_the_tokenizer_on_odd_texts():
    from tokenizers import Tokenizer
    tokenizer, words = Tokenizer.from_file(tokenizer_path()), packing.WordIds(tokenizer_path())
    odd = ["", "a", "it's we'll 'tis O'Neil", "ÀÉÎ ñandú ß ẞ İstanbul", "café é", "x y z \u0085", "a\x1cb c\x1f", "1st 2nd 33",
           "<|endoftext|> a<|startoftext|>b", "!!! ... wow... (yes)", "日本語 한국어", "\U0001F600\U0001F3FD ok", "Ω Σίσυφος ΣΑΣ", "a" * 3000, "﻿bom", "x,y;z"]
    odd.append(" ".join(odd))
    for text in odd + invented(30, seed=9):
        assert words.plain and words.encode([text.encode()], 1)[0].tolist() == tokenizer.encode(text, add_special_tokens=False).ids + [1], text
    words.forget()
    words.plain = False
    assert [x.tolist() for x in words.encode([t.encode() for t in odd], 1)] == [tokenizer.encode(t, add_special_tokens=False).ids + [1] for t in odd]


@pytest.mark.parametrize("capacity", [8, 100, 2048])
def test_cuts_fill_their_slots(capacity):
    for length in range(1, 3 * capacity):
        pieces = packing.cut_lengths(length, capacity)
        assert sum(pieces) == length and all(capacity - capacity // p * p <= max(capacity // p, capacity / 32) for p in pieces)


def plain_targets(sizes, weights=(1, 2, 3), cap=3):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, total = {}, sum(sizes.values())
    while True:
        rest = [s for s in order if s not in target]
        left, shares = total - sum(target.values()), sum(weight[s] for s in rest)
        over = [s for s in rest if left * weight[s] / shares > cap * sizes[s]]
        if not over:
            return target | {s: left * weight[s] / shares for s in rest}
        target |= {s: cap * sizes[s] for s in over}


def check_mix(docs, rows):
    sizes = {}
    for _, text, source in docs:
        sizes[source] = sizes.get(source, 0) + len(plain.words(text))
    want = plain_targets(sizes)
    assert len(rows) == len(docs)
    taken = {}
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source]) and 0 <= r.taken <= 3 * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    return want, taken


def test_mix_cuts_at_the_exact_budget(spark, docs):
    distinct = [(i, t, s) for i, (_, t, s) in enumerate(docs)]
    rows = mixing.mix(frame(spark, distinct)).collect()
    want, taken = check_mix(distinct, rows)
    for source, words in taken.items():
        assert words == round(want[source])
    assert sorted(rows, key=repr) == sorted(mixing.mix(frame(spark, distinct[::-1])).collect(), key=repr)


def test_mix_of_unequal_and_empty_sources(spark):
    some = [(1, "a " * 5, "z"), (2, "b " * 100, "a"), (3, None, "none"), (4, "c", None), (5, "", None)]
    check_mix(some, mixing.mix(frame(spark, some)).collect())
    assert mixing.mix(frame(spark, [(1, None, "a")])).first().taken == 0


def test_mix_of_repeated_rows(spark):
    many = [(1, "a b c", "s")] * 50 + [(2, "d e f g", "t")]
    want, taken = check_mix(many, mixing.mix(frame(spark, many)).collect())
    assert all(abs(words - want[s]) <= 50 for s, words in taken.items())


def test_mix_with_many_ranges_and_without_broadcast(spark, monkeypatch):
    texts = invented(300, seed=4)
    many = [(i, t, "hot" if i % 3 else "cold") for i, t in enumerate(texts)]
    before = sorted(mixing.mix(frame(spark, many)).collect(), key=repr)
    monkeypatch.setattr(mixing, "RANGE_ROWS", 7)
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert sorted(mixing.mix(frame(spark, many)).collect(), key=repr) == before


def test_mixed_repeats_whole_documents(spark, docs):
    distinct = [(i, t, s) for i, (_, t, s) in enumerate(docs)]
    df = frame(spark, distinct)
    times = {r.id: r.taken // r.size for r in mixing.mix(df, whole_documents=True).collect() if r.size}
    out = mixing.mixed(df)
    assert out.columns == df.columns
    got = {}
    for r in out.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
    assert got == {d: n for d, n in times.items() if n}


def test_packing_workers_hold_one_vocabulary_and_few_runs():
    """The bound on remembered runs holds for a text of many distinct words, and ids stay those of the tokenizer."""
    from tabml.llm import packing
    from tabml.llm.queries import tokenizer_path

    words = packing.WordIds(tokenizer_path())
    assert words.plain and packing.KNOWN_RUNS <= 1 << 17 and words.short.model.__getstate__() == words.tokenizer.model.__getstate__()
    letters = "abcdefghij"
    for part in range(6):
        text = " ".join("x" + "".join(letters[int(d)] for d in str(part * 40_000 + i)) for i in range(40_000))
        [ids] = words.encode([text.encode()], 1)
        assert len(words.run_places) <= packing.KNOWN_RUNS + 40_001
    probe = "Some words, and OTHERS ###"
    assert words.encode([probe.encode()], 1)[0].tolist() == [*words.tokenizer.encode(probe, add_special_tokens=False).ids, 1]
