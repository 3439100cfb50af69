"""Near copies against brute force at exactly the wanted similarity."""

import random

import numpy as np
import plain

from tabml.llm import simhash


def block_edits(seed=5, bases=10):
    """Texts with copies that differ by one contiguous block, the overlap falling from 0.97 to 0.70."""
    dice, rows = random.Random(seed), []
    word = lambda: f"w{dice.randrange(4000)}"
    for base in range(bases):
        words = [word() for _ in range(dice.choice([40, 150, 400]))]
        rows.append((base * 10, " ".join(words)))
        for k, part in enumerate((0.03, 0.08, 0.12, 0.16, 0.19, 0.22, 0.25, 0.3)):
            block = [word() for _ in range(int(len(words) * part))]
            at = dice.choice([0, len(words) // 3, len(words)])
            rows.append((base * 10 + 1 + k, " ".join(words[:at] + block + words[at:])))
    return rows


def star(spark, rows, similarity=0.8):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return {r.id: r.component for r in simhash.similar_texts(df, similarity=similarity).collect()}


def test_clear_block_edits_join(spark):
    """Longer texts at 0.84 and above, one copy each."""
    rows = [(i, t) for i, t in block_edits(bases=20) if i % 10 in (0, 1 + (i // 10) % 3)]
    long = {i // 10 for i, t in rows if i % 10 == 0 and len(t.split()) > 100}
    rows = [(i, t) for i, t in rows if i // 10 in long]
    assert set(star(spark, rows).values()) == {10 * base for base in long}


def test_block_edits_are_all_found(spark):
    rows = block_edits()
    # one base with one edit each: the edits are not joined through other copies of the base
    alone = [(i, t) for i, t in rows if i % 10 == 0 or i % 10 == 1 + (i // 10) % 8]
    for some in (rows, alone):
        assert star(spark, some) == plain.similar_groups(some, 0.8)


def test_members_of_a_bucket_with_an_unlike_head(spark):
    """All texts share a passage, few overlap enough, and the first is like none of them."""
    dice = random.Random(9)
    word = lambda: f"w{dice.randrange(10 ** 6)}"
    passage = [word() for _ in range(120)]
    rows = [(0, " ".join(passage))]
    for family in range(12):
        own = [word() for _ in range(100)]
        for copy in range(3):
            rows.append((1 + family * 3 + copy, " ".join(passage + own + [word() for _ in range(4 * copy)])))
    wanted = plain.similar_groups(rows, 0.8)
    assert len(set(wanted.values())) == 13 and star(spark, rows) == wanted


def test_a_chain_is_followed_inside_a_bucket(spark):
    """t is like the head and like u, u is not like the head: all three are one group."""
    words = [f"w{i}" for i in range(240)]
    rows = [(k, " ".join(words[12 * k:12 * k + 150])) for k in range(8)]
    assert star(spark, rows) == plain.similar_groups(rows, 0.8)


def test_the_bound_is_exact(spark):
    """Short texts at 0.75 to 0.79 and long ones at about 0.78 stay apart, 0.8 itself joins."""
    rows = []
    for k, (shared, extra) in enumerate([(76, 24), (79, 21), (80, 20), (780, 220), (796, 204), (800, 200)]):
        words = [f"t{k}x{i}" for i in range(shared + extra + 4)]
        rows += [(2 * k, " ".join(words[:shared + 4])), (2 * k + 1, " ".join(words))]
    wanted = plain.similar_groups(rows, 0.8)
    assert [wanted[2 * k + 1] == 2 * k for k in range(6)] == [False, False, True, False, False, True]
    assert star(spark, rows) == wanted


def test_the_order_of_shingles_does_not_matter(spark, monkeypatch):
    rows = block_edits(seed=7, bases=5)
    wanted = plain.similar_groups(rows, 0.8)
    for sample, often, slots in ((1, 1, 1 << 22), (1, 2, 16)):
        for name, value in (("SAMPLE", sample), ("OFTEN", often), ("SLOTS", slots)):
            monkeypatch.setattr(simhash, name, value)
        assert star(spark, rows) == wanted


def test_a_bucket_of_many_unlike_texts(spark):
    """Half a thousand texts share a passage; few pairs overlap enough, and none with the first text."""
    dice = random.Random(3)
    word = lambda: f"w{dice.randrange(10 ** 6)}"
    passage = [word() for _ in range(60)]
    rows = [(i, " ".join(passage + [word() for _ in range(60)])) for i in range(500)]
    rows += [(1000 + i, rows[i][1] + " and more") for i in range(7, 500, 50)]
    assert star(spark, rows) == plain.similar_groups(rows, 0.8)


def test_many_groups_and_remembered_texts(spark, monkeypatch):
    rows = block_edits(seed=11, bases=4)
    rows += [(i + 500, t) for i, t in rows]                # exact copies that no worker remembers
    for name, value in (("ENTRIES", 50), ("SEEN", 0)):
        monkeypatch.setattr(simhash, name, value)
    assert star(spark, rows) == plain.similar_groups(rows, 0.8)


def test_texts_in_runs(monkeypatch):
    """However a long text is cut, hash and shingles are those of its words."""
    dice = random.Random(2)
    for text in [b"", b" ", b"A b", b"a b c d", b"  x\ty\n", b" ".join(b"w%d" % dice.randrange(50) for _ in range(300)), b"z" * 500 + b" a b c d e f"]:
        monkeypatch.setattr(simhash, "RUN_BYTES", 1 << 18)
        whole = simhash._shingles(text, 5)
        for size in (1, 7, 64):
            monkeypatch.setattr(simhash, "RUN_BYTES", size)
            part = simhash._shingles(text, 5)
            assert part[0] == whole[0] and part[1].tolist() == whole[1].tolist()


def test_simhash_joins_near_copies_before_prefixes_are_looked_at(spark, monkeypatch):
    """Texts within two bits meet by SimHash; what whole sets refuse is not joined, and the rest is still found."""
    dice, rows = random.Random(3), []
    for base in range(12):
        words = [f"w{dice.randrange(10 ** 6)}" for _ in range(3000)]
        rows += [(3 * base, " ".join(words)), (3 * base + 1, " ".join(words[:-1])), (3 * base + 2, " ".join(words[:2500]))]
    rows += [(900, "a b c d e"), (901, "v w x y z"), (902, ""), (903, None)]
    given, own = [], simhash._similar_links

    def spied(members, confirmed, similarity, near):
        given.extend((r.a, r.b) for r in near.collect())
        return own(members, confirmed, similarity, near)
    monkeypatch.setattr(simhash, "_similar_links", spied)
    assert star(spark, rows) == plain.similar_groups(rows, 0.8)
    found = {i: simhash._shingles((t or "").encode(), 5) for i, t in rows}
    prints = {i: simhash._print_of(h) for i, (_, h) in found.items() if len(h)}
    close = [(3 * b, 3 * b + 1) for b in range(12) if (prints[3 * b] ^ prints[3 * b + 1]).bit_count() <= 2]
    assert close and all(any({found[i][0], found[j][0]} == set(p) for p in given) for i, j in close)
    assert all(a > b for a, b in given)


def test_the_driver_does_not_hold_the_counts(spark, monkeypatch):
    rows = block_edits(seed=13, bases=3)
    df = spark.createDataFrame(rows, "doc_id long, text string")

    def refuse(self):
        raise AssertionError("the counts came to the driver")
    monkeypatch.setattr(type(df), "toArrow", refuse)
    assert star(spark, rows) == plain.similar_groups(rows, 0.8)
    monkeypatch.setattr(simhash, "SAMPLE", 1)
    docs = df.selectExpr("xxhash64(text) AS mark", "text")
    wanted = np.zeros(simhash.SLOTS, np.int64)
    for _, text in set((0, t) for _, t in rows):
        hashes = simhash._shingles(text.encode(), 5)[1]
        np.add.at(wanted, (hashes.view(np.uint64) % np.uint64(simhash.SLOTS)).astype(np.int64), 1)
    counts, _ = simhash._read_counts(simhash._counts(docs, 5).scratch, simhash.SLOTS, simhash.BLOCK)
    assert (counts == wanted).all()
