"""Conversation repair against a search over all edits, and in pieces of every size."""

import hashlib
import itertools
import random
import re

import pytest

from tabml.llm import conversation_repair as cr

WHOLE = re.compile(r"(s?(ua)+)?\Z")


def ordered(rows):
    """Rows (turn, role, text) as the operator sorts them, NULLs as one space."""
    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    mark = lambda r, x: hashlib.md5(f"{len(r)}:{r}{x}".encode()).hexdigest()
    return sorted(rows, key=lambda y: (y[0] is not None, y[0] or 0, y[1], mark(y[1], y[2])))


def plain(rows):
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, lines) by trying every edit from left to right: the
    best for each (row, what was said), kept as all least-cost audits with their lines."""
    rows = ordered(rows)
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    faults, seen = [], set()
    for _, role, text in rows:
        body = text.rstrip(" \t\n\v\f\r")
        faults.append("b" if not body else "d" if (role, text) in seen else "t" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    initials = [r[:1] for _, r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    best = None
    for cost, audit, lines in _all(rows, faults, 0, "", 2 * len(rows) + 2):
        if best is None or (cost, audit) < best[:2]:
            best = (cost, audit, lines)
    return (gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, *(best or (0, "", [])))


def _all(rows, faults, i, said, inserts):
    """Every repair of the rows from i on; ``said``: initials so far."""
    if said and not re.match(r"s?(ua)*u?\Z", said):
        return
    if i == len(rows) and WHOLE.match(said):
        yield 0, "", []
    if inserts and (not said.endswith("xx")):
        for role in ("user", "assistant"):
            if re.match(r"s?(ua)*u?\Z", said + role[0]) and len(said) < 2 * len(rows) + 2:
                for c, a, lines in _all(rows, faults, i, said + role[0], inserts - 1):
                    yield c + 2, "I" + a, [f"{role}:", *lines]
    if i < len(rows):
        _, role, text = rows[i]
        more = faults[i] == "t"
        for c, a, lines in _all(rows, faults, i + 1, said, inserts):
            yield c + 3, "D" + a, lines
        if faults[i] not in ("b", "d"):
            if role[:1] in ("s", "u", "a"):
                for c, a, lines in _all(rows, faults, i + 1, said + role[:1], inserts):
                    yield c + more, "K" + a, [f"{role}:{text}", *lines]
            for to in ("user", "assistant"):
                for c, a, lines in _all(rows, faults, i + 1, said + to[0], inserts):
                    yield c + 2 + more, "R" + a, [f"{to}:{text}", *lines]


SCHEMA = "conv_id long, turn long, role string, text string, `none` string, `a.key` int"


def run(spark, rows):
    """{conv: (gaps, ..., audit, lines)} by the operator."""
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(3)
    reports, turns = cr.repair(df)
    lines: dict = {}
    for t in turns.orderBy("place").collect():
        lines.setdefault(t.conv, []).append(f"{t.role}:{t.text}")
    return {r.conv: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, lines.get(r.conv, [])) for r in reports.collect()}


def grouped(rows):
    return {c: [r[1:] for r in rows if r[0] == c] for c in {r[0] for r in rows}}


def drawn(seed, count, most):
    rng = random.Random(seed)
    roles, texts = ["user", "assistant", "system", "tool", "", None, "u", "ass"], ["Hi.", "And", " \n", "", None, "No?", "So ! ", "x　", "Hi.\v"]
    rows = []
    for conv in [None, *range(count)]:
        for k in range(rng.randint(1, most)):
            rows.append((conv, rng.choice([None, k, k, k + 3, 0]), rng.choice(roles[:3] if rng.random() < 0.7 else roles), rng.choice(texts)))
    return rows


def test_equals_a_search_over_all_edits(spark):
    rows = drawn(1, 60, 3)
    rows += [rows[5], rows[5], rows[9]]
    assert run(spark, rows) == {c: plain(r) for c, r in grouped(rows).items()}


def linear(rows):
    """Cost and audit by a table from the last row to the first, for conversations too long to search."""
    rows = ordered(rows)
    seen, best = set(), {cr.START: (0, ""), cr.ANSWERED: (0, "")}
    faults = []
    for _, role, text in rows:
        body = text.rstrip(cr.SPACES)
        faults.append((not body or (role, text) in seen, bool(body) and body[-1] not in ".!?"))
        seen.add((role, text))

    def closed(best):
        for _ in range(3):
            for p in range(4):
                for i in "ua":
                    if p in cr.STEPS[i] and cr.STEPS[i][p] in best:
                        c, a = best[cr.STEPS[i][p]]
                        best[p] = min(best.get(p, (c + 2, "I" + a)), (c + 2, "I" + a))
        return best
    best = closed(best)
    for (_, role, _), (goes, cut) in zip(reversed(rows), reversed(faults)):
        now = {}
        for p in range(4):
            options = [(best[p][0] + 3, "D" + best[p][1])]
            for i, letter, cost in [(role[:1], "K", 0), ("u", "R", 2), ("a", "R", 2)]:
                if not goes and p in cr.STEPS.get(i, {}):
                    c, a = best[cr.STEPS[i][p]]
                    options.append((c + cost + cut, letter + a))
            now[p] = min(options)
        best = closed(now)
    return best[cr.START]


@pytest.mark.parametrize("segment,fan", [(1, 2), (3, 2), (256, 32)])
def test_long_conversations_in_pieces(spark, monkeypatch, segment, fan):
    monkeypatch.setattr(cr, "SEGMENT", segment)
    monkeypatch.setattr(cr, "FAN", fan)
    rows = drawn(7, 4, 60)
    got = run(spark, rows)
    for c, own in grouped(rows).items():
        gaps, blank, duplicate, truncated, illegal, cost, audit, lines = got[c]
        assert (cost, audit) == linear(own)
        initials = "".join(line[:1] for line in lines)
        assert WHOLE.match(initials) and len(lines) == len(audit) - audit.count("D")
        assert len(audit) - audit.count("I") == len(own)


def test_the_plain_table_equals_the_search():
    for c, own in grouped(drawn(3, 80, 3)).items():
        assert linear(own) == plain(own)[5:7], own


def test_an_audit_that_goes_on_from_another_is_kept():
    """Cells keep audits that begin the least one with some continuation: whole-chart minima equal the table's."""
    for roles in itertools.product("sua", repeat=5):
        rows = [(k, r, f"{k}.") for k, r in enumerate(roles)]
        cells = [cr._row_cell(r, False, False, 1) for r in roles]
        left = cells[0]
        for cell in cells[1:]:
            left = cr.join_cells(left, cell)
        assert cr.cheapest(cr.parse(cells)) == cr.cheapest(left) == linear(rows)


def test_nothing_copies_and_long_texts(spark):
    assert run(spark, []) == {}
    long = "word " * 300_000 + "."
    rows = [(1, 1, "user", long), (1, 2, "assistant", "Yes."), *[(2, 1, "user", "Hi.")] * 500, (2, 2, "assistant", "Yo.")]
    got = run(spark, rows)
    assert got[1] == (0, 0, 0, 0, 0, 0, "KK", ["user:" + long, "assistant:Yes."])
    assert got[2] == (0, 0, 499, 0, 499, 3 * 499, "K" + "D" * 499 + "K", ["user:Hi.", "assistant:Yo."])
    assert run(spark, [(3, None, None, None), (3, -(1 << 63), "user", "a"), (3, (1 << 63) - 1, "user", "b.")])[3][0] == (1 << 63) - 1


def test_digests_read_streams(spark):
    df = spark.createDataFrame([(1, 0, "user", "Ä.", "", 0), (1, 1, "assistant", "b\n.", "", 0), (None, 0, "tool", "", "", 0)], SCHEMA)
    _, turns = cr.repair(df)
    got = {(r.none, r.key): r.sha256 for r in cr.digests(turns).collect()}
    assert got == {(False, "1"): hashlib.sha256("user:Ä.\nassistant:b\n.".encode()).hexdigest()}
