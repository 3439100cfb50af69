"""Repair of conversation structure by weighted CYK parsing over spans of turns."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabml.llm.common import spread_join
from tabml.session import materialize

#: characters that end a whole turn, characters that are no content
ENDS, SPACES = ".!?", " \t\n\v\f\r"
#: costs of the edits Keep, Rerole, Delete, Insert, and of a truncated turn that stays
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: what has been said so far: nothing, a system turn, a question, an answer; a conversation may end in the first or last
START, SYSTEM, ASKED, ANSWERED = range(4)
STEPS = {"s": {START: SYSTEM}, "u": {START: ASKED, SYSTEM: ASKED, ANSWERED: ASKED}, "a": {ASKED: ANSWERED}}
LEGAL = {"su", "ua", "au"}
#: rows and bytes of text in a segment, segments that are joined at once
SEGMENT, SEGMENT_BYTES, FAN = 256, 1 << 20, 32
LONG = (1 << 63) - 1

# A cell of the chart says how a span of turns can be repaired: cell[p][q] = (least cost, audits) for the
# nonterminal X_pq, the texts that lead from state p to state q. The grammar is X_pq -> X_pr X_rq, X_pq -> edit of
# a row, X_pq -> inserted turns. All splits of a span give the same cell, so each needs one.


def _least(audits: list[str]) -> list[str]:
    """The audits that may begin or be the least one, whatever follows: the least, and those that go on from it."""
    if len(audits) == 1:
        return audits
    kept: list[str] = []
    for audit in sorted(set(audits)):
        if kept and not audit.startswith(kept[-1]):
            break
        kept.append(audit)
    return kept


def join_cells(left: list, right: list) -> list:
    """The cell of two spans that follow each other."""
    cell = []
    for row in left:
        found: dict = {}
        for r, (cost, heads) in row.items():
            for q, (more, tails) in right[r].items():
                known = found.get(q)
                if known is None or cost + more < known[0]:
                    found[q] = (cost + more, [h + t for h in heads for t in tails])
                elif cost + more == known[0]:
                    known[1].extend([h + t for h in heads for t in tails])
        cell.append({q: (cost, _least(audits)) for q, (cost, audits) in found.items()})
    return cell


def _insertions() -> list:
    """Closure of inserted turns: the fewest that lead from one state to another."""
    cell: list = [{p: (0, [""])} for p in range(4)]
    for p, row in enumerate(cell):
        reached = [p]
        for state in reached:
            for to in (STEPS[i].get(state) for i in "ua"):
                if to is not None and to not in row:
                    row[to] = (row[state][0] + INSERT, [row[state][1][0] + "I"])
                    reached.append(to)
    return cell


INSERTED = _insertions()


@lru_cache(maxsize=4096)
def _row_cell(initial: str, goes: bool, truncated: bool, copies: int) -> list:
    """The cell of one row and what is inserted after it; copies of a row beyond the first must go."""
    cell: list = [{} for _ in range(4)]

    def offer(p, q, cost, audit):
        cell[p][q] = min(cell[p].get(q, (cost, [audit])), (cost, [audit]))
    tail, rest = "D" * (copies - 1), DELETE * (copies - 1)
    for p in range(4):
        offer(p, p, DELETE + rest, "D" + tail)
        if not goes:
            stays = rest + TRUNCATED * truncated
            if p in STEPS.get(initial, {}):
                offer(p, STEPS[initial][p], stays, "K" + tail)
            for to in "ua":
                if p in STEPS[to]:
                    offer(p, STEPS[to][p], REROLE + stays, "R" + tail)
    return join_cells(cell, INSERTED)


def parse(cells: list) -> list:
    """The cell of a row of neighbouring spans, bottom-up by span length."""
    while len(cells) > 1:
        cells = [join_cells(*cells[i:i + 2]) if i + 1 < len(cells) else cells[i] for i in range(0, len(cells), 2)]
    return cells[0]


def cheapest(cell: list) -> tuple[int, str]:
    """(cost, audit) of a whole conversation."""
    whole = join_cells(INSERTED, cell)[START]
    return min((whole[q][0], whole[q][1][0]) for q in (START, ANSWERED) if q in whole)


def _joined(a: dict, b: dict) -> dict:
    """Summary of two parts of a conversation that follow each other."""
    total = {k: a[k] + b[k] for k in ("blank", "duplicate", "truncated", "illegal", "turns", "sizes")}
    total["illegal"] += a["last"] + b["first"] not in LEGAL
    total["turns"] -= a["last_turn"] is not None and a["last_turn"] == b["first_turn"]
    known = [t for t in (a["least_turn"], b["least_turn"]) if t is not None]
    most = [t for t in (a["last_turn"], b["last_turn"]) if t is not None]
    return total | {"first": a["first"], "last": b["last"], "first_turn": a["first_turn"], "least_turn": min(known, default=None),
                    "last_turn": max(most, default=None)}


class _Segment:
    """Rows of one conversation that follow each other, as they come."""

    def __init__(self, key: tuple, part: int, number: int):
        self.key, self.place = key, (part, number)
        self.rows, self.bytes, self.summary = [], 0, None

    def add(self, turn, role: str, text: str, copies: int, blank: bool, seen: bool, truncated: bool) -> None:
        fault = "blank" if blank else "duplicate" if seen else "truncated" if truncated else None
        own = dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        if fault:
            own[fault] = 1 if fault == "truncated" else copies
        own["duplicate"] += copies - 1 if fault in (None, "truncated") else 0
        initial = role[:1]
        own |= {"illegal": copies - 1, "first": initial, "last": initial, "turns": int(turn is not None), "first_turn": turn, "least_turn": turn,
                "last_turn": turn, "sizes": []}
        self.summary = _joined(self.summary, own) if self.summary else own
        self.rows.append((role, text, copies, _row_cell(initial, blank or seen, truncated and not (blank or seen), copies)))
        self.bytes += len(text)

    def close(self) -> tuple:
        roles, texts, copies, cells = zip(*self.rows)
        told = self.summary | {"sizes": [[*self.place, sum(copies)]], "cell": parse(list(cells))}
        return (*self.key, *self.place, _told(told), list(roles), list(texts), list(copies))


def _told(summary: dict) -> str:
    return json.dumps(summary | {"cell": [list(row.items()) for row in summary["cell"]]})


def _heard(text: str) -> dict:
    summary = json.loads(text)
    return summary | {"cell": [{q: (cost, audits) for q, (cost, audits) in row} for row in summary["cell"]]}


def _arrow(rows: list, schema):
    import pyarrow as pa
    columns = zip(*rows) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _pieces(rows: Iterator, schema) -> Iterator:
    """Arrow batches of bounded size from (bytes, row)."""
    held, size = [], 0
    for more, row in rows:
        held.append(row)
        size += more + 200
        if size > 4 << 20:
            yield _arrow(held, schema)
            held, size = [], 0
    if held:
        yield _arrow(held, schema)


def _segments(schema):
    def run(batches: Iterator) -> Iterator:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()

        def closed():
            open = None
            for batch in batches:
                for conv, none, key, *row in zip(*(c.to_pylist() for c in batch.columns)):
                    if open and (open.key[1:] != (none, key) or len(open.rows) >= SEGMENT or open.bytes >= SEGMENT_BYTES):
                        yield open.bytes, open.close()
                        open = _Segment((conv, none, key), part, open.place[1] + 1) if open.key[1:] == (none, key) else None
                    open = open or _Segment((conv, none, key), part, 0)
                    open.add(*row)
            if open:
                yield open.bytes, open.close()
        yield from _pieces(closed(), schema)
    return run


def _merge(parts: DataFrame, by: list) -> DataFrame:
    """Summaries of the parts of a group (at most FAN segments, or FAN partitions) as one."""
    inside = len(by) == 2
    grouped = parts.groupBy("none", "key", *by).agg(F.min("conv").alias("conv"), F.sort_array(F.collect_list(F.struct("part", "no", "summary"))).alias("parts"))

    def run(batches: Iterator) -> Iterator:
        def merged():
            for batch in batches:
                for conv, none, key, parts in zip(*(c.to_pylist() for c in batch.columns)):
                    first, *more = summaries = [_heard(p["summary"]) for p in parts]
                    for other in more:
                        first = _joined(first, other)
                    told = _told(first | {"cell": parse([s["cell"] for s in summaries])})
                    yield len(told), (conv, none, key, parts[0]["part"] // (1 if inside else FAN), parts[0]["no"] // FAN, told)
        yield from _pieces(merged(), schema)
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(parts.schema)
    return grouped.select("conv", "none", "key", "parts").mapInArrow(run, parts.schema)


def _whole(segments: DataFrame) -> DataFrame:
    """One summary per conversation. Long conversations are joined FAN neighbours at a time, the segments
    of each partition first, so none is gathered at once."""
    parts = segments.select("conv", "none", "key", "part", "no", "summary")
    while True:
        most = parts.groupBy("none", "key").agg(F.count("*").alias("n"), F.max("no").alias("no")).agg(F.max("n"), F.max("no")).first()
        if (most[0] or 0) <= FAN:
            return _merge(parts, [])
        by = ["part", F.floor(F.col("no") / FAN)] if most[1] else [F.floor(F.col("part") / FAN)]
        parts = materialize(_merge(parts, by), "repair-parts")


def _reports(schema):
    """Report of each conversation, and the edits of each of its segments."""
    def run(batches: Iterator) -> Iterator:
        def told():
            for batch in batches:
                for conv, none, key, summary in zip(*(c.to_pylist() for c in batch.columns)):
                    s = _heard(summary)
                    cost, audit = cheapest(s["cell"])
                    gaps = 0 if s["last_turn"] is None else min(s["last_turn"] - s["least_turn"] + 1 - s["turns"], LONG)
                    slices, at, after = [], 0, sum(c != "D" for c in audit)
                    for i, (part, no, size) in enumerate(s["sizes"]):
                        end = at
                        while end < len(audit) and (size or audit[end] == "I"):
                            size -= audit[end] != "I"
                            end += 1
                        after -= sum(c != "D" for c in audit[at:end])
                        slices.append((part, no, at, audit[at:end], after))
                        at = end
                    yield 2 * len(audit), (conv, none, key, gaps, *(s[k] for k in ("blank", "duplicate", "truncated", "illegal")), cost, audit,
                                           [dict(zip(("part", "no", "start", "edits", "after"), x)) for x in slices])
        yield from _pieces(told(), schema)
    return run


def _rebuilt(schema):
    """Turns of a repaired segment; roles that are set follow from the number of turns still to come."""
    def run(batches: Iterator) -> Iterator:
        def turns():
            for batch in batches:
                for conv, none, key, roles, texts, copies, start, edits, after in zip(*(c.to_pylist() for c in batch.columns)):
                    rows = iter([(r, t) for r, t, n in zip(roles, texts, copies) for _ in range(n)])
                    left = after + sum(c != "D" for c in edits)
                    for place, edit in enumerate(edits, start):
                        role, text = ("", "") if edit == "I" else next(rows)
                        if edit == "D":
                            continue
                        set_role = "assistant" if left % 2 else "user"
                        left -= 1
                        yield len(text), (conv, none, key, place, edit, role if edit == "K" else set_role, text)
        yield from _pieces(turns(), schema)
    return run


def repair(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(reports, turns): the cheapest repair of every conversation.

    reports: (conv, none, key, gaps, blank, duplicate, truncated, illegal, cost, audit). turns: (conv, none, key,
    place, edit, role, text), the repaired turns in the order of ``place``. ``none`` and ``key`` tell conversations
    apart where ``conv`` is NULL.

    Rows of a conversation are ordered by turn (NULL first), role and a hash of the text. Blank rows and
    rows whose role and text came before must go (3); others stay, get another role (2) or go (3); empty turns
    can be put anywhere (2); a row that stays without an end mark costs 1. What stays must read
    ``(s?(ua)+)?`` by the first letters of its roles. Of the cheapest repairs the one with the least audit
    (letters of the edits D, I, K, R in order) is taken.

    Rows are range-sorted, so a conversation of any length is many tasks: runs of at most SEGMENT rows
    become cells of the chart, which are joined in order. Repeated rows are counted before they move. The
    summary of one conversation, with its audit of a letter a row, must fit a task; its texts need not.

    NULL role or text: one space. NULL conversation ids are one conversation. Very long texts: a segment
    closes behind them. No rows: no rows. Other columns are not looked at.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    space = F.lit(" ")
    rows = df.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role).cast("string"), space).alias("role"),
                     F.coalesce(F.col(text).cast("string"), space).alias("text"))
    rows = rows.withColumns({"none": F.col("conv").isNull(), "key": F.coalesce(F.col("conv").cast("string"), F.lit("")),
                             "mark": F.md5(F.concat(F.char_length("role").cast("string"), F.lit(":"), "role", "text"))})
    counted = rows.groupBy("none", "key", "turn", "mark").agg(
        F.count("*").alias("copies"), F.min("conv").alias("conv"), F.min("role").alias("role"), F.min("text").alias("text"))
    counted = materialize(counted, "repair-turns")

    order = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    first = counted.groupBy("none", "key", "mark").agg(F.min(order).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    seen = F.coalesce(~F.col("first").eqNullSafe(order), F.lit(False)) & F.col("first").isNotNull()
    told = spread_join(counted, first, ["none", "key", "mark"], "left").withColumn("seen", seen)
    trimmed = F.rtrim(F.col("text"), F.lit(SPACES))
    told = told.withColumns({"blank": trimmed == "", "truncated": ~F.right(trimmed, F.lit(1)).isin(*ENDS)})
    by = ["none", "key", "turn", "role", "mark"]
    sorted_rows = told.repartitionByRange(*by).sortWithinPartitions(*by).select(
        "conv", "none", "key", "turn", "role", "text", "copies", "blank", "seen", "truncated")

    own = [rows.schema["conv"], T.StructField("none", T.BooleanType()), T.StructField("key", T.StringType())]
    field = lambda name, kind: T.StructField(name, kind)
    long, string = T.LongType(), T.StringType()
    schema = T.StructType([*own, field("part", long), field("no", long), field("summary", string), field("roles", T.ArrayType(string)),
                           field("texts", T.ArrayType(string)), field("copies", T.ArrayType(long))])
    segments = materialize(sorted_rows.mapInArrow(_segments(to_arrow_schema(schema)), schema), "repair-segments")

    piece = T.StructType([field("part", long), field("no", long), field("start", long), field("edits", string), field("after", long)])
    schema = T.StructType([*own, *(field(c, long) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), field("audit", string),
                           field("pieces", T.ArrayType(piece))])
    reports = _whole(segments).select("conv", "none", "key", "summary").mapInArrow(_reports(to_arrow_schema(schema)), schema)
    reports = materialize(reports, "repair-reports")

    pieces = reports.select("none", "key", F.explode("pieces").alias("piece")).select("none", "key", "piece.*")
    both = spread_join(segments.drop("summary"), pieces, ["none", "key", "part", "no"])
    schema = T.StructType([*own, field("place", long), field("edit", string), field("role", string), field("text", string)])
    turns = both.select("conv", "none", "key", "roles", "texts", "copies", "start", "edits", "after").mapInArrow(_rebuilt(to_arrow_schema(schema)), schema)
    return reports.drop("pieces"), turns


def _digests(batches: Iterator) -> Iterator:
    import hashlib

    import pyarrow as pa

    schema = pa.schema([("none", pa.bool_()), ("key", pa.string()), ("sha256", pa.string())])

    def told():
        open, digest = None, None
        for batch in batches:
            for none, key, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                line = f"{role}:{text}".encode()
                if open == (none, key):
                    digest.update(b"\n" + line)
                    continue
                if open:
                    yield 0, (*open, digest.hexdigest())
                open, digest = (none, key), hashlib.sha256(line)
        if open:
            yield 0, (*open, digest.hexdigest())
    yield from _pieces(told(), schema)


def digests(turns: DataFrame) -> DataFrame:
    """(none, key, sha256): digest of each conversation's ``role:text`` lines, read as a stream, never held at once."""
    rows = turns.repartition("none", "key").sortWithinPartitions("none", "key", "place").select("none", "key", "role", "text")
    return rows.mapInArrow(_digests, "none boolean, key string, sha256 string")
