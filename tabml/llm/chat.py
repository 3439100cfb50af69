"""Chat formatting: schema fingerprints pick declarative mappings to canonical turns."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabml.llm.common import fresh, named

#: the template: a turn is HEAD + label + ": " + text + END
HEAD, END = "### ", "</turn>\n"
LABELS = {"system": "System", "user": "User", "assistant": "Assistant"}
OTHER = "@"                                     # other roles are written behind this sign
#: control strings, split where the escape goes; one more backslash there escapes, one less restores
CONTROL = [("<", "/turn>"), ("##", "# ")]


@dataclass(frozen=True)
class Mapping:
    """One layout. ``needs`` and ``may`` are field paths (``[]`` steps into a list); a record has this
    layout if exactly the needed and any of the possible paths hold values. Turns are
    read from the list ``turns`` by its ``role`` and ``text`` fields, or from (role, path) ``pairs``,
    of which absent ones give no turn unless they are needed."""

    name: str
    needs: tuple[str, ...]
    may: tuple[str, ...] = ()
    turns: str | None = None
    role: str | None = None
    text: str | None = None
    pairs: tuple[tuple[str, str], ...] = ()
    roles: tuple[tuple[str, str], ...] = ()


#: layouts in common use
MAPPINGS = (
    Mapping("messages", ("messages[].role",), ("messages[].content",), turns="messages", role="role", text="content"),
    Mapping("share", ("conversations[].from",), ("conversations[].value",), turns="conversations", role="from", text="value",
            roles=(("human", "user"), ("gpt", "assistant"))),
    Mapping("prompt", ("prompt", "response"), ("system",), pairs=(("system", "system"), ("user", "prompt"), ("assistant", "response"))),
    Mapping("completion", ("prompt", "completion"), ("system",), pairs=(("system", "system"), ("user", "prompt"), ("assistant", "completion"))),
    Mapping("instruction", ("instruction", "output"), ("system", "input"),
            pairs=(("system", "system"), ("user", "instruction"), ("user", "input"), ("assistant", "output"))),
    Mapping("question", ("question", "answer"), ("system",), pairs=(("system", "system"), ("user", "question"), ("assistant", "answer"))),
)


def field_paths(schema: T.StructType) -> dict[str, Column]:
    """Every leaf path of a schema with a test whether a record holds a value there."""
    found: dict[str, Column] = {}

    def walk(type, path: str, test) -> None:
        if isinstance(type, T.StructType):
            for f in type.fields:
                walk(f.dataType, f"{path}.{f.name}" if path else f.name,
                     lambda use, name=f.name, test=test: test(lambda c: use(c.getField(name) if c is not None else F.col(f"`{name}`"))))
        elif isinstance(type, T.ArrayType):
            walk(type.elementType, path + "[]", lambda use, test=test: test(lambda c: F.exists(c, lambda e: use(e))))
        else:
            found[path] = F.coalesce(test(lambda c: c.isNotNull()), F.lit(False))

    walk(schema, "", lambda use: use(None))
    return found


def schema_fingerprint(schema: T.StructType) -> Column:
    """Hash of the sorted nested field paths that hold a value in a record."""
    paths = field_paths(schema)
    present = [F.when(paths[p], F.lit(p)) for p in sorted(paths)]
    return F.xxhash64(F.concat_ws("\n", *present) if present else F.lit(""))


def _fingerprints_of(mapping: Mapping) -> list[Column]:
    sets = [(*mapping.needs, *more) for n in range(len(mapping.may) + 1) for more in combinations(mapping.may, n)]
    return [F.xxhash64(F.lit("\n".join(sorted(s)))) for s in sets]


def _turn(role: Column, text: Column) -> Column:
    return F.struct(F.coalesce(role.cast("string"), F.lit("")).alias("role"), F.coalesce(text.cast("string"), F.lit("")).alias("text"))


def _turns(mapping: Mapping, columns) -> Column:
    if mapping.turns:
        named = dict(mapping.roles)

        def role(e):
            own, out = e.getField(mapping.role), e.getField(mapping.role)
            for theirs, ours in named.items():
                out = F.when(own == theirs, F.lit(ours)).otherwise(out)
            return out
        return F.transform(F.col(mapping.turns), lambda e: _turn(role(e), e.getField(mapping.text)))
    pairs = [F.when(F.col(p).isNotNull(), _turn(F.lit(r), F.col(p))) for r, p in mapping.pairs if p in columns]
    return F.filter(F.array(*pairs), lambda e: e.isNotNull())


def canonical(df: DataFrame, record: list[str], mappings=MAPPINGS) -> DataFrame:
    """``df`` with ``layout`` and ``turns`` (list of role and text) read from the ``record`` columns.

    Records of many layouts lie in one table as Spark reads them: all fields as columns, NULL where
    a record has none. The hash of the paths that hold a value selects the mapping. An empty or
    unknown layout gives layout NULL and turns NULL; the row stays. NULL text counts as empty.
    Existing columns ``layout`` and ``turns`` that aren't part of the record are replaced.
    """
    record_schema = T.StructType([df.schema[c] for c in record])
    flat = {c.lower() for c in record}
    [mark] = fresh(df.columns, "layout_hash")
    layout, turns = F.lit(None).cast("string"), F.lit(None).cast("array<struct<role:string,text:string>>")
    marked = df.withColumn(mark, schema_fingerprint(record_schema))
    for m in mappings:
        used = [m.turns] if m.turns else [p for _, p in m.pairs if p in m.needs]
        if not all(u.lower() in flat for u in used):
            continue
        if m.turns and not {m.role, m.text} <= set(df.schema[m.turns].dataType.elementType.fieldNames()):
            continue
        fits = F.col(mark).isin(*_fingerprints_of(m))
        layout = F.when(fits, F.lit(m.name)).otherwise(layout)
        turns = F.when(fits, _turns(m, set(record))).otherwise(turns)
    rest = [named(c) for c in df.columns if c.lower() not in ("layout", "turns")]
    return marked.select(*rest, layout.alias("layout"), turns.alias("turns"))


def escaped(text: Column) -> Column:
    for a, b in CONTROL:
        text = F.regexp_replace(text, rf"{a}(\\*){b}", rf"{a}\\$1{b}".replace(r"\\", "\\\\"))
    return text


def restored(text: Column) -> Column:
    for a, b in CONTROL:
        text = F.regexp_replace(text, rf"{a}\\(\\*){b}", f"{a}$1{b}")
    return text


def _head(role: Column) -> Column:
    other = F.regexp_replace(escaped(role), r":(\\*) ", r":\\$1 ".replace(r"\\", "\\\\"))
    label = F.concat(F.lit(OTHER), other)
    for name, shown in LABELS.items():
        label = F.when(role == name, F.lit(shown)).otherwise(label)
    return F.concat(F.lit(HEAD), label, F.lit(": "))


def formatted(df: DataFrame, turns: str = "turns", loss_roles=("assistant",)) -> DataFrame:
    """``df`` with ``formatted`` and ``loss_spans``: the turns as one text and the spans (start,
    length, in characters from 0) of the texts under the loss mask, one per turn of ``loss_roles``,
    without marks. NULL turns give NULL, an empty list an empty text. Columns of these names are
    replaced. One record is one row, so a record must fit one."""
    [parts] = fresh(df.columns, "parts")
    piece = F.transform(F.col(turns), lambda t: F.struct(_head(t["role"]).alias("head"), escaped(t["text"]).alias("text"), t["role"].isin(*loss_roles).alias("loss")))
    span = "array<struct<start:bigint,length:bigint>>"
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(span).alias("spans"))

    def step(acc, p):
        begin, n = acc["at"] + F.char_length(p["head"]), F.char_length(p["text"]).cast("long")
        own = F.array(F.struct(begin.alias("start"), n.alias("length")))
        return F.struct((begin + n + len(END)).alias("at"), F.when(p["loss"], F.concat(acc["spans"], own)).otherwise(acc["spans"]).alias("spans"))

    rest = [named(c) for c in df.columns if c.lower() not in ("formatted", "loss_spans")]
    text = F.array_join(F.transform(F.col(parts), lambda p: F.concat(p["head"], p["text"], F.lit(END))), "")
    return df.withColumn(parts, piece).select(*rest, text.alias("formatted"), F.aggregate(F.col(parts), start, step)["spans"].alias("loss_spans"))


def read_turns(formatted: Column) -> Column:
    """Turns back from a formatted text. END never occurs inside an escaped text, and the first
    ": " of a part ends its head, as roles have it escaped."""
    ends = F.split(formatted, END)
    parts = F.slice(ends, 1, F.size(ends) - 1)

    def turn(p):
        cut = F.instr(p, ": ")
        label = F.substring(p, F.lit(len(HEAD) + 1), cut - 1 - len(HEAD))
        role = restored(F.regexp_replace(F.substring(label, F.lit(2), F.length(label)), r":\\(\\*) ", r":$1 "))
        for name, shown in LABELS.items():
            role = F.when(label == shown, F.lit(name)).otherwise(role)
        return F.struct(role.alias("role"), restored(F.substring(p, cut + 2, F.length(p))).alias("text"))
    return F.transform(parts, turn)


def masked_text(formatted: Column, spans: Column) -> Column:
    """All text under the mask, unescaped span by span, nothing between."""
    return F.array_join(F.transform(spans, lambda s: restored(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")


def format_chats(df: DataFrame, record: list[str], mappings=MAPPINGS, loss_roles=("assistant",)) -> DataFrame:
    """``df`` with layout, turns, formatted and loss_spans; see ``canonical`` and ``formatted``."""
    return formatted(canonical(df, record, mappings), "turns", loss_roles)


def records(rows: DataFrame, id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(id, system, prompt, response, instruction, input, output, messages) from rows of single turns.

    Turns are ordered by ``turn`` (NULL last), ties by role and text. A user's turn and its answer
    become prompt and response, a system turn before them an instruction with its output; all others a
    list of messages. One conversation is one record and one row; a NULL id is a conversation too.
    """
    own = F.struct(F.col(turn).isNull().alias("none"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"),
                   F.coalesce(F.col(text), F.lit("")).alias("content"))
    [all] = fresh(["id"], "all")
    grouped = rows.groupBy(F.col(id).alias("id")).agg(F.sort_array(F.collect_list(own)).alias(all))
    names = F.transform(F.col(all), lambda t: t["role"])
    text_at = lambda i: F.get(F.col(all), F.lit(i))["content"]
    pair = names == F.array(F.lit("user"), F.lit("assistant"))
    told = names == F.array(F.lit("system"), F.lit("user"), F.lit("assistant"))
    only = lambda which, c: F.when(which, c)
    return grouped.select(
        "id", only(told, text_at(0)).alias("system"), only(pair, text_at(0)).alias("prompt"), only(pair, text_at(1)).alias("response"),
        only(told, text_at(1)).alias("instruction"), F.lit(None).cast("string").alias("input"), only(told, text_at(2)).alias("output"),
        only(~(pair | told), F.transform(F.col(all), lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content")))).alias("messages"))
