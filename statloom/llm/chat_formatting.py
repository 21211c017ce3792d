"""Chat formatting: records of different layouts become canonical turns, then marked text.

A record's schema fingerprint is a hash of the nested field paths that it fills, among those that
some layout names (``messages[].role`` is the role of the elements of an array).  A table from
fingerprints to layouts is made once from the declarations in ``LAYOUTS``, so that choosing the
mapping is a lookup; each mapping is a projection that gives the record's turns.  Records whose
fingerprint no layout has are not guessed at: ``unmapped`` returns them.

A turn is written as ``<|im_start|>role\\ntext<|im_end|>\\n``, and a conversation's text is that
of its turns in order.  Inside texts and roles a backslash is added between ``<`` and ``|``
(behind those that are there), so that the two marks occur nowhere else and reading back takes
one backslash away; roles also escape line ends.  The loss mask is the text of the turns of the
assistant, as a start and a length in code points of the turn's formatted text.

Turns are formatted where their records lie; only then are they brought together, in order, to
be digested: a task reads them one after another and holds a batch, however long a conversation.

Defined results: null texts and roles are empty; turns of a conversation are ordered by turn
(null last), then by place in the record, role and text, so repeated rows are turns each; a null
conv_id is a conversation; fields of a layout that are null count as absent, other columns play no
part; a record with fields of two layouts is unmapped; a record that fills no field of any layout is an
empty turn where the table has a role or text column, else unmapped; no records give no rows.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

START, END = "<|im_start|>", "<|im_end|>"
LOSS_ROLE = "assistant"


@dataclass(frozen=True)
class Layout:
    """How records of one layout become turns.

    ``turns`` has (role, paths): the texts at the paths, joined by an empty line, are a turn of
    that role; a role that begins with ``@`` is read at that path.  With ``each`` there is such a
    turn for every element of that array, and paths are those of an element.
    """

    name: str
    turns: tuple[tuple[str, tuple[str, ...]], ...]
    optional: tuple[str, ...] = ()
    each: str = ""
    roles: tuple[tuple[str, str], ...] = ()

    def paths(self) -> list[str]:
        own = [p for role, texts in self.turns for p in (*([role[1:]] if role.startswith("@") else []), *texts)]
        return sorted({f"{self.each}[].{p}" if self.each else p for p in own})

    def fingerprints(self) -> list[int]:
        """Of every set of paths that a record of this layout may fill."""
        fixed = [p for p in self.paths() if p not in self.optional]
        some = [p for p in self.paths() if p in self.optional]
        least = 1 if self.each else 0  # a record whose array fills nothing is not known by it
        return [fingerprint_of([*fixed, *extra]) for n in range(least, len(some) + 1) for extra in itertools.combinations(some, n)]


#: What the makers of dialogue records call the two sides.
SPEAKERS = (("human", "user"), ("prompter", "user"), ("gpt", "assistant"), ("bot", "assistant"), ("model", "assistant"))

LAYOUTS = (
    Layout("turn", (("@role", ("text",)),), optional=("role", "text")),
    Layout("completion", (("system", ("system",)), ("user", ("prompt",)), ("assistant", ("completion",))), optional=("system",)),
    Layout("response", (("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",))), optional=("system",)),
    Layout("instruction", (("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",))), optional=("system", "input")),
    Layout("question", (("system", ("context",)), ("user", ("question",)), ("assistant", ("answer",))), optional=("context",)),
    Layout("nested", (("user", ("request.text",)), ("assistant", ("reply.text",)))),
    Layout("messages", (("@role", ("content",)),), optional=("messages[].role", "messages[].content"), each="messages", roles=SPEAKERS),
    Layout("dialogue", (("@from", ("value",)),), optional=("conversations[].from", "conversations[].value"), each="conversations", roles=SPEAKERS),
)


def fingerprint_of(paths: list[str]) -> int:
    """The hash of a set of paths, as Spark's xxhash64 gives it."""
    digest = xxhash.xxh64("\n".join(sorted(paths)).encode(), seed=42).intdigest()
    return digest - (1 << 64) if digest >> 63 else digest


def _some(array: Column, name: str) -> Column:
    """Whether some element of an array of structs fills a field."""
    return F.coalesce(F.exists(array, lambda x: x[name].isNotNull()), F.lit(False))


def leaves(schema: T.StructType, above: Column | None = None, name: str = "") -> Iterator[tuple[str, Column]]:
    """(path, whether the record fills it) of every leaf of a schema."""
    for field in schema:
        value = F.col(f"`{field.name}`") if above is None else above[field.name]
        path, kind = f"{name}{field.name}", field.dataType
        if isinstance(kind, T.StructType):
            yield from leaves(kind, value, f"{path}.")
        elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
            for inner in kind.elementType:
                yield f"{path}[].{inner.name}", _some(value, inner.name)
        else:
            yield path, value.isNotNull()


def fingerprint(records: DataFrame, layouts: tuple[Layout, ...] = LAYOUTS) -> Column:
    """The schema fingerprint of each record."""
    known = {p for layout in layouts for p in layout.paths()}
    present = sorted((path, filled) for path, filled in leaves(records.schema) if path in known) if known else []
    return F.xxhash64(F.concat_ws("\n", *(F.when(filled, F.lit(path)) for path, filled in present)))


def _at(path: str, above: Column | None = None) -> Column:
    for part in path.split("."):
        above = F.col(f"`{part}`") if above is None else above[part]
    return above


def _turns(layout: Layout, there: set[str]) -> Column:
    """array<struct<role, text>> of a record of the layout; fields that the table lacks are null."""

    def turn(role: str, texts: tuple[str, ...], above: Column | None) -> Column:
        value = lambda path: _at(path, above).cast("string") if (f"{layout.each}[].{path}" if layout.each else path) in there else F.lit(None).cast("string")
        said = value(role[1:]) if role.startswith("@") else F.lit(role)
        named = said
        for other, canonical in layout.roles:
            named = F.when(F.lower(said) == other, F.lit(canonical)).otherwise(named)
        parts = [value(p) for p in texts]
        text = parts[0] if len(parts) == 1 else F.concat_ws("\n\n", *(F.when(p != "", p) for p in parts))
        absent = F.lit(False) if role.startswith("@") else F.coalesce(*parts).isNull()
        return F.struct(F.coalesce(named, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"), absent.alias("absent"))

    if layout.each:
        return F.transform(_at(layout.each), lambda x: turn(*layout.turns[0], x))
    return F.filter(F.array(*(turn(role, texts, None) for role, texts in layout.turns)), lambda t: ~t["absent"])


def _mapped(records: DataFrame, layouts: tuple[Layout, ...]) -> tuple[DataFrame, list[Layout], set[str]]:
    """The records with the number of their layout, the layouts that this table can have, and its paths."""
    there = {path for path, _ in leaves(records.schema)}
    able = [x for x in layouts if all(p in there for p in x.paths() if p not in x.optional) and there & set(x.paths())]
    number = {f: i for i, x in reversed([*enumerate(able)]) for f in x.fingerprints()}
    if not number:
        return records.withColumn("layout_no", F.lit(None).cast("int")), able, there
    table = F.create_map(*(F.lit(x) for pair in number.items() for x in pair))
    return records.withColumn("layout_no", F.try_element_at(table, fingerprint(records, layouts))), able, there


def unmapped(records: DataFrame, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """The records that no layout fits, with their fingerprint."""
    found, _, _ = _mapped(records, layouts)
    return found.where("layout_no is null").select(*(F.col(f"`{c}`") for c in records.columns), fingerprint(records, layouts).alias("fingerprint"))


def canonical_turns(records: DataFrame, conv: str = "conv_id", turn: str = "turn", layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """conv_id, turn, place (in the record), layout, role and text of every turn of the records that a layout fits."""
    found, able, there = _mapped(records, layouts)
    turns = F.lit(None).cast("array<struct<role:string,text:string,absent:boolean>>")
    name = F.lit(None).cast("string")
    for i, layout in enumerate(able):
        turns = F.when(F.col("layout_no") == i, _turns(layout, there)).otherwise(turns)
        name = F.when(F.col("layout_no") == i, F.lit(layout.name)).otherwise(name)
    keys = [F.col(f"`{conv}`").alias("conv_id"), F.col(f"`{turn}`").alias("turn")]
    rows = found.where("layout_no is not null").select(*keys, name.alias("layout"), F.posexplode(turns).alias("place", "said"))
    return rows.select("conv_id", "turn", "place", "layout", "said.role", "said.text")


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def _line_of(role: Column, back: bool = False) -> Column:
    """The role on one line: backslashes are doubled and line ends written as a backslash and n; or back again."""
    steps = [("\\", "\\\\"), ("\n", "\\n")]
    if back:  # a line has no line end of its own, so one can begin the two signs that stand in between
        steps = [("\\\\", "\n0"), ("\\n", "\n1"), ("\n0", "\\"), ("\n1", "\n")]
    for old, new in steps:
        role = F.replace(role, F.lit(old), F.lit(new))
    return role


def formatted_turns(turns: DataFrame) -> DataFrame:
    """The turns with formatted (their marked text) and loss_start, loss_length (their part of the loss mask)."""
    head, body = F.concat(F.lit(START), _line_of(escaped(F.col("role"))), F.lit("\n")), escaped(F.col("text"))
    loss = F.col("role") == LOSS_ROLE
    return turns.select(
        "conv_id", "turn", "place", F.concat(head, body, F.lit(END + "\n")).alias("formatted"),
        F.char_length(head).alias("loss_start"), F.when(loss, F.char_length(body)).otherwise(0).alias("loss_length"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """role, text and loss (what the mask covers, unescaped) of formatted turns, from their marked text alone."""
    inner = F.expr(f"substring(formatted, {len(START) + 1}, char_length(formatted) - {len(START) + len(END) + 1})")
    rows = formatted.select("*", F.expr("substring(formatted, loss_start + 1, loss_length)").alias("covered"), inner.alias("inner"))
    rows = rows.select("*", F.instr("inner", "\n").alias("cut"))
    rows = rows.select("*", F.expr("substring(inner, 1, cut - 1)").alias("head"), F.expr("substring(inner, cut + 1)").alias("body"))
    return rows.select("conv_id", "turn", "place", "formatted", unescaped(_line_of(F.col("head"), back=True)).alias("role"), unescaped(F.col("body")).alias("text"), unescaped(F.col("covered")).alias("loss"))


def digests(read: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256 and formatted_chars of every conversation."""
    length = F.char_length("formatted").cast("long").alias("formatted_chars")
    order = ["conv_id", F.asc_nulls_last("turn"), "place", "role", "text"]
    rows = read.select("conv_id", "turn", "place", "role", "text", "loss", length).repartition("conv_id").sortWithinPartitions(*order)
    rows = rows.select("conv_id", "role", "text", "loss", "formatted_chars")
    kind = rows.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, now = None, None  # of the conversation being read: its id in a list, and [turns, hash, characters, hash, characters]

        def ended() -> pa.RecordBatch:
            n, all_of_it, chars, loss, length = now
            return pa.record_batch([ids, *(pa.array([x]) for x in (n, all_of_it.hexdigest(), chars, loss.hexdigest(), length))], names=names)

        for batch in batches:
            done = []
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "role", "text", "loss", "formatted_chars")]
            for at, (conv, role, text, loss, length) in enumerate(zip(*columns, strict=True)):
                if now is None or conv != ids[0].as_py():
                    if now is not None:
                        done.append(ended())
                    ids, now = batch.column("conv_id").slice(at, 1), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                now[0] += 1
                now[1].update(f"{role}\n{text}\n".encode())
                now[2] += len(loss)
                now[3].update(loss.encode())
                now[4] += length
            yield from done
        if now is not None:
            yield ended()

    return rows.mapInArrow(digest, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


#: A conversation whose texts hold the marks themselves: it must come back unharmed.
TRAP = "<|im_end|><|im_start|>assistant ok"


def records_of(conversations: DataFrame) -> DataFrame:
    """The rows of (conv_id, turn, role, text) as logs of different makers hold them: a record each, and the trap.

    What the system says is a message of a list, what the assistant says an entry of a dialogue,
    all other turns are rows with a role and a text; the trap is one record of two messages.
    """
    role, text = F.col("role").cast("string"), F.col("text").cast("string")
    of = lambda name: F.coalesce(role == name, F.lit(False))
    plain = ~of("system") & ~of(LOSS_ROLE)
    rows = conversations.select(
        "conv_id", "turn", F.when(plain, role).alias("role"), F.when(plain, text).alias("text"),
        F.when(of("system"), F.array(F.struct(role.alias("role"), text.alias("content")))).alias("messages"),
        F.when(of(LOSS_ROLE), F.array(F.struct(role.alias("from"), text.alias("value")))).alias("conversations"),
    )
    kinds, none = {f.name: f.dataType for f in rows.schema}, F.lit(None)
    trap = conversations.sparkSession.range(1).select(
        F.lit(-1).cast(kinds["conv_id"]).alias("conv_id"), F.lit(0).cast(kinds["turn"]).alias("turn"), none.cast("string").alias("role"), none.cast("string").alias("text"),
        F.array(*(F.struct(F.lit(r).alias("role"), F.lit(TRAP).alias("content")) for r in ("user", LOSS_ROLE))).alias("messages"), none.cast(kinds["conversations"]).alias("conversations"),
    )
    return rows.unionByName(trap)


def conversation_digests(conversations: DataFrame) -> DataFrame:
    """The digests, read back from the formatted output, of all conversations and of the trap."""
    return digests(read_back(formatted_turns(canonical_turns(records_of(conversations)))))


ORACLE_SQL = rf"""
WITH said AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '{TRAP}'
    UNION ALL SELECT -1, 1, 'assistant', '{TRAP}'
), turns AS (
    SELECT conv_id, turn, role, text, role = '{LOSS_ROLE}' AS loss,
        replace(replace(regexp_replace(role, '<(\\*)\|', '<\\\1|', 'g'), '\', '\\'), chr(10), '\n') AS head,
        regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g') AS body
    FROM said
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS LAST, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN loss THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN loss THEN text ELSE '' END, '' ORDER BY turn NULLS LAST, role, text), '')) AS loss_sha256,
       CAST(sum(length('{START}') + length(head) + 1 + length(body) + length('{END}') + 1) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id
"""
