"""Chat records of any known layout as canonical turns, and turns as templated text with a loss mask.

A layout is recognised by its fingerprint, the hash of its nested field paths; the fingerprint selects a
declarative mapping to turns. Tables of structs are mapped by column expressions, JSON records one by one,
so records of different layouts may be mixed.

The template marks turns with ``### role:`` and ``</turn>``. A backslash before a control string or another
backslash escapes it, so texts come back exactly. Formatted conversations are rows of pieces, one for each
turn in order: a conversation is their concatenation, and none is ever held as a whole.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

OPEN, CLOSE = "### ", "</turn>"
_CONTROL = re.compile(r"\\|###|</turn>")
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_HEAD = re.compile(r"### ((?:\\.|[^\\:])*):\n", re.DOTALL)
TURNS = "conv_id bigint, turn bigint, role string, text string"


# --- layouts -----------------------------------------------------------------------------------------

@dataclass(frozen=True)
class Mapping:
    """How a layout becomes turns.

    Either ``turns``, a list of (role, fields): the non-empty fields joined by a blank line are one turn, and
    a role's turn is left out if all its fields are empty unless it ``answers``. Or ``items``, the field that
    lists the turns, with the names of each item's ``role`` and ``text``. Or neither: every record is one
    turn with ``turn``, ``role`` and ``text`` fields. ``roles`` renames roles; ``system`` is a field with
    a system text that comes first.
    """

    paths: tuple[str, ...]
    turns: tuple[tuple[str, tuple[str, ...]], ...] = ()
    items: str | None = None
    role: str = "role"
    text: str = "text"
    turn: str = "turn"
    system: str | None = None
    roles: dict[str, str] = field(default_factory=dict)


#: Names that other layouts have for roles.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
MAPPINGS = (
    Mapping(("conv_id", "role", "text", "turn")),
    Mapping(("conv_id", "messages", "messages[].content", "messages[].role"), items="messages", text="content"),
    Mapping(("conv_id", "messages", "messages[].content", "messages[].role", "system"), items="messages", text="content", system="system"),
    Mapping(("conv_id", "conversations", "conversations[].from", "conversations[].value"), items="conversations", role="from", text="value", roles=ROLES),
    Mapping(("conv_id", "conversations", "conversations[].from", "conversations[].value", "system"), items="conversations", role="from", text="value", roles=ROLES, system="system"),
    Mapping(("completion", "conv_id", "prompt"), turns=(("user", ("prompt",)), ("assistant", ("completion",)))),
    Mapping(("conv_id", "prompt", "response"), turns=(("user", ("prompt",)), ("assistant", ("response",)))),
    Mapping(("conv_id", "instruction", "output"), turns=(("user", ("instruction",)), ("assistant", ("output",)))),
    Mapping(("conv_id", "input", "instruction", "output"), turns=(("user", ("instruction", "input")), ("assistant", ("output",)))),
    Mapping(("conv_id", "input", "instruction", "output", "system"), turns=(("user", ("instruction", "input")), ("assistant", ("output",))), system="system"),
    Mapping(("conv_id", "question", "answer"), turns=(("user", ("question",)), ("assistant", ("answer",)))),
)


def fingerprint(paths: Iterable[str]) -> str:
    return hashlib.sha256("\n".join(sorted(set(paths))).encode()).hexdigest()[:16]


def schema_paths(schema: DataType, at: str = "") -> list[str]:
    """Nested field paths of a type; items of a list are ``[]``."""
    if isinstance(schema, StructType):
        named = [(f"{at}.{f.name}" if at else f.name, f.dataType) for f in schema]
        return [p for name, kind in named for p in (name, *schema_paths(kind, name))]
    return schema_paths(schema.elementType, f"{at}[]") if isinstance(schema, ArrayType) else []


def value_paths(value, at: str = "") -> set[str]:
    """Nested field paths of a JSON value; the same as those of its type."""
    if isinstance(value, dict):
        named = [(f"{at}.{k}" if at else k, v) for k, v in value.items()]
        return {p for name, v in named for p in (name, *value_paths(v, name))}
    return {p for v in value for p in value_paths(v, f"{at}[]")} if isinstance(value, list) else set()


def registry(mappings: Iterable[Mapping] = MAPPINGS) -> dict[str, Mapping]:
    """Mappings by fingerprint. A list without items has no item paths, so a layout with a list has a second fingerprint."""
    mappings = list(mappings)
    bare = {fingerprint(p for p in m.paths if "[]" not in p): m for m in reversed(mappings) if m.items}
    return bare | {fingerprint(m.paths): m for m in mappings}


class Layouts:
    """Finds the mapping of a table's or a record's own paths by their fingerprint.

    Paths that no mapping names aren't part of a layout. Paths of several layouts at once, whose fingerprint
    is unknown, are taken as the largest known layout among them.
    """

    def __init__(self, mappings: Iterable[Mapping] = MAPPINGS):
        self.mappings = tuple(mappings)
        self.known = registry(self.mappings)
        self.paths = {p for m in self.mappings for p in m.paths}

    def find(self, paths: Iterable[str]) -> tuple[str, Mapping | None]:
        """(fingerprint, mapping); the mapping is None if the layout is unknown."""
        own = self.paths.intersection(paths)
        layout = fingerprint(own)
        if layout not in self.known:
            held = [m for m in self.mappings if own.issuperset(m.paths)]
            return layout, max(held, key=lambda m: len(m.paths), default=None)
        return layout, self.known[layout]


def turns_of_table(records: DataFrame, mappings: Iterable[Mapping] = MAPPINGS) -> DataFrame:
    """(conv_id, turn, role, text) of a table of one layout, by column expressions.

    The fingerprint of the table's own paths selects the mapping. Columns that no mapping names, and those whose
    name occurs twice, are not part of the layout. Null roles and texts are empty; a null list has
    no turns. Turns of lists and fields are numbered from 0. An unknown layout is an error.
    """
    names = {c: [f for f in records.schema if f.name == c] for c in records.columns}
    paths = schema_paths(StructType([fields[0] for fields in names.values() if len(fields) == 1]))
    layout, m = Layouts(mappings).find(paths)
    if m is None:
        raise ValueError(f"no mapping for the layout {layout}: {sorted(paths)}")

    def text(c):
        return F.coalesce(c.cast("string"), F.lit(""))

    def role(c):
        renamed = F.lit(None).cast("string")
        for old, new in m.roles.items():
            renamed = F.when(text(c) == old, new).otherwise(renamed)
        return F.coalesce(renamed, text(c))

    conv = F.col("conv_id").cast("bigint").alias("conv_id")
    if not m.turns and not m.items:
        return records.select(conv, F.col(m.turn).cast("bigint").alias("turn"), role(F.col(m.role)).alias("role"), text(F.col(m.text)).alias("text"))
    turn = lambda who, what: F.struct(who.alias("role"), what.alias("text"))
    if m.items:
        turns = F.transform(F.coalesce(F.col(m.items), F.array()), lambda x: turn(role(x[m.role]), text(x[m.text])))
    else:
        turns = F.array(*(turn(F.lit(who), F.concat_ws("\n\n", *(F.when(F.col(f) != "", F.col(f)) for f in fields))) for who, fields in m.turns))
    if m.system:
        turns = F.concat(F.when(text(F.col(m.system)) != "", F.array(turn(F.lit("system"), text(F.col(m.system))))).otherwise(F.expr("cast(array() as array<struct<role:string,text:string>>)")), turns)
    return records.select(conv, F.posexplode(turns).alias("turn", "t")).select("conv_id", F.col("turn").cast("bigint"), "t.role", "t.text")


def record_turns(record: dict, m: Mapping) -> list[tuple[int, str, str]]:
    """(turn, role, text) of one JSON record."""
    text = lambda x: "" if x is None else x if isinstance(x, str) else json.dumps(x, ensure_ascii=False)
    role = lambda x: m.roles.get(text(x), text(x))
    if not m.turns and not m.items:
        return [(int(record[m.turn] or 0), role(record[m.role]), text(record[m.text]))]
    head = [("system", text(record[m.system]))] if m.system and record[m.system] else []
    if m.items:
        rest = [(role(x[m.role]), text(x[m.text])) for x in record[m.items] or []]
    else:
        rest = [(who, "\n\n".join(t for f in fields if (t := text(record[f])))) for who, fields in m.turns]
    return [(i, *x) for i, x in enumerate(head + rest)]


def turns_of_json(records: DataFrame, column: str, mappings: Iterable[Mapping] = MAPPINGS) -> DataFrame:
    """(conv_id, turn, role, text, layout) of JSON records of any mix of layouts, each recognised by itself.

    ``layout`` is the fingerprint. Fields that no mapping names are left out; an empty or null list has no turns. A record that is no object, has an unknown layout or doesn't keep to its
    mapping gives one row with null turn, role and text, so nothing is lost unseen.
    """
    layouts = Layouts(mappings)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for raw in batch.column(0).to_pylist():
                conv, layout = None, None
                try:
                    record = json.loads(raw)
                    layout, mapping = layouts.find(value_paths(record))
                    conv = int(record["conv_id"])
                    if mapping is None:
                        raise ValueError(layout)
                    out += [(conv, *t, layout) for t in record_turns(record, mapping)]
                except (TypeError, ValueError, KeyError):
                    out.append((conv, None, None, None, layout))
            types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=["conv_id", "turn", "role", "text", "layout"])

    return records.select(F.col(column).cast("string")).mapInArrow(run, f"{TURNS}, layout string")


# --- template ----------------------------------------------------------------------------------------

def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """(piece, start, end): the piece of a turn, and where in it its text is."""
    head = f"{OPEN}{escape(role).replace(':', chr(92) + ':')}:\n"
    body = escape(text)
    return f"{head}{body}\n{CLOSE}\n", len(head), len(head) + len(body)


def read_turns(formatted: str) -> Iterator[tuple[str, str, int, int]]:
    """(role, text, start, end) of every turn of formatted text. Inside an escaped text the closing mark always
    follows a backslash, so the first one on a line of its own ends the turn."""
    at = 0
    while at < len(formatted):
        head = _HEAD.match(formatted, at)
        end = formatted.find(f"\n{CLOSE}\n", head.end() - 1) if head else -1
        if not head or end < 0:
            raise ValueError(f"no turn at {at}")
        end = max(end, head.end())
        yield unescape(head[1]), unescape(formatted[head.end():end]), head.end(), end
        at = end + len(CLOSE) + 2


def formatted(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, piece, loss_start, loss_end) of every turn.

    ``piece`` is its formatted text; of an assistant's turn the characters from ``loss_start`` up to ``loss_end``
    are under the loss mask, of others none (both 0). A null role or text is empty.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            roles, texts = batch.column("role").to_pylist(), batch.column("text").to_pylist()
            pieces = [format_turn(r, t) for r, t in zip(roles, texts)]
            loss = [p[1:] if r == "assistant" else (0, 0) for r, p in zip(roles, pieces)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([p[0] for p in pieces], pa.string()), pa.array([x[0] for x in loss], pa.int64()), pa.array([x[1] for x in loss], pa.int64())],
                                             names=["conv_id", "turn", "role", "text", "piece", "loss_start", "loss_end"])

    plain = turns.select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
                         F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return plain.mapInArrow(run, f"{TURNS}, piece string, loss_start bigint, loss_end bigint")


def read_back(pieces: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of every conversation, read from
    its pieces in the order of turn, role and text (nulls first; rows without conv_id are one conversation).

    Pieces are streamed through running digests in sorted order: however long a conversation, one piece is held.
    """
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, key, n, loss_chars, chars = None, None, 0, 0, 0
        turns, loss = hashlib.sha256(), hashlib.sha256()
        types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())

        def rows(out):
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=names)

        for batch in batches:
            out = []
            for conv, piece, lo, hi in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "piece", "loss_start", "loss_end"))):
                if now is None or conv != key:
                    if now:
                        out.append((key, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars))
                    now, key, n, loss_chars, chars = True, conv, 0, 0, 0
                    turns, loss = hashlib.sha256(), hashlib.sha256()
                for role, text, _, _ in read_turns(piece):
                    n += 1
                    turns.update(f"{role}\n{text}\n".encode())
                masked = unescape(piece[lo:hi])
                loss_chars += len(masked)
                loss.update(masked.encode())
                chars += len(piece)
            if out:
                yield rows(out)
        if now:
            yield rows([(key, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars)])

    order = ["conv_id", "turn", "role", "text"]
    return pieces.repartition("conv_id").sortWithinPartitions(*order).select("conv_id", "piece", "loss_start", "loss_end").mapInArrow(
        run, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


SAMPLE_TEXT = r"\### Assistant: </turn> ok"
REPORT_SQL = r"""
WITH turns AS (SELECT conv_id::BIGINT AS conv_id, turn::BIGINT AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
escaped AS (SELECT *, replace(replace(replace(text, '\', '\\'), '###', '\###'), '</turn>', '\</turn>') AS body,
  replace(replace(replace(replace(role, '\', '\\'), '###', '\###'), '</turn>', '\</turn>'), ':', '\:') AS who FROM turns)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length('### ' || who || ':' || chr(10) || body || chr(10) || '</turn>' || chr(10)))::BIGINT AS formatted_chars
FROM escaped GROUP BY conv_id
"""
