"""Chat formatting: records of many layouts become canonical turns, turns become templated text.

The sorted nested field paths of a record, those that any layout knows, are hashed; the
hash selects a declarative mapping.  Template: a turn is START role newline text END newline.  Inside roles and texts
the two characters "<|" (and any longer "<", backslashes, "|") get one more backslash, so
no control string survives in them and the escape can be undone.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

START, END = "<|im_start|>", "<|im_end|>"
_PART_CHARS = 1 << 20
_OPEN = re.compile(r"<(\\*)\|")
_SHUT = re.compile(r"<(\\*)\\\|")

#: fixed values: names of roles in known layouts
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "chatgpt": "assistant"}


@dataclass(frozen=True)
class Mapping:
    """How records with exactly these field paths, among those of all mappings, become turns.

    `turns` is the path of a list of messages with `role` and `text` fields; else `fields` lists (role, paths), whose non-empty
    texts are joined by a blank line; `row` says that a record is itself one turn.  A text may be a list of parts with a `text` field.
    """

    name: str
    paths: frozenset[str]
    turns: str | None = None
    role: str | None = None
    text: str | None = None
    fields: tuple[tuple[str, tuple[str, ...]], ...] = ()
    row: bool = False

    @property
    def key(self) -> str:
        return fingerprint(self.paths)


def fingerprint(paths: Iterable[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


def _of(name: str, *paths: str, **how) -> Mapping:
    return Mapping(name, frozenset(paths), **how)


MAPPINGS = (
    _of("turn_row", "conv_id", "turn", "role", "text", role="role", text="text", row=True),
    _of("messages", "messages[].role", "messages[].content", turns="messages", role="role", text="content"),
    _of("messages_of_parts", "messages[].role", "messages[].content[].type", "messages[].content[].text", turns="messages", role="role", text="content"),
    _of("messages_mixed", "messages[].role", "messages[].content", "messages[].content[].type", "messages[].content[].text", turns="messages", role="role", text="content"),
    _of("no_messages", "messages", turns="messages", role="role", text="content"),
    _of("conversations", "conversations[].from", "conversations[].value", turns="conversations", role="from", text="value"),
    _of("system_conversations", "system", "conversations[].from", "conversations[].value", turns="conversations", role="from", text="value", fields=(("system", ("system",)),)),
    _of("dialog", "dialog[].speaker", "dialog[].text", turns="dialog", role="speaker", text="text"),
    _of("instruction_input", "instruction", "input", "output", fields=(("user", ("instruction", "input")), ("assistant", ("output",)))),
    _of("instruction", "instruction", "output", fields=(("user", ("instruction",)), ("assistant", ("output",)))),
    _of("instruction_context", "instruction", "context", "response", fields=(("user", ("instruction", "context")), ("assistant", ("response",)))),
    _of("prompt_completion", "prompt", "completion", fields=(("user", ("prompt",)), ("assistant", ("completion",)))),
    _of("prompt_response", "prompt", "response", fields=(("user", ("prompt",)), ("assistant", ("response",)))),
    _of("system_prompt_response", "system", "prompt", "response", fields=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",)))),
    _of("question_answer", "question", "answer", fields=(("user", ("question",)), ("assistant", ("answer",)))),
)


@lru_cache(4096)
def _selected(paths: frozenset[str], mappings: tuple[Mapping, ...]) -> tuple[str, Mapping | None]:
    """The fingerprint of the known ones among the paths, and the mapping of that fingerprint."""
    key = fingerprint(paths & _known(mappings))
    return key, next((m for m in mappings if m.key == key), None)


@lru_cache(64)
def _known(mappings: tuple[Mapping, ...]) -> frozenset[str]:
    return frozenset().union(*(m.paths for m in mappings))


def json_paths(value: object, at: str = "") -> set[str]:
    """Paths of the leaves; a list adds []; an empty list or object is a leaf."""
    if isinstance(value, dict) and value:
        return set().union(*(json_paths(v, f"{at}.{k}" if at else k) for k, v in value.items()))
    if isinstance(value, list) and value:
        return set().union(*(json_paths(v, f"{at}[]") for v in value))
    return {at}


def schema_paths(kind: T.DataType, at: str = "") -> set[str]:
    if isinstance(kind, T.StructType):
        return set().union(*(schema_paths(f.dataType, f"{at}.{f.name}" if at else f.name) for f in kind.fields)) if kind.fields else {at}
    if isinstance(kind, T.ArrayType):
        return schema_paths(kind.elementType, f"{at}[]")
    return {at}


def _text(value: object) -> str:
    if isinstance(value, list) and all(isinstance(x, dict) for x in value):  # parts of a message
        return "\n\n".join(_text(x["text"]) if "text" in x else _text(x and json.dumps(x, ensure_ascii=False)) for x in value)
    return "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def record_turns(record: object, mappings: tuple[Mapping, ...] = MAPPINGS) -> tuple[str, str | None, list[tuple[str, str]]]:
    """The fingerprint of a parsed record, the mapping's name (None if there is none) and its (role, text) turns."""
    key, m = _selected(frozenset(json_paths(record)), mappings)
    if m is None:
        return key, None, []
    if m.row:
        return key, m.name, [(_text(record[m.role]), _text(record[m.text]))]
    out = []
    for role, paths in m.fields:
        text = "\n\n".join(t for t in (_text(record.get(p)) for p in paths) if t)
        if text or role != "system":
            out.append((role, text))
    for x in (record[m.turns] or ()) if m.turns else ():
        role = _text(x.get(m.role))
        out.append((ROLES.get(role, role), _text(x.get(m.text))))
    return key, m.name, out


def canonical(df: DataFrame, record: str = "record", conv_id: str = "conv_id", mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """conv_id, turn, role, text, mapping, fingerprint: the turns of JSON records of any known layout.

    A record that is null, no JSON, of an unknown layout or without turns gives one row with null turn, role and text, so nothing
    is lost.  Fields that no mapping knows do not count; null texts are empty; repeated records are records of their own.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for conv, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    key, name, turns = record_turns(json.loads(raw), mappings)
                except (TypeError, ValueError):
                    key, name, turns = None, None, []
                out += [(conv, i, role, text, name, key) for i, (role, text) in enumerate(turns)] or [(conv, None, None, None, None, key)]
            cols = list(zip(*out)) if out else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string()))], names=["conv_id", "turn", "role", "text", "mapping", "fingerprint"])

    return df.select(F.col(conv_id).cast("long"), F.col(record).cast("string")).mapInArrow(run, "conv_id long, turn long, role string, text string, mapping string, fingerprint string")


def table_turns(df: DataFrame, mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """conv_id, turn, role, text of a table whose rows are turns.

    All rows have the nested field paths of the table's schema: their fingerprint selects the mapping.  Columns that no mapping
    knows do not count; if others do that belong to another layout (a table of turns with a column `prompt`), so that no mapping
    has the fingerprint, those that no mapping of rows knows are left out of it.
    """
    have = frozenset(schema_paths(df.schema))
    rows = tuple(m for m in mappings if m.row)
    m = _selected(have, mappings)[1] or _selected(have, rows)[1]
    if m is None or not m.row:
        raise ValueError(f"no mapping of turns for the columns {sorted(have)}")
    return df.select("conv_id", "turn", F.col(m.role).alias("role"), F.col(m.text).alias("text"))


def escape(text: str) -> str:
    return _OPEN.sub(r"<\1\\|", text) if "<" in text else text


def unescape(text: str) -> str:
    return _SHUT.sub(r"<\1|", text) if "<" in text else text


def _role_out(role: str) -> str:
    return escape(role.replace("%", "%25").replace("\n", "%0A"))


def _role_in(role: str) -> str:
    return unescape(role).replace("%0A", "\n").replace("%25", "%")


def read_turns(text: str) -> Iterator[tuple[str, str, int, int]]:
    """(role, text, begin, end of the escaped text) of each turn of a formatted text."""
    at = 0
    while at < len(text):
        if not text.startswith(START, at):
            raise ValueError(f"no turn begins at {at}")
        line = text.index("\n", at)
        stop = text.index(END, line + 1)
        yield _role_in(text[at + len(START) : line]), unescape(text[line + 1 : stop]), line + 1, stop
        at = stop + len(END) + 1


def formatted(turns: DataFrame, *, learn: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """conv_id, part, n_turns, text, loss_spans: the formatted conversations, parts in order within a partition.

    Turns go by (turn, role, text), nulls first.  Null roles and texts are empty.  A part holds whole turns and about a million
    characters at most, so the memory of a task does not follow the longest conversation; parts joined are the conversation.
    loss_spans are begin and end offsets in the part of the escaped texts of the roles in `learn`, flat.
    A conversation is read by one task, in sorted, spillable order, because its digests are sequential.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        conv, part, n, size, pieces, spans, opened = None, 0, 0, 0, [], [], False

        def close() -> None:
            rows.append((conv, part, n, "".join(pieces), spans))

        def flush() -> pa.RecordBatch:
            cols = list(zip(*rows))
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int32())))], names=["conv_id", "part", "n_turns", "text", "loss_spans"])

        kept = 0
        for batch in batches:
            for c, role, text in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3))):
                if not opened or c != conv or size >= _PART_CHARS:
                    if opened:
                        close()
                        kept += size
                        part = part + 1 if c == conv else 0
                        if kept >= 4 * _PART_CHARS:
                            yield flush()
                            kept = 0
                    conv, n, size, pieces, spans, opened = c, 0, 0, [], [], True
                role = role or ""
                head, body = f"{START}{_role_out(role)}\n", escape(text or "")
                if role in learn:
                    spans += [size + len(head), size + len(head) + len(body)]
                pieces += [head, body, END, "\n"]
                size += len(head) + len(body) + len(END) + 1
                n += 1
        if opened:
            close()
        if rows:
            yield flush()

    order = turns.select("conv_id", "turn", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return order.mapInArrow(run, "conv_id long, part long, n_turns long, text string, loss_spans array<int>")


def digests(parts: DataFrame) -> DataFrame:
    """One row per conversation, read back from formatted()'s output in the order in which it comes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        conv, state = None, None
        for batch in batches:
            out = []
            for c, part, text, spans in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3, 4))):
                if state is None or part == 0:
                    if state is not None:
                        out.append((conv, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))
                    conv, state = c, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, body, _, _ in read_turns(text):
                    state[0] += 1
                    state[1].update(f"{role}\n{body}\n".encode())
                for a, b in zip(spans[::2], spans[1::2]):
                    learned = unescape(text[a:b])
                    state[2] += len(learned)
                    state[3].update(learned.encode())
                state[4] += len(text)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), kinds)], names=names)
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((conv, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]), kinds)], names=names)

    return parts.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
