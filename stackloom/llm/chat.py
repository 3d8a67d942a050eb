"""Chat formatting by schema fingerprints.

A record is one JSON object of any known layout: messages (texts or lists of parts),
conversations, prompt and completion, instruction and output. The fingerprint of a layout is a
hash of its nested field paths (lists are entered, so their length does not matter); paths that
no mapping uses are left out, so ids and other extra fields do not matter either. It selects a
declarative mapping, which turns the record into canonical turns; a record with the fields of
several mappings gets the first of them. A template marks the turns, escapes control
strings inside texts reversibly, and gives the spans of assistant text for the loss mask.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, STOP = "<|im_start|>", "<|im_end|>\n"
#: What tokenizers may take for control: <|...|>, <s>, </s>, [INST], [/INST], <<SYS>>, <</SYS>>.
#: The first character of each, and any backslashes after it that escapes have put there.
_CONTROL = re.compile(r"([<\[])(\\*)(?=\||/?s>|/?INST\]|</?SYS>>)")
_ESCAPED = re.compile(r"([<\[])\\(\\*)(?=\||/?s>|/?INST\]|</?SYS>>)")


def escape(text: str) -> str:
    return _CONTROL.sub(r"\1\2\\", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2", text)


def _role_line(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def _role_of(line: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(line))


def _text(value: object) -> str | None:
    """A text field: null is empty, numbers are written out; None if it is neither."""
    if value is None or isinstance(value, str):
        return value or ""
    return json.dumps(value) if isinstance(value, int | float) else None


@dataclass(frozen=True)
class Mapping:
    """How a layout becomes turns.

    turns: a list field whose elements have `role` and `text` fields; names: other names of
    roles; parts: the text is a list whose elements hold it in this field; lead: (role, field)
    of a turn before the list. Or fields: pairs of (role, field names whose non-empty values are
    joined by a blank line).
    """

    paths: tuple[str, ...]
    turns: str = ""
    role: str = ""
    text: str = ""
    parts: str = ""
    names: tuple[tuple[str, str], ...] = ()
    lead: tuple[str, str] | None = None
    fields: tuple[tuple[str, tuple[str, ...]], ...] = ()

    def apply(self, record: dict) -> list[tuple[str, str]] | None:
        """The turns; None if some value is of another kind than the layout says."""
        found: list[tuple[str | None, str | None]] = []
        if self.lead and self.lead[1] in record:
            found.append((self.lead[0], _text(record[self.lead[1]])))
        for x in (record.get(self.turns) or []) if self.turns else []:
            if not isinstance(x, dict):
                return None
            role, text = _text(x.get(self.role)), x.get(self.text)
            if self.parts and isinstance(text, list):
                pieces = [_text(p.get(self.parts)) if isinstance(p, dict) else None for p in text]
                text = None if None in pieces else "".join(pieces)
                found.append((dict(self.names).get(role, role), text))
            else:
                found.append((dict(self.names).get(role, role), _text(text)))
        for role, names in self.fields:
            if any(f in record for f in names):
                pieces = [_text(record.get(f)) for f in names]
                found.append((role, None if None in pieces else "\n\n".join(p for p in pieces if p)))
        return None if any(r is None or t is None for r, t in found) else found


_SPEAKERS = (("human", "user"), ("gpt", "assistant"), ("bot", "assistant"))
MAPPINGS = (
    *(
        Mapping((*paths, *lead), turns="messages", role="role", text="content", parts=parts, lead=("system", "system") if lead else None)
        for paths, parts in ((("messages[].role", "messages[].content"), ""), (("messages[].role", "messages[].content[].text"), "text"), (("messages[].role", "messages[].content[].text", "messages[].content"), "text"))
        for lead in (("system",), ())
    ),
    Mapping(("conversations[].from", "conversations[].value", "system"), turns="conversations", role="from", text="value", names=_SPEAKERS, lead=("system", "system")),
    Mapping(("conversations[].from", "conversations[].value"), turns="conversations", role="from", text="value", names=_SPEAKERS),
    *(
        Mapping((*lead, ask, *more, answer), fields=((("system", ("system",)),) if lead else ()) + (("user", (ask, *more)), ("assistant", (answer,))))
        for ask, answer, extra in (("prompt", "completion", ()), ("prompt", "response", ()), ("instruction", "output", ("input",)), ("instruction", "response", ("input",)), ("question", "answer", ()))
        for lead in (("system",), ())
        for more in ((extra, ()) if extra else ((),))
    ),
)


def field_paths(value: object, path: str = "") -> set[str]:
    if isinstance(value, dict):
        return {p for k, v in value.items() for p in field_paths(v, f"{path}.{k}" if path else k)}
    if isinstance(value, list):
        return {p for v in value for p in field_paths(v, f"{path}[]")} or {f"{path}[]"}
    return {path}


def fingerprint(paths: set[str] | tuple[str, ...]) -> str:
    return hashlib.blake2b("\n".join(sorted(paths)).encode(), digest_size=8).hexdigest()


def format_turns(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """(formatted text, spans of assistant texts in it)."""
    out, at, spans = [], 0, []
    for role, text in turns:
        head, body = f"{START}{_role_line(role)}\n", escape(text)
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        out += (head, body, STOP)
        at += len(head) + len(body) + len(STOP)
    return "".join(out), spans


def parse_turns(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted text. START cannot occur inside one: it would be escaped."""
    turns = []
    for part in formatted.split(START)[1:]:
        role, _, text = part.partition("\n")
        turns.append((_role_of(role), unescape(text[: -len(STOP)])))
    return turns


_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])


def choose(record: object, mappings: tuple[Mapping, ...]) -> tuple[str | None, Mapping | None]:
    """(fingerprint, mapping) of a record: by its known paths, or the first mapping they hold."""
    if not isinstance(record, dict):
        return None, None
    known = {p for m in mappings for p in m.paths} | {f"{m.turns}[]" for m in mappings if m.turns}
    paths = field_paths(record) & known
    layout = fingerprint(paths)
    for m in mappings:
        if fingerprint(m.paths) == layout or (m.turns and paths == {f"{m.turns}[]"}):
            return layout, m
    return layout, next((m for m in mappings if set(m.paths) <= paths), None)


def _formatter(mappings: tuple[Mapping, ...]):
    def form(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[frozenset, tuple[str | None, Mapping | None]] = {}
        for batch in batches:
            out: list[tuple] = []
            for text in batch.column(1).to_pylist():
                try:
                    record = json.loads(text) if text is not None else None
                except (ValueError, RecursionError):
                    record = None
                key = frozenset(field_paths(record)) if isinstance(record, dict) else frozenset()
                if key not in seen:
                    if len(seen) > 10_000:  # layouts without end, as from keys that are data
                        seen.clear()
                    seen[key] = choose(record, mappings)
                layout, mapping = seen[key] if isinstance(record, dict) else (None, None)
                turns = mapping.apply(record) if mapping else None
                formatted, spans = format_turns(turns) if turns is not None else (None, None)
                out.append((layout, formatted, None if spans is None else [{"start": a, "end": b} for a, b in spans]))
            columns = list(zip(*out, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.list_(_SPAN))], ["id", "layout", "formatted", "loss"])

    return form


def format_records(records: DataFrame, id_col: str = "conv_id", json_col: str = "record", mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """(id, layout, formatted, loss) for every row of records, one JSON object each.

    layout is the fingerprint, loss an array of spans (start, end) in code points of the
    formatted text. Texts without a known layout, null and malformed ones included, and those
    whose values are of another kind than their layout says (a turn that is no object, a text
    that is an object), have a null formatted and loss; nothing is dropped. Null roles and
    texts are empty, numbers are written out. Ids may be null or repeated. Extra columns are
    ignored.
    """
    id_type = records.schema[id_col].dataType.simpleString()
    return records.select(id_col, json_col).mapInArrow(_formatter(mappings), f"id {id_type}, layout string, formatted string, loss array<struct<start:bigint,end:bigint>>").withColumnRenamed("id", id_col)


def conversation_records(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", mixed: bool = False) -> DataFrame:
    """(id, record): the rows of each conversation as one JSON object of the messages layout,
    by turn, then role and text where turns tie; rows that repeat stay. A conversation is one
    sample and must fit a row. With mixed, the layouts vary by a hash of the id: messages,
    messages of parts, conversations, and prompt or instruction for a user and an assistant row."""
    row = F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("content"))
    grouped = turns.groupBy(F.col(id_col).alias("id")).agg(F.array_sort(F.collect_list(row)).alias("rows"))
    as_messages = F.to_json(F.struct(F.transform("rows", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages")))
    if not mixed:
        return grouped.select(F.col("id").alias(id_col), as_messages.alias("record"))
    part = lambda x: F.array(F.struct(F.lit("text").alias("type"), x["content"].alias("text")))
    as_parts = F.to_json(F.struct(F.transform("rows", lambda x: F.struct(x["role"].alias("role"), part(x).alias("content"))).alias("messages")))
    speaker = lambda x: F.when(x["role"] == "user", "human").when(x["role"] == "assistant", "gpt").otherwise(x["role"])
    as_talk = F.to_json(F.struct(F.col("id").cast("string").alias("id"), F.transform("rows", lambda x: F.struct(speaker(x).alias("from"), x["content"].alias("value"))).alias("conversations")))
    first, second = F.get("rows", F.lit(0)), F.get("rows", F.lit(1))
    pair = (F.size("rows") == 2) & (first["role"] == "user") & (second["role"] == "assistant")
    as_pair = F.to_json(F.struct(first["content"].alias("prompt"), second["content"].alias("response")))
    as_task = F.to_json(F.struct(first["content"].alias("instruction"), F.lit("").alias("input"), second["content"].alias("output")))
    own_names = F.exists("rows", lambda x: x["role"].isin("human", "gpt", "bot"))
    turn = F.pmod(F.xxhash64("id"), F.lit(4))
    record = F.when(pair & (turn < 2), F.when(turn == 0, as_pair).otherwise(as_task)).when((turn == 2) & ~own_names, as_talk).when(turn == 3, as_parts).otherwise(as_messages)
    return grouped.select(F.col("id").alias(id_col), record.alias("record"))


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[tuple] = []
        for formatted, loss in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            turns = parse_turns(formatted or "")
            learned = "".join(unescape(formatted[x["start"] : x["end"]]) for x in loss or [])
            every = "".join(f"{r}\n{t}\n" for r, t in turns)
            out.append((len(turns), hashlib.sha256(every.encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest(), len(formatted or "")))
        n, all_hash, chars, loss_hash, size = list(zip(*out, strict=True)) or [()] * 5
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(all_hash, pa.string()), pa.array(chars, pa.int64()), pa.array(loss_hash, pa.string()), pa.array(size, pa.int64())], ["id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def read_back(formatted: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """Counts and digests of the turns and of the text under the loss mask, parsed from the
    formatted texts alone."""
    id_type = formatted.schema[id_col].dataType.simpleString()
    schema = f"id {id_type}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return formatted.select(id_col, "formatted", "loss").mapInArrow(_digest, schema).withColumnRenamed("id", id_col)
