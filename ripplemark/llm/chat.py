"""Chat formatting by schema fingerprints.

A JSON record's nested field paths (``messages[].role``) are sorted and hashed. The fingerprint selects a declarative
mapping that turns the record into canonical turns of ``(role, text)``. A fingerprint seen for the first time is matched
against the mappings' required paths (the mapping with the most of them wins); then the hash alone decides.
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


@dataclass(frozen=True)
class Layout:
    """``each``: a list of turns with fields for role and text; ``fixed``: (role, fields) pairs in the turns' order.

    Fields of a fixed turn that are there are joined by an empty line; a turn none of whose fields is there is left out.
    """

    name: str
    required: frozenset[str]
    each: tuple[str, str, str] | None = None
    fixed: tuple[tuple[str, tuple[str, ...]], ...] = ()


def _each(name: str, field: str, role: str, text: str, tail: str = "") -> Layout:
    return Layout(name, frozenset({f"{field}[].{role}", f"{field}[].{text}{tail}"}), each=(field, role, text))


def _fixed(name: str, required: str, **turns: str) -> Layout:
    return Layout(name, frozenset(required.split()), fixed=tuple((r, tuple(f.split())) for r, f in turns.items()))


LAYOUTS = (
    _each("messages", "messages", "role", "content"),
    _each("message_parts", "messages", "role", "content", "[].text"),
    _each("from_value", "conversations", "from", "value"),
    _each("turns", "turns", "speaker", "text"),
    _fixed("instruction", "instruction output", system="system", user="instruction input", assistant="output"),
    _fixed("prompt_response", "prompt response", system="system", user="prompt", assistant="response"),
    _fixed("prompt_completion", "prompt completion", system="system", user="prompt", assistant="completion"),
    _fixed("question_answer", "question answer", system="system", user="context question", assistant="answer"),
    _fixed("text", "text", assistant="text"),
)
_SPECIAL = re.compile(r"[.\[\]\\]")
_SURROGATE = re.compile("[\ud800-\udfff]")
ROLES = {"human": "user", "prompter": "user", "customer": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "chatbot": "assistant", "developer": "system"}


def escaped(key: str) -> str:
    """A key as it stands in a path: dots, brackets and backslashes are escaped, so no key reads like nesting."""
    return _SPECIAL.sub(r"\\\g<0>", key)


def paths(value: object) -> set[str]:
    """The paths of all leaves; an empty object or list is a leaf. Nesting of any depth is walked without recursion."""
    out, todo = set(), [(value, None)]
    while todo:
        value, at = todo.pop()
        if isinstance(value, dict) and value:
            todo += [(v, escaped(k) if at is None else f"{at}.{escaped(k)}") for k, v in value.items()]
        elif isinstance(value, list) and value:
            inner = f"{at or ''}[]"
            todo += [(v, inner) for v in value]
        else:
            out.add(at or "")
    return out


def fingerprint(found: set[str]) -> str:
    return hashlib.sha256("\n".join(sorted(found)).encode("utf-8", "surrogatepass")).hexdigest()[:16]


def _text(value: object) -> str | None:
    if value is None:
        return None
    if isinstance(value, str):
        return value if value.isascii() else _SURROGATE.sub("\ufffd", value)
    if isinstance(value, list):
        return "".join(_text(v.get("text")) or "" if isinstance(v, dict) else _text(v) or "" for v in value)
    return _SURROGATE.sub("\ufffd", json.dumps(value, ensure_ascii=False, sort_keys=True))


def _role(value: object) -> str | None:
    name = _text(value)
    return ROLES.get(name.strip().lower(), name.strip().lower()) if name is not None else None


class Formatter:
    def __init__(self, layouts: tuple[Layout, ...] = LAYOUTS):
        self.layouts, self.known = layouts, {}

    def layout(self, found: set[str]) -> tuple[str, Layout | None]:
        key = fingerprint(found)
        if key not in self.known:
            if len(self.known) >= 10_000:
                self.known.clear()
            fits = [x for x in self.layouts if x.required <= found]
            self.known[key] = max(fits, key=lambda x: len(x.required), default=None)
        return key, self.known[key]

    def turns(self, record: dict, layout: Layout) -> list[tuple[str | None, str | None]]:
        if layout.each:
            field, role, text = layout.each
            return [(_role(t.get(role)), _text(t.get(text))) for t in record[field] if isinstance(t, dict)]
        out = []
        for role, fields in layout.fixed:
            there = [_text(record[f]) for f in fields if f in record and record[f] != ""]
            if there:
                out.append((role, None if None in there and len(there) == 1 else "\n\n".join(t for t in there if t is not None)))
            elif fields[0] in record:
                out.append((role, ""))
        return out

    def convert(self, text: str | None) -> tuple[str | None, str, list]:
        """The fingerprint, the layout's name and the turns of a record."""
        if text is None:
            return None, "missing", []
        try:
            record = json.loads(text)
        except (ValueError, RecursionError):
            return None, "invalid", []
        if not isinstance(record, dict):
            return fingerprint(paths(record)), "unknown", []
        key, layout = self.layout(paths(record))
        try:
            return (key, layout.name, self.turns(record, layout)) if layout else (key, "unknown", [])
        except RecursionError:  # a turn's text is itself nested deeper than the JSON library writes
            return key, "invalid", []


def format_chats(records: DataFrame, id_col: str, record_col: str = "record") -> DataFrame:
    """``(<id>, fingerprint, layout, turns)`` for each row; ``turns`` are structs of turn, role and text, from 0.

    A null record has the layout ``missing``, one that isn't JSON (or is nested deeper than the JSON library can follow)
    ``invalid``, one that no mapping fits ``unknown``; these have no turns. A lone surrogate becomes U+FFFD. Keys with dots,
    brackets or backslashes are keys of their own, never nesting. Null texts stay null, empty ones empty; roles are lower case and canonical
    names. Rows are converted each, repeated or not; null ids stay; other columns aren't carried.
    """
    data = records.select(records[id_col].alias("id"), records[record_col].cast("string").alias("record"))
    turn = pa.struct([("turn", pa.int32()), ("role", pa.string()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        formatter = Formatter()
        for batch in batches:
            rows = [formatter.convert(r.as_py()) for r in batch["record"]]
            turns = [[{"turn": i, "role": a, "text": b} for i, (a, b) in enumerate(t)] for _, _, t in rows]
            yield pa.record_batch([batch["id"], pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array(turns, pa.list_(turn))], names=["id", "fingerprint", "layout", "turns"])

    kind = data.schema["id"].dataType.simpleString()
    return data.mapInArrow(run, f"id {kind}, fingerprint string, layout string, turns array<struct<turn:int,role:string,text:string>>").withColumnRenamed("id", id_col)


def conversation_records(turns: DataFrame) -> DataFrame:
    """``(conv_id, record)``: each conversation of ``(conv_id, turn, role, text)`` rows as JSON in a layout that fits its shape.

    A user's and an assistant's turn make a prompt with a response or a completion, or a question with an answer; a system's turn
    before them an instruction record; longer conversations of users and assistants a from/value or speaker/text list; one assistant's turn
    a text record; all others a message list, in parts where every text is there. The id's remainder by 3 or 2 chooses among equals (null: 0).
    """
    one = F.struct("turn", "role", "text")
    talks = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(one)).alias("t")).select("conv_id", "t", F.concat_ws(",", F.transform("t", lambda x: F.coalesce(x["role"], F.lit("?")))).alias("roles"))
    by = lambda n: F.pmod(F.coalesce("conv_id", F.lit(0)), F.lit(n))
    text = lambda i: F.col("t")[i]["text"]
    json_of = lambda *c: F.to_json(F.struct(*c), {"ignoreNullFields": "false"})
    pair = lambda a, b: json_of(text(0).alias(a), text(1).alias(b))
    each = lambda field, f: json_of(F.transform("t", lambda x: F.struct(*f(x))).alias(field))
    filled = F.forall("t", lambda x: F.coalesce(x["text"], F.lit("")) != "")
    instruct = json_of(text(0).alias("system"), text(1).alias("instruction"), F.lit("").alias("input"), text(2).alias("output"))
    name = lambda r: F.when(r == "user", "human").otherwise("gpt")
    listed = each("conversations", lambda x: (name(x["role"]).alias("from"), x["text"].alias("value")))
    spoken = each("turns", lambda x: (F.upper(x["role"]).alias("speaker"), x["text"].alias("text")))
    messages = each("messages", lambda x: (x["role"].alias("role"), x["text"].alias("content")))
    parts = each("messages", lambda x: (x["role"].alias("role"), F.array(F.struct(F.lit("text").alias("type"), x["text"].alias("text"))).alias("content")))
    two = F.col("roles") == "user,assistant"
    many = F.col("roles").rlike("^(user|assistant)(,(user|assistant))*$")
    record = F.when(two & (by(3) == 0), pair("prompt", "response")).when(two & (by(3) == 1), pair("prompt", "completion")).when(two, pair("question", "answer"))
    record = record.when((F.col("roles") == "system,user,assistant") & filled, instruct).when(F.col("roles") == "assistant", json_of(text(0).alias("text")))
    record = record.when(many & (by(2) == 0), listed).when(many, spoken).when(filled & (by(2) == 0), parts).otherwise(messages)
    return talks.select("conv_id", record.alias("record"))
