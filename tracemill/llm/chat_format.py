"""Chat formatting by schema fingerprints, in DataFrame functions only.

A record's fingerprint is the hash of its nested field paths.  It selects a declarative mapping that
turns the record's layout (prompt and completion, instruction and output, lists of messages under
several names) into canonical turns of role and text.  Records are either typed columns, whose paths
are those of the schema, or JSON texts, whose paths are taken row by row.

Turns are written as ``<turn><role>R</role>T</turn>`` with ``&`` and ``<`` of roles and texts written
as ``&amp;`` and ``&lt;``, so no text can hold a mark and reading back is exact.  The loss mask is a
list of (start, length) in code points over the formatted text: one span for each assistant's text.

Nulls: null roles and texts are empty; a null id is a conversation of its own.  Turns with one number
are ordered by role, then text.  JSON that cannot be parsed and layouts without a mapping give null
turns and a null format.  Repeated rows are repeated turns; an empty table gives no conversation.
Very long texts are formatted whole; a conversation is one row, so its texts meet in one task.  Columns
are selected by name, so extra ones may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


TURN = "struct<role: string, text: string>"
Get = Callable[[str, str], Column]


def _turn(role: Column, text: Column) -> Column:
    return F.struct(F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))


def _said(role: str, text: Column) -> Column:
    return F.array(_turn(F.lit(role), text))


def _list(path: str, role: str, text: str, names: dict[str, str] | None = None) -> Callable[[Get], Column]:
    """Turns from a list of objects; ``names`` translates roles."""

    def turns(get: Get) -> Column:
        items = get(path, f"array<struct<{role}: string, {text}: string>>")

        def one(x: Column) -> Column:
            name = x[role]
            if names:
                for a, b in names.items():
                    name = F.when(x[role] == a, b).otherwise(name)
            return _turn(name, x[text])

        return F.transform(items, one)

    return turns


def _numbered(get: Get) -> Column:
    items = get("turns", "array<struct<turn: bigint, role: string, text: string>>")
    full = F.transform(
        items,
        lambda x: F.struct(
            x["turn"].alias("turn"), F.coalesce(x["role"], F.lit("")).alias("role"), F.coalesce(x["text"], F.lit("")).alias("text")
        ),
    )
    return F.transform(F.array_sort(full), lambda x: _turn(x["role"], x["text"]))


def _instruction(get: Get) -> Column:
    more = get("input", "string")
    asked = F.concat(
        F.coalesce(get("instruction", "string"), F.lit("")),
        F.when(F.coalesce(more, F.lit("")) != "", F.concat(F.lit("\n\n"), more)).otherwise(""),
    )
    return F.concat(_said("user", asked), _said("assistant", get("output", "string")))


def _pair(ask: str, answer: str) -> Callable[[Get], Column]:
    return lambda get: F.concat(_said("user", get(ask, "string")), _said("assistant", get(answer, "string")))


def _led(lead: str, rest: Callable[[Get], Column]) -> Callable[[Get], Column]:
    return lambda get: F.concat(_said("system", get(lead, "string")), rest(get))


@dataclass(frozen=True)
class Layout:
    """``like``: a record's fields; a list holds what its elements look like, None is any scalar."""

    like: dict
    turns: Callable[[Get], Column]

    def fingerprint(self) -> str:
        return hashlib.sha256(shape(self.like).encode()).hexdigest()


_SHARED_NAMES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
_CHAT = _list("messages", "role", "content")
LAYOUTS = (
    Layout({"turns": [{"turn": None, "role": None, "text": None}]}, _numbered),
    Layout({"messages": [{"role": None, "content": None}]}, _CHAT),
    Layout({"system": None, "messages": [{"role": None, "content": None}]}, _led("system", _CHAT)),
    Layout({"conversations": [{"from": None, "value": None}]}, _list("conversations", "from", "value", _SHARED_NAMES)),
    Layout({"instruction": None, "input": None, "output": None}, _instruction),
    Layout({"instruction": None, "output": None}, _pair("instruction", "output")),
    Layout({"prompt": None, "completion": None}, _pair("prompt", "completion")),
    Layout({"prompt": None, "response": None}, _pair("prompt", "response")),
    Layout({"system": None, "prompt": None, "response": None}, _led("system", _pair("prompt", "response"))),
    Layout({"question": None, "answer": None}, _pair("question", "answer")),
)


def shape(like: object) -> str:
    """Nested field paths as text, fields in order of their names."""
    if isinstance(like, dict):
        return "OBJECT<" + ", ".join(f"{k}: {shape(like[k])}" for k in sorted(like)) + ">"
    if isinstance(like, list):
        return f"ARRAY<{shape(like[0])}>"
    return "ANY"


def shape_of_type(kind: T.DataType) -> str:
    if isinstance(kind, T.StructType):
        return shape_of_fields({f.name: f.dataType for f in kind})
    if isinstance(kind, T.ArrayType):
        return f"ARRAY<{shape_of_type(kind.elementType)}>"
    return "ANY"


def shape_of_fields(fields: dict[str, T.DataType]) -> str:
    return "OBJECT<" + ", ".join(f"{k}: {shape_of_type(fields[k])}" for k in sorted(fields)) + ">"


def fingerprint_json(record: Column) -> Column:
    """Hash of the nested field paths of a JSON text; null where it cannot be parsed."""
    kinds = r"(?<=[:<] |<|^)(STRING|BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|BOOLEAN|VOID|DECIMAL\(\d+, ?\d+\))(?=[,>]|$)"
    return F.sha2(F.regexp_replace(F.schema_of_variant(F.try_parse_json(record)), kinds, "ANY"), 256)


def turns_of_json(record: Column, layouts: tuple[Layout, ...] = LAYOUTS) -> Column:
    """Canonical turns of a JSON record, or null without a mapping for its fingerprint."""
    value, found = F.try_parse_json(record), fingerprint_json(record)
    out = F.lit(None).cast(f"array<{TURN}>")
    for layout in layouts:
        out = F.when(
            found == layout.fingerprint(), layout.turns(lambda path, kind: F.try_variant_get(value, f"$.{path}", kind))
        ).otherwise(out)
    return out


def turns_of_columns(df: DataFrame, columns: list[str], layouts: tuple[Layout, ...] = LAYOUTS) -> Column:
    """Canonical turns of typed columns; the fingerprint of their schema selects the mapping."""
    own = shape_of_fields({c: df.schema[c].dataType for c in columns})
    found = hashlib.sha256(own.encode()).hexdigest()
    for layout in layouts:
        if layout.fingerprint() == found:
            return layout.turns(lambda path, kind: F.col(path).cast(kind) if kind == "string" else F.col(path))
    raise ValueError(f"no mapping for fields {own}")


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


_OPEN, _MID, _CLOSE = "<turn><role>", "</role>", "</turn>"


def format_turns(turns: Column) -> Column:
    """The formatted conversation."""
    return F.array_join(
        F.transform(
            turns,
            lambda t: F.concat(F.lit(_OPEN), escape(t["role"]), F.lit(_MID), escape(t["text"]), F.lit(_CLOSE)),
        ),
        "",
    )


def loss_mask(turns: Column, learns: str = "assistant") -> Column:
    """(start, length) spans, in code points of the formatted text, of the texts that training learns."""
    begin = F.struct(
        F.lit(0).cast("bigint").alias("at"), F.array().cast("array<struct<start: bigint, length: bigint>>").alias("spans")
    )

    def step(acc: Column, t: Column) -> Column:
        size = F.length(escape(t["text"])).cast("bigint")
        start = acc["at"] + F.lit(len(_OPEN) + len(_MID)) + F.length(escape(t["role"]))
        span = F.array(F.struct(start.alias("start"), size.alias("length")))
        return F.struct(
            (start + size + F.lit(len(_CLOSE))).alias("at"),
            F.when(t["role"] == learns, F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"),
        )

    return F.aggregate(turns, begin, step, lambda acc: acc["spans"])


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation."""
    pieces = F.split(formatted, _CLOSE)
    pieces = F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0)))

    def one(p: Column) -> Column:
        head = F.substring_index(p, _MID, 1)
        return F.struct(
            unescape(F.substr(head, F.lit(len(_OPEN) + 1))).alias("role"),
            unescape(F.substr(p, F.length(head) + F.lit(len(_MID) + 1))).alias("text"),
        )

    return F.transform(pieces, one)


def read_loss(formatted: Column, spans: Column) -> Column:
    """The unescaped text under the loss mask."""
    return F.array_join(
        F.transform(
            spans, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))
        ),
        "",
    )


def conversations_from_rows(rows: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """Rows of turn, role and text as one record per conversation, with canonical turns."""
    record = rows.select(
        F.col(id_col).alias("conv_id"),
        F.struct(F.col("turn").cast("bigint").alias("turn"), F.col("role").alias("role"), F.col("text").alias("text")).alias("row"),
    )
    record = record.groupBy("conv_id").agg(F.collect_list("row").alias("turns"))
    return record.select("conv_id", turns_of_columns(record, ["turns"]).alias("turns"))


def formatted(conversations: DataFrame) -> DataFrame:
    """``conv_id``, the formatted text and its loss mask."""
    return conversations.select(
        "conv_id", format_turns(F.col("turns")).alias("formatted"), loss_mask(F.col("turns")).alias("loss")
    )


def digests(out: DataFrame) -> DataFrame:
    """What the formatted texts say when they are read back."""
    back = out.select(
        "conv_id", F.length("formatted").cast("bigint").alias("formatted_chars"),
        read_turns(F.col("formatted")).alias("turns"), read_loss(F.col("formatted"), F.col("loss")).alias("learnt"),
    )
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return back.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length("learnt").cast("bigint").alias("loss_chars"), F.sha2("learnt", 256).alias("loss_sha256"),
        "formatted_chars",
    )


_HARD = "\\### Assistant: </turn> ok"


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = conversations_from_rows(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    message = lambda role: F.struct(F.lit(role).alias("role"), F.lit(_HARD).alias("content"))
    extra = spark.range(1).select(
        F.lit(-7).cast("bigint").alias("conv_id"), F.array(message("user"), message("assistant")).alias("messages")
    )
    extra = extra.select("conv_id", turns_of_columns(extra, ["messages"]).alias("turns"))
    return digests(formatted(stored.unionByName(extra)))


def _size(c: str) -> str:
    return f"length(replace(replace({c}, '&', '&amp;'), '<', '&lt;'))"


ORACLE = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{_HARD}' UNION ALL SELECT -7, 1, 'assistant', '{_HARD}')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum({len(_OPEN) + len(_MID) + len(_CLOSE)} + {_size('role')} + {_size('text')}) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""
