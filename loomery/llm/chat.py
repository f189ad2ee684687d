"""Chat formatting by schema fingerprinting, in DataFrame operations only.

Records of any known layout become canonical turns: the paths of a record's fields (nested ones with dots, array
elements with []) are sorted and hashed, and the hash selects a declarative mapping. A layout without a mapping is
reported with its paths instead of being guessed at. Turns are then written in one template,
``<|im_start|>role\\ntext<|im_end|>\\n``, with a loss mask kept as segments of the formatted text.

Escapes: in texts and roles ``<|`` becomes ``<||``, and in roles a line feed becomes ``<|n>``. So no control string can
come from a text, and both can be undone.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

START, END = "<|im_start|>", "<|im_end|>"

#: layout: (paths, turns). Turns are (role, path) pairs, or (list path, role field, text field).
LAYOUTS: dict[str, tuple[list[str], list[tuple[str, ...]]]] = {
    "prompt": (["prompt", "response"], [("user", "prompt"), ("assistant", "response")]),
    "prompt_completion": (["completion", "prompt"], [("user", "prompt"), ("assistant", "completion")]),
    "question": (["answer", "question"], [("user", "question"), ("assistant", "answer")]),
    "instruction": (["instruction", "output"], [("user", "instruction"), ("assistant", "output")]),
    "instruction_input": (["input", "instruction", "output"], [("user", "instruction+input"), ("assistant", "output")]),
    "system_prompt": (["prompt", "response", "system"], [("system", "system"), ("user", "prompt"), ("assistant", "response")]),
    "messages": (["messages[].content", "messages[].role"], [("messages", "role", "content")]),
    "conversations": (["conversations[].from", "conversations[].value"], [("conversations", "from", "value")]),
}
#: Role names of other layouts.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "prompter": "user"}

_text = lambda *names: [T.StructField(n, T.StringType()) for n in names]
_PART = T.ArrayType(T.StructType(_text("role", "content", "from", "value")))
RECORD = T.StructType([*_text("system", "prompt", "response", "completion", "question", "answer", "instruction", "input", "output"), T.StructField("messages", _PART), T.StructField("conversations", _PART)])


def escape(text):
    return F.replace(text, F.lit("<|"), F.lit("<||"))


def unescape(text):
    return F.replace(text, F.lit("<||"), F.lit("<|"))


def escape_role(role):
    return F.replace(escape(role), F.lit("\n"), F.lit("<|n>"))


def unescape_role(role):
    return unescape(F.replace(role, F.lit("<|n>"), F.lit("\n")))


def schema_paths(schema: T.DataType, at: str = "") -> list[str]:
    """Sorted leaf paths of a schema."""
    if isinstance(schema, T.StructType):
        return sorted(p for f in schema for p in schema_paths(f.dataType, f"{at}.{f.name}" if at else f.name))
    if isinstance(schema, T.ArrayType):
        return schema_paths(schema.elementType, f"{at}[]")
    return [at]


def _has(field: str):
    return lambda e: e[field].isNotNull()


def _record_paths(rec):
    """Sorted paths of the fields that a record has."""
    here = []
    for f in RECORD:
        if isinstance(f.dataType, T.ArrayType):
            for x in f.dataType.elementType:
                some = F.exists(rec[f.name], _has(x.name))
                here.append(F.when(some, F.lit(f"{f.name}[].{x.name}")))
        else:
            here.append(F.when(rec[f.name].isNotNull(), F.lit(f.name)))
    return F.array_sort(F.array_compact(F.array(*here)))


def fingerprint(paths):
    return F.sha2(F.array_join(paths, "\n").cast("binary"), 256)


def _mapped(rec, turns):
    as_turn = lambda role, text: F.struct(role.alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    if len(turns[0]) == 3:
        path, role, text = turns[0]
        known = F.create_map(*(F.lit(x) for kv in ROLES.items() for x in kv))
        return F.transform(rec[path], lambda e: as_turn(F.coalesce(F.try_element_at(known, F.coalesce(e[role], F.lit(""))), e[role], F.lit("")), e[text]))
    joined = lambda path: F.concat_ws("\n\n", *(F.when(rec[p] != "", rec[p]) for p in path.split("+"))) if "+" in path else rec[path]
    return F.array(*(as_turn(F.lit(r), joined(p)) for r, p in turns))


def canonical_turns(df: DataFrame, json_col: str) -> DataFrame:
    """Adds ``layout`` (name, or null if unknown), ``paths`` and ``turns`` (array of role, text) for JSON records.

    A record that is null, no JSON object or of an unknown layout has null turns; its paths say what was found. Fields
    that no layout knows are ignored, as are fields that are null.
    """
    rec = F.from_json(F.col(json_col), RECORD)
    df = df.withColumn("_rec", rec).withColumn("paths", _record_paths(F.col("_rec"))).withColumn("_print", fingerprint(F.col("paths")))
    pick = lambda value: F.coalesce(*(F.when(F.col("_print") == fingerprint(F.array(*map(F.lit, paths))), value(name, turns)) for name, (paths, turns) in LAYOUTS.items()))
    return df.withColumn("layout", pick(lambda name, _: F.lit(name))).withColumn("turns", pick(lambda _, turns: _mapped(F.col("_rec"), turns))).drop("_rec", "_print")


#: Tables with a row per turn, by their sorted column paths: conversation, order, role and text column.
ROW_LAYOUTS = {
    ("conv_id", "role", "text", "turn"): ("conv_id", "turn", "role", "text"),
    ("content", "conversation_id", "message_index", "role"): ("conversation_id", "message_index", "role", "content"),
    ("author", "body", "position", "thread_id"): ("thread_id", "position", "author", "body"),
}


def path_hash(paths: Iterable[str]) -> str:
    """What :func:`fingerprint` gives, for paths at hand."""
    return hashlib.sha256("\n".join(paths).encode()).hexdigest()


def row_layout(schema: T.StructType) -> tuple[str, str, str, str]:
    """The layout of a table with a row per turn, selected by the hash of its column paths.

    A table that has further columns is looked up by the hashes of what it has of the known paths, taken as many at a time as
    a layout has. More than one layout then, or none, is an error that names the paths.
    """
    known = {path_hash(k): v for k, v in ROW_LAYOUTS.items()}
    paths = schema_paths(schema)
    if (whole := path_hash(paths)) in known:
        return known[whole]
    some = [p for p in paths if any(p in k for k in ROW_LAYOUTS)]
    prints = {path_hash(c) for n in {len(k) for k in ROW_LAYOUTS} for c in itertools.combinations(some, n)}
    fits = [known[h] for h in prints & known.keys()]
    if len(fits) != 1:
        raise ValueError(f"no single row layout for columns {paths}")
    return fits[0]


def segments(turns):
    """Formatted turns as (text, loss) segments; loss is true for what assistants say."""
    one = lambda t: F.array(
        F.struct(F.concat(F.lit(START), escape_role(t["role"]), F.lit("\n")).alias("text"), F.lit(False).alias("loss")),
        F.struct(escape(t["text"]).alias("text"), (t["role"] == "assistant").alias("loss")),
        F.struct(F.lit(END + "\n").alias("text"), F.lit(False).alias("loss")),
    )
    return F.flatten(F.transform(turns, one))


def format_rows(df: DataFrame) -> DataFrame:
    """Formats a table with a row per turn: conv_id and ``segments``, one row per conversation.

    The table's layout is found by the fingerprint of its column paths; further columns are ignored. Turns go by their order
    column, then role and text; null ones come first. A null role or text is empty. Rows with a null conversation are
    one conversation, and repeated rows are turns of their own. No rows give no rows. A conversation is one text, so
    its turns meet in one task; they are formatted before they do.
    """
    conv, turn, role, text = (F.col(f"`{c}`") for c in row_layout(df.schema))
    turn_of = F.struct(turn.alias("turn"), F.coalesce(role.cast("string"), F.lit("")).alias("role"), F.coalesce(text.cast("string"), F.lit("")).alias("text"))
    grouped = df.groupBy(conv.alias("conv_id")).agg(F.array_sort(F.collect_list(turn_of)).alias("turns"))
    return grouped.select("conv_id", segments(F.col("turns")).alias("segments"))


def formatted(segs):
    return F.array_join(F.transform(segs, lambda s: s["text"]), "")


def parse_turns(text):
    """Turns of a formatted text, undone: array of (role, text)."""
    body = F.filter(F.split(text, r"<\|im_end\|>\n"), lambda x: x != "")
    one = lambda x: F.struct(
        unescape_role(F.substr(F.substring_index(x, "\n", 1), F.lit(len(START) + 1))).alias("role"),
        unescape(F.substr(x, F.length(F.substring_index(x, "\n", 1)) + 2)).alias("text"),
    )
    return F.transform(body, one)


def loss_text(segs):
    """What assistants say, undone text by text: two texts may join to what looks like an escape."""
    return F.array_join(F.transform(F.filter(segs, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")


def chat_report(df: DataFrame) -> DataFrame:
    """The contract's digest, read back from what :func:`format_rows` gives."""
    out = format_rows(df).withColumn("formatted", formatted(F.col("segments"))).withColumn("turns", parse_turns(F.col("formatted"))).withColumn("loss", loss_text(F.col("segments")))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return out.select("conv_id", F.size("turns").cast("long").alias("n_turns"), sha(turns).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), sha(F.col("loss")).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))
