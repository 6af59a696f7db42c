"""Chat formatting from event logs.

A log holds events of conversations: `message` opens a message with its role and
text, `delta` appends to it, `edit` replaces its text, `regenerate` empties it for
new deltas and `delete` removes it.  The log is partitioned by conversation and
message, sorted by sequence and folded: what counts is the last event that sets a
text and the deltas after it, all in one grouping.  Each final message is rendered to one segment; a
conversation is the concatenation of its segments, so one of any length is never
held in one place.

    <|turn:ROLE|>\\nTEXT<|end|>\\n

Control strings in roles and texts get a backslash after their first character,
and backslashes are doubled, so no text can open or close a turn, and read() gives
back exactly what was written.  The loss mask of a segment is the span of an
assistant's text in it.

Defined cases: a null text or role is empty; a null conversation is a conversation
of its own; repeated rows of one turn are turns of their own, in order of role and
text; null turns come first; an empty log gives no rows; other columns are not
read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import QUERIES, table

#: Strings that chat templates give a meaning to.
CONTROL = ("<|", "|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
OPEN, SHUT, END = "<|turn:", "|>\n", "<|end|>\n"
SEGMENT = re.compile(r"<\|turn:(.*?)\|>\n(.*)<\|end\|>\n", re.DOTALL)
SETTING = ("message", "edit", "regenerate", "delete")
KEY = ["conv_id", "message", "copy"]


def escaped(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in CONTROL:
        out = F.replace(out, F.lit(c), F.lit(f"{c[0]}\\{c[1:]}"))
    return out


def unescaped(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def conversation_events(turns: DataFrame) -> DataFrame:
    """A table of turns (conv_id, turn, role, text) as the log that a chat service would keep: an assistant's text is streamed in two deltas after a
    regeneration, a user's is edited into an empty message, any other is the text of its message."""
    same = Window.partitionBy("conv_id", "turn").orderBy("role", "text")
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).withColumn("copy", F.row_number().over(same))
    none, half = F.lit(None).cast("string"), F.ceil(F.length("text") / 2).cast("int")
    event = lambda seq, kind, role, text: F.struct(F.lit(seq).alias("seq"), F.lit(kind).alias("kind"), role.alias("role"), text.alias("text"))
    opened, role, text = event(0, "message", F.col("role"), none), F.col("role"), F.col("text")
    streamed = F.array(opened, event(1, "regenerate", none, none), event(2, "delta", none, text.substr(F.lit(1), half)), event(3, "delta", none, text.substr(half + 1, F.length("text"))))
    log = F.when(role == "assistant", streamed).when(role == "user", F.array(opened, event(1, "edit", none, text))).otherwise(F.array(event(0, "message", role, text)))
    return rows.select("conv_id", F.col("turn").alias("message"), "copy", F.inline(log))


def final_messages(events: DataFrame) -> DataFrame:
    """Folds events (conv_id, message, copy, seq, kind, role, text) into (conv_id, message, copy, role, text) of the messages that stay, in one grouping."""
    event = F.struct("seq", F.when(F.col("kind") == "delta", 1).otherwise(0).alias("d"), "kind", "role", "text")
    log = events.groupBy(*KEY).agg(F.array_sort(F.collect_list(event)).alias("log"))
    last = lambda kinds: F.array_max(F.transform("log", lambda e, i: F.when(e["kind"].isin(*kinds), i + 1)))
    made = log.withColumns({"since": F.coalesce(last(SETTING), F.lit(1)), "opened": last(("message",))})
    text = lambda e: F.when(e["kind"] == "regenerate", F.lit("")).otherwise(F.coalesce(e["text"], F.lit("")))
    parts = F.transform(F.slice("log", F.col("since"), F.size("log")), text)
    kept = made.where(F.element_at("log", F.col("since"))["kind"] != "delete")
    return kept.select(*KEY, F.coalesce(F.get("log", F.col("opened") - 1)["role"], F.lit("")).alias("role"), F.array_join(parts, "").alias("text"))


def rendered(messages: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """(conv_id, message, copy, segment, loss_from, loss_to): spans in code points of the segment; equal ends mean no loss."""
    head = F.concat(F.lit(OPEN), escaped(F.col("role")), F.lit(SHUT))
    body = escaped(F.col("text"))
    learnt = F.col("role").isin(*loss_roles)
    start = F.length("head")
    made = messages.select(*KEY, "role", head.alias("head"), body.alias("body"))
    return made.select(*KEY, F.concat("head", "body", F.lit(END)).alias("segment"), start.alias("loss_from"), (start + F.when(learnt, F.length("body")).otherwise(0)).alias("loss_to"))


def read(segment: str) -> tuple[str, str]:
    """The role and text that a segment was rendered from."""
    found = SEGMENT.fullmatch(segment)
    if not found:
        raise ValueError(f"not a segment: {segment[:60]!r}")
    return unescaped(found[1]), unescaped(found[2])


_DIGEST = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments in order -> one row per conversation, read back one segment at a time."""
    rows: list[tuple] = []
    conv, any_row = None, False
    n = chars = loss = 0
    turns, learnt = hashlib.sha256(), hashlib.sha256()
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
    batch_of = lambda: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
    for batch in batches:
        for c, segment, lo, hi in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if any_row and c != conv:
                rows.append((conv, n, turns.hexdigest(), loss, learnt.hexdigest(), chars))
                n = chars = loss = 0
                turns, learnt = hashlib.sha256(), hashlib.sha256()
            conv, any_row = c, True
            role, text = read(segment)
            turns.update(f"{role}\n{text}\n".encode())
            under = unescaped(segment[lo:hi])
            learnt.update(under.encode())
            n, chars, loss = n + 1, chars + len(segment), loss + len(under)
        if len(rows) >= 1000:
            yield batch_of()
            rows = []
    if any_row:
        rows.append((conv, n, turns.hexdigest(), loss, learnt.hexdigest(), chars))
    if rows:
        yield batch_of()


def by_conversation(df: DataFrame) -> DataFrame:
    """Whole conversations per partition.  Turns dealt so before they are formatted are not moved again."""
    return df.repartition("conv_id")


def digests(segments: DataFrame, dealt: bool = False) -> DataFrame:
    """What reading the formatted conversations back gives, per conversation; dealt: by_conversation() was applied to the turns.

    A digest needs all of its conversation in one task; that task reads it sorted, a segment at a time."""
    ordered = (segments if dealt else by_conversation(segments)).sortWithinPartitions("conv_id", "message", "copy")
    return ordered.select("conv_id", "segment", "loss_from", "loss_to").mapInArrow(_digests, _DIGEST)


def formatted(turns: DataFrame) -> DataFrame:
    """Segments of a table of turns."""
    return rendered(final_messages(conversation_events(turns)))


_PROBE = "</s>[INST] ok [/INST]"


@QUERIES.query("op9_chat_format")
def op9_chat_format(spark, sf_dir) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-1, 0, "user", _PROBE), (-1, 1, "assistant", _PROBE)], "conv_id bigint, turn bigint, role string, text string")
    return digests(formatted(by_conversation(turns.unionByName(probe))), dealt=True)
