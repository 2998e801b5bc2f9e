"""Chat formatting from event logs.

Method: a conversation is a log of events (`create`, `delta`, `edit`, `regenerate`).  Each
message is folded by itself: the last event that sets its text anew counts, followed by the
deltas after it in order of sequence; a regeneration also drops the later messages that were
there before it.  Messages are rendered one by one, and the text of assistants is under the
loss mask.  A row of the output is one message, so that no conversation has to fit a task:
the digests run through the sorted rows with a constant state.

Template: `<|im_start|>` role newline text `<|im_end|>` newline.  Inside roles and texts a
backslash is doubled and another one is put into every control string (and before a newline
of a role), so that reading back restores both exactly.

Null text and null role: empty.  Null conversation or turn: a key like any other, sorted
first.  Equal events count once; rows of the same turn are separate messages, in the order of
role and text.  Events of an unknown kind are ignored.  Other columns are ignored."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wordloom.session import written

START, END = "<|im_start|>", "<|im_end|>"
RESTARTS = ("create", "edit", "regenerate")
KINDS = (*RESTARTS, "delta")
LEARNED_ROLE = "assistant"
DELTA_CHARS = 256
# Where a control string may begin: <|...|>, <s>, </s>, <<SYS>>, <</SYS>>, [INST], [/INST].
CONTROL = r"(<(?=[|/<s])|\[(?=/?INST\]))"
EXAMPLE_ID = -7
EXAMPLE_TEXT = "</s>[INST] ok [/INST]"


def fold(events: DataFrame) -> DataFrame:
    """(conv_id, msg, role, text), written once: the final messages of the logs
    (conv_id, seq, kind, msg, role, text); seq and msg may be of any ordered type."""
    known = events.where(F.col("kind").isin(*KINDS))
    restart = F.when(F.col("kind").isin(*RESTARTS), F.col("seq"))
    own = known.groupBy("conv_id", "msg").agg(
        F.max(restart).alias("restart"),
        F.max(F.when(F.col("kind") == "regenerate", F.col("seq"))).alias("again"),
        F.max_by("role", F.when(F.col("role").isNotNull(), F.col("seq"))).alias("role"),
        F.collect_set(F.struct("seq", F.coalesce("text", F.lit("")).alias("text"))).alias("parts"),
    )
    current = F.filter(F.sort_array("parts"), lambda p: F.coalesce(p["seq"] >= F.col("restart"), F.lit(True)))
    text = F.array_join(F.transform(current, lambda p: p["text"]), "")
    messages = written(own.select("conv_id", "msg", "restart", "again", F.coalesce("role", F.lit("")).alias("role"), text.alias("text")))
    # keys only, and only of conversations with a regeneration
    keys = messages.select("conv_id", "msg", "restart", "again")
    some = keys.where(F.col("again").isNotNull()).select(F.col("conv_id").alias("_c")).distinct()
    keys = keys.join(some, F.col("conv_id").eqNullSafe(F.col("_c")), "left_semi")
    earlier = Window.partitionBy("conv_id").orderBy("msg").rowsBetween(Window.unboundedPreceding, -1)
    gone = keys.withColumn("_last", F.max("again").over(earlier)).where(F.col("_last") > F.col("restart"))
    gone = gone.select(F.col("conv_id").alias("_c"), F.col("msg").alias("_m"))
    match = F.col("conv_id").eqNullSafe(F.col("_c")) & F.col("msg").eqNullSafe(F.col("_m"))
    return messages.join(gone, match, "left_anti").select("conv_id", "msg", "role", "text")


def escaped(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), CONTROL, r"$1\\")


def render(messages: DataFrame) -> DataFrame:
    """`messages` with segment, and loss_start and loss_length: the code points of the segment
    under the loss mask."""
    role = F.replace(escaped(F.col("role")), F.lit("\n"), F.lit("\\\n"))
    body = escaped(F.col("text"))
    head = F.concat(F.lit(START), role, F.lit("\n"))
    learned = F.col("role") == LEARNED_ROLE
    return messages.select(
        "conv_id",
        "msg",
        F.concat(head, body, F.lit(END + "\n")).alias("segment"),
        F.when(learned, F.length(head)).otherwise(0).alias("loss_start"),
        F.when(learned, F.length(body)).otherwise(0).alias("loss_length"),
    )


def formatted(segments: DataFrame) -> DataFrame:
    """(conv_id, formatted): whole conversations, for use where each fits a row."""
    parts = F.sort_array(F.collect_list(F.struct("msg", "segment")))
    return segments.groupBy("conv_id").agg(F.array_join(F.transform(parts, lambda p: p["segment"]), "").alias("formatted"))


_ESCAPE = re.compile(r"\\(.)", re.DOTALL)


def unescape(text: str) -> str:
    return _ESCAPE.sub(r"\1", text)


_HEAD_END = re.compile(r"(?:[^\\\n]|\\.)*", re.DOTALL)


def read_segment(segment: str) -> tuple[str, str]:
    """(role, text) of a rendered message; an error if it isn't one."""
    if not segment.startswith(START) or not segment.endswith(END + "\n"):
        raise ValueError("not a rendered message")
    cut = _HEAD_END.match(segment, len(START)).end()
    body = segment[cut + 1 : -len(END) - 1]
    if segment[cut] != "\n" or START in body or END in body:
        raise ValueError("not a rendered message")
    return unescape(segment[len(START) : cut]), unescape(body)


def digests(segments: DataFrame) -> DataFrame:
    """One row per conversation, read back from the rendered messages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current: object = run  # no conversation yet
        done: list[tuple] = []
        state: list = []

        def close() -> None:
            if current is not run:
                n, turns, chars, loss, total = state
                done.append((current, n, turns.hexdigest(), chars, loss.hexdigest(), total))

        def flush() -> pa.RecordBatch:
            columns = list(zip(*done)) if done else [[]] * len(types)
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

        for batch in batches:
            rows = batch.to_pydict()
            for conv, segment, at, length in zip(rows["conv_id"], rows["segment"], rows["loss_start"], rows["loss_length"]):
                if current is run or conv != current:
                    close()
                    current, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, text = read_segment(segment)
                learned = unescape(segment[at : at + length])
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode("utf-8", "replace"))
                state[2] += len(learned)
                state[3].update(learned.encode("utf-8", "replace"))
                state[4] += len(segment)
            if len(done) >= 1_000:
                yield flush()
        close()
        if done:
            yield flush()

    kind = segments.schema["conv_id"].dataType
    if kind.typeName() not in ("long", "integer", "string"):
        raise ValueError("conv_id must be a number or a string")
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    types = [{"long": pa.int64(), "integer": pa.int32(), "string": pa.string()}[kind.typeName()]]
    types += [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    schema = f"conv_id {kind.simpleString()}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    dealt = segments.repartition("conv_id").sortWithinPartitions("conv_id", "msg")
    return dealt.select("conv_id", "segment", "loss_start", "loss_length").mapInArrow(run, schema)


def turn_events(turns: DataFrame) -> DataFrame:
    """Finished turns (conv_id, turn, role, text) as the log of their streaming: a message is
    created, then its text comes in deltas."""
    same = Window.partitionBy("conv_id", "turn").orderBy("role", "text")
    text = F.coalesce("text", F.lit(""))
    numbered = turns.select("conv_id", "turn", "role", text.alias("text"), F.row_number().over(same).alias("twin"))
    pieces = F.ceil(F.length("text") / DELTA_CHARS).cast("int")
    steps = numbered.withColumn("step", F.explode(F.sequence(F.lit(0), pieces)))
    created = F.col("step") == 0
    return steps.select(
        "conv_id",
        F.struct("turn", "twin", "step").alias("seq"),
        F.when(created, "create").otherwise("delta").alias("kind"),
        F.struct("turn", "twin").alias("msg"),
        F.when(created, F.col("role")).alias("role"),
        F.when(~created, F.substring("text", (F.col("step") - 1) * DELTA_CHARS + 1, F.lit(DELTA_CHARS))).alias("text"),
    )


def example_turns(turns: DataFrame) -> DataFrame:
    """A conversation whose texts consist of control strings."""
    rows = [(EXAMPLE_ID, 0, "user", EXAMPLE_TEXT), (EXAMPLE_ID, 1, "assistant", EXAMPLE_TEXT)]
    return turns.sparkSession.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
