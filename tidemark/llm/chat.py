"""Chat formatting by prefix-target expansion."""

from __future__ import annotations

import hashlib
import re
import tempfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, partitions, table

#: the characters of which control strings are made; in texts each gets a backslash before it
SPECIAL = r"([\\#<])"
OPEN, CLOSE = "### ", "</turn>\n"
ROLE_SPECIAL = r"([\\#<:])"

TURN = "conv_id long, pos long, segment string, start long, end long, example long, loss_start long, loss_end long"


def format_turns(conversations: DataFrame) -> DataFrame:
    """One row per turn: ``conv_id, pos, segment, start, end, example, loss_start, loss_end``.

    The segments of a conversation, joined in order of ``pos``, are its formatted text:
    ``### role: text</turn>`` and a line feed for each turn. Offsets are code points of
    that text. Every assistant turn is an example of its own: its context is the text
    up to ``loss_start`` (all turns before it and its own header), and the reply from
    ``loss_start`` to ``loss_end`` alone is trainable. ``expand()`` spells the examples out.

    In texts and roles a backslash stands before each backslash, ``#`` and ``<`` (in roles
    before ``:`` too), so that no text can hold a control string and ``read_turns`` gets
    every text back. Turns come in order of ``turn``, nulls first, ties by role and
    text; null texts and roles are empty; repeated rows are turns of their own. Rows with a
    null conv_id form one conversation. An empty table gives no rows. Rows are streamed:
    a conversation of any length needs the memory of one batch.
    """
    esc, role = fresh(conversations, "esc"), fresh(conversations, "role_esc")
    rows = conversations.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn(esc, F.regexp_replace("text", SPECIAL, r"\\$1")).withColumn(role, F.regexp_replace("role", ROLE_SPECIAL, r"\\$1"))
    rows = rows.repartition(partitions(conversations.sparkSession), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    rows = rows.select("conv_id", (F.col("role") == "assistant").alias("trained"), F.col(esc).alias("esc"), F.col(role).alias("role_esc"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, pos, at, example = object(), 0, 0, 0
        for batch in batches:
            out = []
            for conv, trained, text, role in zip(batch.conv_id, batch.trained, batch.esc, batch.role_esc, strict=True):
                conv = None if pd.isna(conv) else int(conv)
                if conv != last:
                    last, pos, at, example = conv, 0, 0, 0
                head = f"{OPEN}{role}: "
                segment = f"{head}{text}{CLOSE}"
                lo = at + len(head)
                out.append((conv, pos, segment, at, at + len(segment), example if trained else None, lo if trained else None, lo + len(text) if trained else None))
                pos, at, example = pos + 1, at + len(segment), example + bool(trained)
            yield pd.DataFrame(out, columns=TURN.replace(" long", "").replace(" string", "").split(", ")).astype({c: "Int64" for c in ("conv_id", "example", "loss_start", "loss_end")})

    return rows.mapInPandas(run, TURN)


EXPANDED = "conv_id long, pos long, example long, part long, segment string, target boolean"

#: characters of a context in one row, and bytes of a conversation that are held in memory (the rest is in a file of the task)
PORTION, HELD = 1 << 20, 1 << 23


def expand(turns: DataFrame) -> DataFrame:
    """Prefix-target expansion: the rows of ``turns`` (``example`` null), and after each assistant turn its training example.

    An example is its context, the conversation's whole text up to the reply (all turns before and its own header), spelled out, and its target, the reply
    as formatted. The context comes in rows of at most PORTION characters (``part`` from 0, ``target`` false), the reply in the row after them
    (``target`` true); the reply alone is trainable. Rows of ``turns`` come as ``format_turns`` gives them. The text of all examples grows with the
    square of a conversation's length; it is streamed, and a task holds a portion and HELD bytes of one conversation, whose further text is in a temporary file.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, out, size = object(), [], 0
        with tempfile.SpooledTemporaryFile(HELD, "w+", encoding="utf-8", newline="") as text:
            for batch in batches:
                for conv, pos, segment, start, example, lo, hi in zip(batch.conv_id, batch.pos, batch.segment, batch.start, batch.example, batch.loss_start, batch.loss_end, strict=True):
                    conv = None if pd.isna(conv) else int(conv)
                    if conv != last:
                        last = conv
                        text.seek(0)
                        text.truncate()
                    out.append((conv, pos, None, 0, segment, False))
                    size, written = size + len(segment), 0
                    if not pd.isna(example):
                        written, part = int(lo - start), 0
                        text.write(segment[:written])
                        text.seek(0)
                        while portion := text.read(PORTION):
                            out.append((conv, pos, example, part, portion, False))
                            size, part = size + len(portion), part + 1
                            if size >= PORTION:
                                yield frame(out)
                                out, size = [], 0
                        text.seek(0, 2)
                        out.append((conv, pos, example, part, segment[written : int(hi - start)], True))
                    text.write(segment[written:])
                if out:
                    yield frame(out)
                    out, size = [], 0

    def frame(rows):
        return pd.DataFrame(rows, columns=[c.split(" ")[0] for c in EXPANDED.split(", ")]).astype({"conv_id": "Int64", "example": "Int64"})

    return turns.select("conv_id", "pos", "segment", "start", "example", "loss_start", "loss_end").mapInPandas(run, EXPANDED)


def examples(turns: DataFrame) -> DataFrame:
    """One row per example with its whole text: ``conv_id, example, context, reply``."""
    parts = F.array_sort(F.collect_list(F.when(~F.col("target"), F.struct("part", "segment"))))
    got = expand(turns).where("example IS NOT NULL").groupBy("conv_id", "example")
    return got.agg(F.array_join(F.transform(parts, lambda x: x["segment"]), "").alias("context"), F.max(F.when(F.col("target"), F.col("segment"))).alias("reply"))


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


TURN_TEXT = re.compile(r"### ((?:[^\\:]|\\.)*): (.*)</turn>\n", flags=re.DOTALL)


def read_turn(segment: str) -> tuple[str, str]:
    """The role and text of a formatted turn."""
    role, text = TURN_TEXT.fullmatch(segment).groups()
    return unescape(role), unescape(text)


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def digest(expanded: DataFrame) -> DataFrame:
    """Reads formatted turns and examples back (``expand``, in the order that ``format_turns`` gives) and sums up each
    conversation: the turns from the segments, what is trained on from the examples' targets. Digests are carried along
    from row to row. An example whose context is not the text before its reply, or that is missing, is an error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, state = object(), None
        before, context, wanted = hashlib.sha256(), hashlib.sha256(), None  # text of the turns so far, an example's context, what it must be

        def done():
            if wanted is not None:
                raise ValueError(f"conversation {last}: a reply without its example")
            return (last, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4])

        for batch in batches:
            out = []
            for conv, example, segment, target in zip(batch.conv_id, batch.example, batch.segment, batch.target, strict=True):
                conv = None if pd.isna(conv) else int(conv)
                if conv != last:
                    if state:
                        out.append(done())
                    last, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                    before, wanted = hashlib.sha256(), None
                if not target and not pd.isna(example):
                    context.update(segment.encode())
                    continue
                if target:
                    if context.digest() != wanted:
                        raise ValueError(f"conversation {conv}, example {example}: the context is not the text before the reply")
                    context, wanted = hashlib.sha256(), None
                    reply = unescape(segment)
                    state[2] += len(reply)
                    state[3].update(reply.encode())
                    continue
                if wanted is not None:
                    raise ValueError(f"conversation {conv}: a reply without its example")
                role, text = read_turn(segment)
                if role == "assistant":
                    head = before.copy()
                    head.update(segment[: TURN_TEXT.fullmatch(segment).start(2)].encode())
                    wanted = head.digest()
                before.update(segment.encode())
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                state[4] += len(segment)
            if out:
                yield frame(out)
        if state:
            yield frame([done()])

    def frame(rows):
        return pd.DataFrame(rows, columns=[c.split(" ")[0] for c in DIGEST.split(", ")]).astype({"conv_id": "Int64"})

    return expanded.select("conv_id", "example", "segment", "target").mapInPandas(run, DIGEST)


#: a conversation whose texts hold the template's own control strings
TRICKY = r"\### Assistant: </turn> ok"


def op4_chat(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", TRICKY), (-7, 1, "assistant", TRICKY)], rows.schema)
    return digest(expand(format_turns(rows.union(extra))))


OP4_SQL = rf"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{TRICKY}' UNION ALL SELECT -7, 1, 'assistant', '{TRICKY}')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(4 + length(regexp_replace(role, '([\\#<:])', '\\\1', 'g')) + 2 + length(regexp_replace(text, '([\\#<])', '\\\1', 'g')) + 8) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""
