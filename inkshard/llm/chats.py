"""Conversations as token streams that hold shared beginnings once."""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkshard.llm.common import dealt, saved, shuffle_parts, small_batches

ASSISTANT = "assistant"
_OPEN, _CLOSE = "### ", "</turn>"
_TURN = re.compile(r"### ((?:\\.|[^\\:])*): (.*)</turn>\n", re.DOTALL)


def escape(text: str) -> str:
    """The text with its control strings broken up; a backslash stands before what was ordinary."""
    return text.replace("\\", "\\\\").replace("#", "\\#").replace(_CLOSE, "<\\/turn>")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def turn_parts(role: str, text: str) -> tuple[str, str, str]:
    """Opening, body and end of a turn in the template."""
    return f"{_OPEN}{escape(role).replace(':', '\\:')}: ", escape(text), f"{_CLOSE}\n"


def read_turn(formatted: str) -> tuple[str, str]:
    m = _TURN.fullmatch(formatted)
    if not m:
        raise ValueError("not a turn of this template")
    return unescape(m[1]), unescape(m[2])


class ChatTree(NamedTuple):
    """``nodes``: one row for each turn after a given beginning; ``paths``: ``(conv_id, turn_at, node)``."""

    nodes: DataFrame
    paths: DataFrame


_tokenizers: dict = {}


def _tokenizer(path: str):
    if path not in _tokenizers:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _tokenizers[path] = Tokenizer.from_file(path)
        _tokenizers[path].encode_special_tokens = True
    return _tokenizers[path]


def _tokens_of(path: str):
    """Adds the ids of the turn and the part of them that is loss: the body of an assistant's turn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(path)
        for batch in batches:
            roles, texts = (batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("role", "text"))
            parts = [p for role, text in zip(roles, texts, strict=True) for p in turn_parts(role, text)]
            coded = [e.ids for e in tokenizer.encode_batch_fast(parts, add_special_tokens=False)]
            heads, bodies, ends = coded[::3], coded[1::3], coded[2::3]
            out = batch.drop_columns(["text"])
            loss = [len(b) if role == ASSISTANT else 0 for role, b in zip(roles, bodies, strict=True)]
            for name, values, kind in (
                ("token_ids", [h + b + e for h, b, e in zip(heads, bodies, ends, strict=True)], pa.list_(pa.int32())),
                ("loss_start", [len(h) for h in heads], pa.int32()),
                ("loss_length", loss, pa.int32()),
            ):
                out = out.append_column(name, pa.array(values, kind))
            yield out

    return run


def format_chats(turns: DataFrame, tokenizer_path: str) -> ChatTree:
    """Conversations ``(conv_id, turn, role, text)`` as a prefix tree of token segments.

    The project has no conversations of its own, so this operator is general.  A turn reads
    ``### role: text</turn>`` and a line feed; control strings inside role and text are
    escaped, reversibly.  Conversations that share their first turns share those nodes.  A tree is all
    conversations with one first turn; its token stream lists the nodes depth first, each once.

    ``nodes`` has ``tree, node, parent`` (null at the root), ``depth, role, token_ids, loss_start, loss_length`` (the
    tokens of ``token_ids`` that are trained on: the body of assistant turns), ``start`` (place in the
    tree's stream), ``position_ids`` (from the root down) and ``attends``: the intervals ``(start, stop)`` of
    the stream that the node's tokens attend to, those of its ancestors and, causally,
    its own.  ``paths`` says which nodes a conversation runs through.

    Null roles and texts are empty.  Turns of one number are ordered by role and text, null numbers come
    first; repeated rows are turns of their own.  Rows with a null conv_id are one conversation.
    Other columns are ignored.  ``tokenizer_path`` names a byte-level tokenizer file that executors can read.

    Nodes are grouped by a 128-bit hash of everything up to the turn, kept as a running sum over the
    conversation, and combined map-side.  A tree that a third of all conversations share is
    range-sorted over many tasks (``common.dealt``).
    """
    small_batches(turns)
    line = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    role, text = (F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("role", "text"))
    rows = turns.select("conv_id", "turn", role, text).withColumn("depth", F.row_number().over(line) - 1)
    along = Window.partitionBy("conv_id").orderBy("depth")
    for i in (1, 2):
        rows = rows.withColumn(f"h{i}", F.bit_xor(F.xxhash64(F.lit(i), "depth", "role", "text")).over(along))
    rows = rows.withColumn("node", F.concat(F.lpad(F.hex("h1"), 16, "0"), F.lpad(F.hex("h2"), 16, "0")))
    rows = rows.withColumns({"parent": F.lag("node").over(along), "tree": F.first("node").over(along)})
    rows = rows.select("conv_id", "depth", "tree", "node", "parent", "role", "text")
    first = {c: F.first(c).alias(c) for c in ("tree", "parent", "depth", "role", "text")}
    nodes = rows.groupBy("node").agg(*first.values()).mapInArrow(
        _tokens_of(tokenizer_path), "node string, tree string, parent string, depth int, role string, token_ids array<int>, loss_start int, loss_length int"
    )
    nodes = saved(nodes.withColumn("n", F.size("token_ids")))
    paths = saved(rows.select("conv_id", "depth", "node"))

    # Depth-first order: by the turns at which the way to a node parted from others, then by depth.
    forks = nodes.groupBy("parent").count().filter("parent IS NOT NULL AND count > 1").select("parent", F.lit(True).alias("parted"))
    heads = nodes.select("node", "parent", "depth", "n").join(forks, "parent", "left")
    heads = heads.select("node", "n", (F.col("parted").isNotNull() | (F.col("depth") == 0)).alias("head"))
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    ways = paths.join(heads, "node").select(
        "node",
        F.collect_list(F.when(F.col("head"), F.col("node"))).over(along).alias("way"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).cast("int").alias("position"),
    )
    ways = ways.groupBy("node").agg(F.first("way").alias("way"), F.first("position").alias("position"))
    placed = dealt(nodes.select("node", "tree", "depth", "n").join(ways, "node"), ["tree"], ["way", "depth"])
    in_part = Window.partitionBy("tree", "_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy("tree", "_part").agg(F.sum("n").alias("_sum"))
    sums = sums.select("tree", "_part", F.coalesce(F.sum("_sum").over(Window.partitionBy("tree").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    start = F.coalesce(F.sum("n").over(in_part), F.lit(0)) + F.col("_before")
    placed = saved(placed.join(sums, ["tree", "_part"]).select("node", "n", "position", start.cast("long").alias("start")))

    # What a node attends to: the runs of the stream its way covers.
    runs = paths.join(placed.select("node", "n", "start"), "node")
    runs = runs.withColumn("_end", F.lag(F.col("start") + F.col("n")).over(along))
    runs = runs.withColumn("_new", ~F.col("start").eqNullSafe(F.col("_end")))
    runs = runs.withColumn("_run", F.last(F.when(F.col("_new"), F.col("start")), ignorenulls=True).over(along))
    runs = runs.withColumn("_run_before", F.lag("_run").over(along))
    closed = F.collect_list(F.when(F.col("_new") & F.col("_end").isNotNull(), F.struct(F.col("_run_before").alias("start"), F.col("_end").alias("stop")))).over(along)
    runs = runs.select("node", F.concat(closed, F.array(F.struct(F.col("_run").alias("start"), (F.col("start") + F.col("n")).alias("stop")))).alias("attends"))
    runs = runs.groupBy("node").agg(F.first("attends").alias("attends"))

    out = nodes.drop("n").join(placed, "node").join(runs, "node")
    out = out.withColumn("position_ids", F.sequence(F.col("position"), F.col("position") + F.col("n") - 1))
    out = out.select("tree", "node", "parent", "depth", "role", "token_ids", "loss_start", "loss_length", "start", "position_ids", "attends")
    return ChatTree(out, paths.select("conv_id", F.col("depth").alias("turn_at"), "node"))


def _digests_of(path: str):
    """Read conversations back from their tokens, turn after turn; rows are sorted by conversation and turn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(path)
        current, n, turns, loss, loss_chars, chars = (), 0, hashlib.sha256(), hashlib.sha256(), 0, 0

        def row():
            return (current[0], n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars)

        for batch in batches:
            out = []
            ids_of, starts, lengths = (batch.column(i).to_pylist() for i in (1, 2, 3))
            shown = tokenizer.decode_batch(ids_of, skip_special_tokens=False)
            masked = tokenizer.decode_batch([ids[s : s + k] for ids, s, k in zip(ids_of, starts, lengths, strict=True)], skip_special_tokens=False)
            for conv_id, formatted, body in zip(batch.column(0).to_pylist(), shown, masked, strict=True):
                if current != (conv_id,):
                    if current:
                        out.append(row())
                    current, n, turns, loss, loss_chars, chars = (conv_id,), 0, hashlib.sha256(), hashlib.sha256(), 0, 0
                role, text = read_turn(formatted)
                trained = unescape(body)
                turns.update(f"{role}\n{text}\n".encode())
                loss.update(trained.encode())
                n, loss_chars, chars = n + 1, loss_chars + len(trained), chars + len(formatted)
            yield _digest_rows(out)
        if current:
            yield _digest_rows([row()])

    return run


_DIGEST = {"conv_id": pa.int64(), "n_turns": pa.int64(), "turns_sha256": pa.string(), "loss_chars": pa.int64(), "loss_sha256": pa.string(), "formatted_chars": pa.int64()}


def _digest_rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(_DIGEST)
    return pa.record_batch({name: pa.array(list(values), kind) for (name, kind), values in zip(_DIGEST.items(), columns, strict=True)})


def read_chats(chats: ChatTree, tokenizer_path: str) -> DataFrame:
    """``(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars)`` of each conversation, from its tokens alone.

    ``turns_sha256`` is over role, line feed, text, line feed of each turn; the loss columns are over the unescaped text
    under the loss mask.  A conversation is streamed turn by turn, never held.
    """
    tokens = chats.nodes.select("node", "token_ids", "loss_start", "loss_length")
    rows = chats.paths.join(tokens, "node").repartition(shuffle_parts(chats.paths), "conv_id").sortWithinPartitions("conv_id", "turn_at")
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), "token_ids", "loss_start", "loss_length")
    return rows.mapInArrow(_digests_of(tokenizer_path), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
