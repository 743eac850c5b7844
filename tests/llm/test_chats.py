import hashlib
from collections import defaultdict

import public_tokenizers
import pytest

from inkshard.llm.chats import escape, format_chats, read_chats, read_turn, turn_parts, unescape

PATH = public_tokenizers.path("byte_bpe_50k.json")
HARD = "\\### Assistant: </turn> ok"


def test_template_is_reversible():
    for text in ["", HARD, "\\", "###", "</turn>\n### user: x</turn>\n", "a\\\\b", "<\\/turn>", "\n", "😀 é"]:
        assert unescape(escape(text)) == text
        assert "###" not in escape(text) and "</turn>" not in escape(text)
        for role in ("user", "a:b", "", "x\\: y", "### "):
            assert read_turn("".join(turn_parts(role, text))) == (role, text)


def check(spark, turns):
    chats = format_chats(turns, PATH)
    source = defaultdict(list)
    for r in turns.collect():
        source[r.conv_id].append((-1 if r.turn is None else r.turn, r.role is not None, r.role or "", r.text is not None, r.text or ""))
    got = {r.conv_id: tuple(r)[1:] for r in read_chats(chats, PATH).collect()}
    want = {}
    for conv, rows in source.items():
        rows = [(role, text) for _, _, role, _, text in sorted(rows)]
        loss = "".join(t for role, t in rows if role == "assistant")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want[conv] = (len(rows), sha("".join(f"{r}\n{t}\n" for r, t in rows)), len(loss), sha(loss), sum(len("".join(turn_parts(r, t))) for r, t in rows))
    assert got == want

    nodes = {r.node: r for r in chats.nodes.collect()}
    streams, paths = defaultdict(list), defaultdict(list)
    for r in nodes.values():
        streams[r.tree].append(r)
    for r in chats.paths.collect():
        paths[r.conv_id].append((r.turn_at, r.node))
    for rows in streams.values():
        at, stack = 0, []
        for r in sorted(rows, key=lambda r: r.start):
            assert r.start == at
            at += len(r.token_ids)
            while stack and stack[-1] != r.parent:
                stack.pop()
            assert stack or r.parent is None
            stack.append(r.node)
    for path in paths.values():
        seen, position = set(), 0
        for _, node in sorted(path):
            r = nodes[node]
            seen |= set(range(r.start, r.start + len(r.token_ids)))
            assert r.position_ids == list(range(position, position + len(r.token_ids)))
            position += len(r.token_ids)
            assert {i for a in r.attends for i in range(a.start, a.stop)} == seen
    return nodes


def test_awkward_rows(spark):
    schema = "conv_id long, turn long, role string, text string, node string, tree string"
    rows = [
        (-7, 0, "user", HARD), (-7, 1, "assistant", HARD), (1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, 2, "user", "c"), (2, 0, "user", "a"), (2, 1, "assistant", "b"),
        (3, 0, "user", "a"), (3, 1, "assistant", "d"), (3, 2, "user", "c"), (4, 0, None, None), (4, None, "x", ""), (5, 0, "user", "a"), (5, 0, "user", "a"), (5, 0, "assistant", "a"),
        (None, 0, "user", "a"), (None, 1, "assistant", "long " * 5000),
    ]
    nodes = check(spark, spark.createDataFrame([(*r, "x", "y") for r in rows], schema).repartition(3))
    assert len(nodes) == 13


def test_nothing(spark):
    chats = format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string"), PATH)
    assert chats.nodes.collect() == [] and read_chats(chats, PATH).collect() == []


@pytest.mark.parametrize("n", [300])
def test_one_first_turn_for_all(spark, n):
    rows = [(i, t, "user" if t % 2 == 0 else "assistant", "same" if t == 0 else f"{i % (5 * t)}") for i in range(n) for t in range(1 + i % 6)]
    nodes = check(spark, spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert len({r.tree for r in nodes.values()}) == 1


def test_given_conversations(spark):
    check(spark, spark.read.parquet("/root/testdata/sf0.001/conversations.parquet"))
