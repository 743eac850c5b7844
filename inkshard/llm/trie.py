"""Documents that share their first blocks, as a z-fast trie over block sequences."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkshard.llm.common import larger, shuffle_parts
from inkshard.operators.ordered import over_groups, over_ranges
from inkshard.session import written

ROOT = ""
_EDGE = ["owner", "start", "stop", "node", "first", "handle"]


class PrefixTrie(NamedTuple):
    """``nodes``: one row for each different beginning of documents; ``ends``: ``(doc_id, node)``, where each document ends."""

    nodes: DataFrame
    ends: DataFrame


def fattest(low: Column, high: Column) -> Column:
    """The number in (low, high] that the largest power of two divides, for 0 <= low < high."""
    drop = F.length(F.bin(low.bitwiseXOR(high))) - 1
    return high.bitwiseAND(F.call_function("shiftleft", F.lit(-1).cast("long"), drop))


def share_beginnings(blocks: DataFrame, every: int, first: Column) -> tuple[DataFrame, DataFrame]:
    """``(blocks, documents)``: every document rebuilt on the beginning of another one.

    Its first ``first`` blocks (a column of ``doc_id``, at most a small number) come from document ``doc_id -
    doc_id % every``, all of them if it has fewer and none without such a document; its own
    blocks after as many follow.  The order of blocks is that of ``build_trie``.  ``documents``
    lists every doc_id, as a rebuilt document may have no blocks.  A null doc_id keeps its own blocks.
    """
    rows = blocks.select("doc_id", "pos", F.coalesce("kind", F.lit("")).alias("kind"), F.coalesce("text", F.lit("")).alias("text"))
    h = F.coalesce(first.cast("long"), F.lit(0))
    rows = rows.withColumns({"_t1": F.xxhash64(F.lit(1), "kind", "text"), "_t2": F.xxhash64(F.lit(2), "kind", "text")})
    own = written(over_ranges(rows, ["doc_id"], ["pos", "_t1", "_t2"], lambda df, scan: scan.ordinal(df, "n")).drop("pos", "_t1", "_t2"))
    documents = own.filter("n = 1").select("doc_id")
    heads = documents.select("doc_id", (F.col("doc_id") - F.col("doc_id") % every).alias("_base"), h.alias("_h")).filter("_h > 0")
    taken = heads.join(own.withColumnRenamed("doc_id", "_base"), "_base").filter(F.col("n") <= F.col("_h")).select("doc_id", F.col("n").alias("pos"), "kind", "text")
    kept = own.filter(F.col("n") > h).select("doc_id", F.col("n").alias("pos"), "kind", "text")
    return taken.unionByName(kept), documents


def _paths(blocks: DataFrame, documents: DataFrame | None) -> DataFrame:
    """``(doc, d, node, parent, chars)``: the beginning of each document after each of its blocks, and the root at depth 0.

    ``node`` is 128 bits of all blocks up to there, ``doc`` a struct, so that a null doc_id equals itself.
    """
    kind, text = (F.coalesce(c, F.lit("")) for c in ("kind", "text"))
    rows = blocks.select("doc_id", "pos", F.xxhash64(F.lit(1), kind, text).alias("t1"), F.xxhash64(F.lit(2), kind, text).alias("t2"), F.char_length(text).cast("long").alias("chars"))

    def body(df, scan):
        df = scan.ordinal(df, "d").withColumns({f"x{i}": F.xxhash64(F.lit(i), "d", "t1", "t2") for i in (1, 2)})
        return scan.running(df, h1=("xor", F.col("x1")), h2=("xor", F.col("x2")))

    doc = F.struct("doc_id").alias("doc")
    hashed = lambda a, b: F.concat(F.lpad(F.hex(a), 16, "0"), F.lpad(F.hex(b), 16, "0"))
    # What the block itself put into the hash taken out again gives the hash before it.
    parent = F.when(F.col("d") == 1, ROOT).otherwise(hashed(F.col("h1").bitwiseXOR(F.col("x1")), F.col("h2").bitwiseXOR(F.col("x2"))))
    rows = over_ranges(rows, ["doc_id"], ["pos", "t1", "t2"], body).select(doc, "d", hashed("h1", "h2").alias("node"), parent.alias("parent"), "chars")
    ids = blocks.select("doc_id") if documents is None else documents.select("doc_id").unionByName(blocks.select("doc_id"))
    roots = ids.distinct().select(doc, F.lit(0).cast("long").alias("d"), F.lit(ROOT).alias("node"), F.lit(None).cast("string").alias("parent"), F.lit(0).cast("long").alias("chars"))
    return written(rows.unionByName(roots))


def _at(paths: DataFrame, doc: str, d: str, **columns: str) -> DataFrame:
    """Columns of ``paths`` under other names, to be looked up by a document and a depth."""
    return paths.select(F.col("doc").alias(doc), F.col("d").alias(d), *[F.col(c).alias(n) for n, c in columns.items()])


def _exit_edges(pending: DataFrame, trie: DataFrame, paths: DataFrame, longest: int) -> DataFrame:
    """``(doc, m, end, owner, start, stop, node, at)``: the edge that each document leaves the trie on, and the depth ``at`` up to which it runs along it.

    Fat binary search: of the depths still open, the fattest one is looked up among the handles.  A hit
    is an edge that the document reaches, and the search goes on below it; after a miss it goes on above.
    The last edge found, or the child below it that the next block leads to, is the one it leaves on.
    """
    tree = trie.select(*[F.col(c).alias(f"t_{c}") for c in _EDGE])
    number = lambda n: F.lit(n).cast("long")
    # Nothing found means the root, whose edge has no block to run along.
    state = pending.select("doc", "m", "end", F.lit(None).cast(trie.schema["owner"].dataType).alias("owner"), number(-1).alias("start"), number(0).alias("stop"), F.lit(ROOT).alias("node"))
    state = state.withColumns({"known": number(0), "a": number(0), "b": F.least("m", number(longest))})
    for _ in range(longest.bit_length()):
        state = state.withColumn("f", F.when(F.col("a") < F.col("b"), fattest(F.col("a"), F.col("b"))))
        state = state.join(_at(paths, "doc", "f", probe="node"), ["doc", "f"], "left")
        state = state.join(tree.withColumnRenamed("t_handle", "probe"), "probe", "left")
        hit = F.col("t_node").isNotNull()
        state = state.select(
            "doc", "m", "end",
            *[F.when(hit, F.col(f"t_{c}")).otherwise(F.col(c)).alias(c) for c in ("owner", "start", "stop", "node")],
            F.when(hit, F.col("f")).otherwise(F.col("known")).alias("known"),
            F.when(hit, F.col("t_stop")).otherwise(F.col("a")).alias("a"),
            F.when(hit | F.col("f").isNull(), F.col("b")).otherwise(F.col("f") - 1).alias("b"),
        )
        state = written(state)
    # Past the end of the edge found, the next block leads to a child, or to none.
    state = state.withColumn("f", F.col("stop") + 1).join(_at(paths, "doc", "f", up="parent", next="node"), ["doc", "f"], "left")
    passed = F.coalesce(F.col("up") == F.col("node"), F.lit(False))
    state = state.withColumn("first", F.when(passed, F.col("next"))).join(tree.withColumnRenamed("t_first", "first"), "first", "left")
    child = F.col("t_node").isNotNull()
    state = state.select(
        "doc", "m", "end",
        *[F.when(child, F.col(f"t_{c}")).otherwise(F.col(c)).alias(c) for c in ("owner", "start", "stop", "node")],
        F.when(child, F.col("t_start") + 1).when(passed, F.col("stop")).otherwise(F.col("known")).alias("known"),
    )
    state = written(state)
    # Along the edge, as far as the document's beginnings are those of the edge's owner.
    along = state.select("doc", "m", "owner", "stop", "known").join(paths.select("doc", "d", F.col("node").alias("_n")), "doc")
    along = along.filter((F.col("d") > F.col("known")) & (F.col("d") <= F.col("stop"))).select("doc", "owner", "d", "_n")
    along = along.join(_at(paths, "owner", "d", _n="node"), ["owner", "d", "_n"], "left_semi").groupBy("doc").agg(F.max("d").alias("far"))
    return state.join(along, "doc", "left").select("doc", "m", "end", "owner", "start", "stop", "node", F.coalesce("far", "known").alias("at"))


def _with_hashes(edges: DataFrame, paths: DataFrame) -> DataFrame:
    """Edges ``(owner, start, stop)`` with the hashes at their end, after their first block and at their handle."""
    want = F.array(*[F.struct(F.lit(n).alias("name"), d.alias("d")) for n, d in (("node", F.col("stop")), ("first", F.col("start") + 1), ("handle", fattest(F.col("start"), F.col("stop"))))])
    asked = edges.select("owner", "start", "stop", F.explode(want).alias("w")).select("owner", "start", "stop", "w.*")
    found = asked.join(_at(paths, "owner", "d", hash="node"), ["owner", "d"])
    return found.groupBy("owner", "start", "stop").agg(*[F.max(F.when(F.col("name") == n, F.col("hash"))).alias(n) for n in ("node", "first", "handle")]).select(*_EDGE)


def _inserted(trie: DataFrame, exits: DataFrame, paths: DataFrame) -> DataFrame:
    """The trie with a batch: edges cut where documents leave them, and for each way out the longest document on it, smallest id first."""
    cuts = exits.filter("at < stop").groupBy("node", "at").agg(F.first("owner").alias("owner"), F.first("start").alias("start"), F.first("stop").alias("stop"))
    # Different cuts of one edge need as many documents of different lengths, so their number grows with the root of the blocks.
    pieces = cuts.groupBy("node", "owner", "start", "stop").agg(F.array_sort(F.collect_list("at")).alias("at"))
    ends = F.concat(F.array("start"), "at", F.array("stop"))
    spans = F.transform(F.slice(ends, 2, F.size(ends) - 1), lambda e, i: F.struct(F.get(ends, i).alias("start"), e.alias("stop")))
    cut = pieces.select("owner", F.explode(spans).alias("s")).select("owner", "s.*")
    ways = exits.filter("at < m").withColumn("d", F.col("at") + 1).join(_at(paths, "doc", "d", way="node"), ["doc", "d"])
    best = F.struct((-F.col("m")).alias("m"), F.col("doc")).alias("best")
    leaves = ways.groupBy("way").agg(F.min(best).alias("best"), F.first("at").alias("start")).select(F.col("best.doc").alias("owner"), "start", (-F.col("best.m")).alias("stop"))
    whole = trie.join(cuts.select("node").distinct(), "node", "left_anti").select(*_EDGE)
    return written(whole.unionByName(_with_hashes(cut.unionByName(leaves), paths)))


def _compacted(documents: DataFrame, paths: DataFrame) -> DataFrame:
    """The z-fast trie: edges ``(owner, start, stop]`` of the path of a document, with the hash of their end, of their first block and of their handle."""
    top = documents.agg(F.min(F.struct((-F.col("m")).alias("m"), F.col("doc"))).alias("best")).filter("best IS NOT NULL")
    whole = [F.lit(v).cast(t).alias(n) for n, v, t in (("start", -1, "long"), ("stop", 0, "long"), ("node", ROOT, "string"), ("first", None, "string"), ("handle", None, "string"))]
    trie, longest = written(top.select(F.col("best.doc").alias("owner"), *whole)), 0
    while True:
        pending = documents.join(trie.select(F.col("node").alias("end")), "end", "left_anti")
        if not (depth := pending.agg(F.max("m")).first()[0]):
            return trie
        exits = written(_exit_edges(pending, trie, paths, min(longest, depth)))
        trie = _inserted(trie, exits, paths)
        longest = trie.agg(F.max("stop")).first()[0]


def build_trie(blocks: DataFrame, documents: DataFrame | None = None) -> PrefixTrie:
    """The trie of all beginnings of documents, from their blocks ``(doc_id, pos, kind, text)``.

    Two documents share a node as far as their first blocks have the same kind and text, as do those made
    from one template.  Conversations are such documents: a turn is a block, its role the kind.

    ``nodes`` has, for each different sequence of first blocks and for the root (depth 0): ``node`` (128 bits of the
    sequence, empty at the root), ``depth``, ``parent`` (node, null at the root), ``first_doc_id`` (smallest member, a member
    being a document that begins so), ``parent_first_doc_id``, ``n_docs`` (members), ``n_children``, ``n_leaves`` (nodes
    without children in its subtree, itself included), ``saved_chars`` (over its subtree, a node's members but one
    times the characters of its last block: what holding the block once saves).  ``ends`` says where each document ends.

    Blocks are ordered by pos (null first), those of one pos by a hash of kind and text; null kinds and texts are
    empty; repeated rows are blocks of their own.  ``documents`` may list documents without blocks, which end at the root.
    Rows with a null doc_id are one document, which counts, but is the smallest member only where it is the only one.
    Other columns are ignored.  Without any document there is no node.

    The trie is compacted: an edge runs along one document, its owner, from depth ``start`` to ``stop``, and is found by the hash
    at its handle, the fattest depth on it.  Documents are put in in batches: each finds its exit edge by fat
    binary search (joins with the handles), edges are cut at all exits at once, and of those that go on by the
    same block one becomes a new edge; the others and what hangs below it follow in the next batch.
    At last edges are expanded to a node for each depth, and sums of subtrees run up their owners' paths.
    No task holds a document, a subtree or an edge: blocks are numbered and hashed over ranges, sums
    cut along the path.  The driver sees depths, once for each batch.
    """
    paths = _paths(blocks, documents)
    last = F.max(F.struct("d", "node"))
    docs = written(paths.groupBy("doc").agg(last.alias("last")).select("doc", F.col("last.d").alias("m"), F.col("last.node").alias("end")))
    trie = _compacted(docs, paths)

    # Edges of one owner follow each other to its end, so a node is owned where its path lies below the first of them.
    owners = trie.groupBy(F.col("owner").alias("doc")).agg(F.min("start").alias("from"))
    ends = docs.groupBy("end").agg(F.count(F.lit(1)).alias("n_ends"), F.min("doc.doc_id").alias("least")).withColumnRenamed("end", "node")
    owned = written(paths.join(owners, "doc").withColumn("own", F.col("d") > F.col("from")).drop("from"))
    children = written(owned.filter("own AND parent IS NOT NULL").groupBy("parent").agg(F.count(F.lit(1)).alias("n_children")).withColumnRenamed("parent", "node"))
    counted = owned.filter("own").join(ends, "node", "left").join(children, "node", "left").select("doc", "d", "n_ends", "least", F.col("n_children").isNull().cast("long").alias("leaf"), "n_children")
    rows = written(owned.select("doc", "d", "node").join(counted, ["doc", "d"], "left"))

    def up(df: DataFrame, **sums: tuple[str, str]) -> DataFrame:
        """Values of a node's subtree by node, from those of owned nodes: from each owner's path what lies at this depth and below."""
        below = {f"_{n}": (kind, F.col(c)) for n, (kind, c) in sums.items()}
        df = over_groups(df, ["doc"], ["d"], lambda rows, scan: scan.together(rows, following=below))
        with_own = {n: F.coalesce(F.col(f"_{n}") + F.col(c), f"_{n}", c) if kind == "sum" else F.least(f"_{n}", c) for n, (kind, c) in sums.items()}
        return df.select("node", *[e.alias(n) for n, e in with_own.items()]).groupBy("node").agg(*[{"sum": F.sum, "min": F.min}[kind](n).alias(n) for n, (kind, _) in sums.items()])

    counts = written(up(rows, n_docs=("sum", "n_ends"), n_leaves=("sum", "leaf"), first_doc_id=("min", "least")))
    gains = owned.filter("own").join(counts, "node").select("doc", "d", ((F.col("n_docs") - 1) * F.col("chars")).alias("gain"))
    gains = written(owned.select("doc", "d", "node").join(gains, ["doc", "d"], "left"))
    saved_chars = written(up(gains, saved_chars=("sum", "gain")))

    nodes = owned.filter("own").select("node", "parent", F.col("d").alias("depth")).join(counts, "node").join(saved_chars, "node").join(children, "node", "left")
    above = counts.select(F.col("node").alias("parent"), F.col("first_doc_id").alias("parent_first_doc_id"))
    nodes = nodes.join(above, "parent", "left").select(
        "node", "depth", "parent", "first_doc_id", "parent_first_doc_id", "n_docs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), "n_leaves", "saved_chars"
    )
    return PrefixTrie(nodes, docs.select(F.col("doc.doc_id").alias("doc_id"), F.col("end").alias("node")))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest of the ids of each node, joined by commas, from rows sorted by node and id."""
    current, digest = None, hashlib.sha256()
    kinds = {"node": pa.string(), "ends_sha256": pa.string()}
    for batch in larger(batches):
        nodes, ids = (c.to_pylist() for c in batch.columns)
        out, at = [], 0
        while at < len(nodes):
            stop = at
            while stop < len(nodes) and nodes[stop] == nodes[at]:
                stop += 1
            listed = ",".join(map(str, ids[at:stop])).encode()
            if nodes[at] == current:
                digest.update(b"," + listed)
            else:
                if current is not None:
                    out.append((current, digest.hexdigest()))
                current, digest = nodes[at], hashlib.sha256(listed)
            at = stop
        yield pa.record_batch([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds.values())], list(kinds))
    if current is not None:
        yield pa.record_batch([pa.array([v], k) for v, k in zip((current, digest.hexdigest()), kinds.values(), strict=True)], list(kinds))


def ends_digest(ends: DataFrame) -> DataFrame:
    """``(node, ends_sha256)`` of nodes where documents end: digest of their decimal ids, ascending, comma-joined; null ids are left out.

    The ids of a node are one string and so streamed by one task, never held.
    """
    rows = ends.filter("doc_id IS NOT NULL").select("node", F.col("doc_id").cast("long").alias("doc_id"))
    return rows.repartition(shuffle_parts(ends), "node").sortWithinPartitions("node", "doc_id").mapInArrow(_digests, "node string, ends_sha256 string")
