"""Trie of conversation prefixes as a burst trie.

Equal conversations are merged first. The distinct ones start in one suffix container under the root. A container with more than CONTAINER
turns bursts: its head becomes a node of the trie, and its sequences move on by their next turn id into one container per id. Each round bursts all
oversized containers at once (a grouped aggregation for the sizes and heads, a projection for the moves) and only what burst is looked
at again. What remains is small: every container is sorted by turn ids and swept once into its nodes, in tasks. Counts below a head come up
from its children, level by level, on one row per head or container.

A conversation is one row of turn ids (a 16-byte digest of role and text, and the text's bytes); texts are not shuffled. Sequences under one head
may be any share of the rows: heads are counted by partial aggregation, and no container of more than CONTAINER turns reaches a task, but
for a single distinct sequence, which is a path and needs no bursting.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cleanlake.core import c
from cleanlake.llm.common import BROADCAST_ROWS, arrow_rows, sorted_runs, stored
from cleanlake.operators.skew import skew_join

CONTAINER = 4_096      # turns (and ends) that a container holds before it bursts
ENDS = 4_096           # identifiers that one piece of a list of members holds
NOTHING = hashlib.sha256(b"").hexdigest()
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def sequences(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, turns (array of id, bytes) of every conversation, by turn (null first; rows of one turn by digest). Null role or text is empty."""
    role, text = F.coalesce(c(role_col).cast("string"), F.lit("")), F.coalesce(c(text_col).cast("string"), F.lit(""))
    digest = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)))
    rows = conversations.where(c(id_col).isNotNull()).select(c(id_col).cast("long").alias("conv_id"), F.struct(c(turn_col).alias("turn"), digest.alias("id"),
                                                                                                     F.octet_length(text).cast("long").alias("bytes")).alias("t"))
    turns = F.transform(F.sort_array(F.collect_list("t")), lambda t: F.struct(t["id"].alias("id"), t["bytes"].alias("bytes")))
    return rows.groupBy("conv_id").agg(turns.alias("turns"))


def rebuilt(own: DataFrame, *, family: int = 5, most: int = 9) -> DataFrame:
    """Every conversation c with its first h turns taken from conversation c - c % family; h is crc32(c) % most."""
    own = stored(own, "trie-turns")
    rows = own.withColumn("h", (F.crc32(F.col("conv_id").cast("string")) % most).cast("int")).withColumn("base", F.col("conv_id") - F.col("conv_id") % family)
    first = own.where(F.col("conv_id") % family == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, most - 1).alias("first"))
    size = F.size("turns")
    rest = F.expr("slice(turns, h + 1, greatest(size(turns) - h, 0))")
    return rows.join(first, "base", "left").select("conv_id", F.concat(F.coalesce(F.expr("slice(first, 1, h)"), F.slice("turns", 1, 0)), F.when(size > F.col("h"), rest).otherwise(F.slice("turns", 1, 0))).alias("turns"))


def _pieces(batches):
    """Members of a sequence, sorted: the first one and the text of up to ENDS of them."""
    held, path, out = [], None, []
    for batch in batches:
        for p, i in zip(batch.column("path").to_pylist(), batch.column("conv_id").to_pylist()):
            if held and (p != path or len(held) == ENDS):
                out.append((path, held[0], ",".join(map(str, held))))
                held = []
            path = p
            held.append(i)
        if out:
            yield pa.RecordBatch.from_pylist([dict(zip(("path", "least", "text"), x)) for x in out])
            out = []
    if held:
        yield pa.RecordBatch.from_pylist([{"path": path, "least": held[0], "text": ",".join(map(str, held))}])


def _digests(batches):
    """SHA-256 over the pieces of every sequence, in order."""
    path, digest, out = None, None, []
    for batch in batches:
        for p, text in zip(batch.column("path").to_pylist(), batch.column("text").to_pylist()):
            if p == path:
                digest.update(b",")
            else:
                if path is not None:
                    out.append({"path": path, "ends": digest.hexdigest()})
                path, digest = p, hashlib.sha256()
            digest.update(text.encode())
        if out:
            yield pa.RecordBatch.from_pylist(out)
            out = []
    if path is not None:
        yield pa.RecordBatch.from_pylist([{"path": path, "ends": digest.hexdigest()}])


def distinct(rows: DataFrame) -> DataFrame:
    """Equal sequences merged: ids, bytes, conv (the smallest member), n (members), ends (SHA-256 of all members' identifiers).

    Members of a large group meet as pieces of ENDS identifiers, written in parallel by ranges of identifiers; one task then hashes the
    pieces of a group one after the other, since a digest is sequential, and holds one piece at a time.
    """
    rows = stored(rows.select("conv_id", F.col("turns.id").alias("ids"), F.col("turns.bytes").alias("bytes"))
                  .withColumn("path", F.unhex(F.md5(F.array_join(F.transform("ids", F.hex), "")))), "trie-rows")
    merged = rows.groupBy("path").agg(F.min("conv_id").alias("conv"), F.count(F.lit(1)).alias("n"), F.any_value("ids").alias("ids"), F.any_value("bytes").alias("bytes"))
    merged = stored(merged, "trie-merged")
    many = merged.where("n > 1").select("path")
    members = skew_join(rows.select("path", "conv_id"), many, ["path"], "left_semi", counts=merged.where("n > 1").select("path", "n"), count_col="n")
    schema = "path binary, least long, text string"
    parts = members.repartitionByRange("conv_id").sortWithinPartitions("path", "conv_id").mapInArrow(_pieces, schema)
    ends = parts.repartition("path").sortWithinPartitions("path", "least").mapInArrow(_digests, "path binary, ends string")
    one = F.sha2(F.col("conv").cast("string"), 256)
    return merged.join(ends, "path", "left").select("ids", "bytes", "conv", "n", F.coalesce("ends", one).alias("ends"))


def _found(rows: DataFrame, small: DataFrame, key: str) -> DataFrame:
    """Left join with a table of one row per key: broadcast when a count proves it small, else by a salted shuffle."""
    if small.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(small), key, "left")
    return skew_join(rows, small, [key], "left", right_unique=True)


def burst(rows: DataFrame, container: int = CONTAINER) -> tuple[DataFrame, list[DataFrame]]:
    """(sequences in containers that need no more bursting, heads by depth). Rounds go on until no container is oversized."""
    rows = rows.select("*", F.lit(0).alias("depth"), F.lit(b"").alias("head"), F.lit(None).cast("binary").alias("parent"))
    resting, heads = None, []
    while True:
        size = rows.groupBy("head").agg(F.sum(F.size("ids") - F.col("depth") + 1).alias("size"), F.count(F.lit(1)).alias("seqs"))
        big = stored(size.where((F.col("size") > container) & (F.col("seqs") > 1)).select("head", F.lit(True).alias("big")), "trie-oversized")
        if big.isEmpty():
            return (rows if resting is None else resting.unionByName(rows)), heads
        rows = stored(_found(rows, big, "head"), "trie-round")
        calm = rows.where("big is null").drop("big")
        resting = calm if resting is None else resting.unionByName(calm)
        rows = rows.where("big").drop("big")
        ended = F.size("ids") == F.col("depth")
        heads.append(stored(rows.groupBy("head").agg(
            F.any_value("parent").alias("parent"), F.any_value("depth").cast("long").alias("depth"), F.min("conv").alias("conv_id"), F.sum("n").alias("n_convs"),
            F.any_value(F.when(F.col("depth") > 0, F.expr("element_at(bytes, depth)")).otherwise(0)).alias("bytes"),
            F.coalesce(F.max(F.when(ended, F.col("ends"))), F.lit(NOTHING)).alias("ends_sha256")), "trie-heads"))
        child = F.unhex(F.md5(F.concat("head", F.expr("element_at(ids, depth + 1)"))))
        rows = rows.where(~ended).select("ids", "bytes", "conv", "n", "ends", (F.col("depth") + 1).alias("depth"), child.alias("head"), F.col("head").alias("parent"))


def sweep(depth: int, rows: list[tuple]) -> list[list]:
    """Nodes of a container whose head lies at `depth`, the head first: [conv, depth, parent's place, n, children, leaves, saved, ends, bytes].

    rows are (ids, bytes, conv, n, ends), sorted by ids. Each one shares with the row before it the nodes of their common prefix and opens
    nodes for the rest; the counts then go up from the last node to the first.
    """
    nodes = [[None, depth, None, 0, 0, 0, 0, NOTHING, rows[0][1][depth - 1] if depth else 0]]
    stack, before = [0], rows[0][0][:depth]
    for ids, sizes, conv, n, ends in rows:
        same, most = depth, min(len(before), len(ids))
        while same < most and before[same] == ids[same]:
            same += 1
        del stack[same - depth + 1:]
        for d in range(same, len(ids)):
            nodes.append([None, d + 1, stack[-1], 0, 0, 0, 0, NOTHING, sizes[d]])
            stack.append(len(nodes) - 1)
        last = nodes[stack[-1]]
        last[0], last[3], last[7] = conv, n, ends
        before = ids
    for node in reversed(nodes):
        node[5] = node[5] or 1
        node[6] += (node[3] - 1) * node[8]
        if node[2] is not None:
            up = nodes[node[2]]
            up[0] = node[0] if up[0] is None else min(up[0], node[0])
            up[3] += node[3]
            up[4] += 1
            up[5] += node[5]
            up[6] += node[6]
    return nodes


def _swept(batches):
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "parent", "top"]
    types = [pa.int64()] * 7 + [pa.string(), pa.binary(), pa.bool_()]
    for t in sorted_runs(batches, "head", 10_000):
        head, depth, parent = (t.column(k).to_pylist() for k in ("head", "depth", "parent"))
        rows = list(zip(*(t.column(k).to_pylist() for k in ("ids", "bytes", "conv", "n", "ends"))))
        out, a = [], 0
        while a < len(rows):
            b = a
            while b < len(rows) and head[b] == head[a]:
                b += 1
            nodes = sweep(depth[a], rows[a:b])
            for i, x in enumerate(nodes):
                out.append((x[0], x[1], nodes[x[2]][0] if i else None, *x[3:8], None if i else parent[a], not i))
            a = b
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, y) for x, y in zip(zip(*out), types)], names=names)


def nodes(rows: DataFrame, container: int = CONTAINER) -> DataFrame:
    """One row per node of the trie of conv_id, turns (array of id, bytes): the columns of NODE.

    conv_id is the smallest member of a node and parent_conv_id its parent's (root: null); saved_tokens sums (n_convs - 1) * bytes of the last
    turn over the subtree; ends_sha256 is over the members that end at the node. The root stands for the empty prefix, and turnless
    conversations end there. No rows give no rows. Identifiers are taken to be distinct and not null.
    """
    spark = rows.sparkSession
    resting, heads = burst(stored(distinct(rows), "trie-distinct"), container)
    with arrow_rows(spark, 2_000):
        swept = resting.repartition("head").sortWithinPartitions("head", "ids").mapInArrow(_swept, f"{NODE}, parent binary, top boolean")
        swept = stored(swept, "trie-swept")
    own = [x.strip().split()[0] for x in NODE.split(",")]
    tops, deeper = swept.where("top").select("parent", "depth", "n_leaves", "saved_tokens"), None
    done = []
    for level in reversed(heads):
        # Containers below this level's heads rest at its depth + 1; heads there have their sums already.
        below = tops if deeper is None else tops.unionByName(deeper.select("parent", "depth", "n_leaves", "saved_tokens"))
        below = below.groupBy("parent", "depth").agg(F.count(F.lit(1)).alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("below"))
        level = level.join(below.select(F.col("parent").alias("head"), "n_children", "n_leaves", "below"), "head")
        deeper = stored(level.select("head", "parent", "conv_id", "depth", "n_convs", "n_children", "n_leaves", "ends_sha256",
                                     (F.col("below") + (F.col("n_convs") - 1) * F.col("bytes")).alias("saved_tokens")), "trie-level")
        done.append(deeper)
    inner = swept.where("not top").select(*own)
    upper = swept.where("top").drop("parent_conv_id", "top")
    if not done:
        return inner.unionByName(upper.withColumn("parent_conv_id", F.lit(None).cast("long")).select(*own))
    every = done[0]
    for level in done[1:]:
        every = every.unionByName(level)
    upper = upper.unionByName(every.drop("head"))
    parents = stored(every.select(F.col("head").alias("parent"), F.col("conv_id").alias("parent_conv_id")), "trie-parents")
    return inner.unionByName(_found(upper, parents, "parent").select(*own))


def prefixes(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", *, container: int = CONTAINER) -> DataFrame:
    """Nodes of the trie of all rebuilt conversations. Rows without conversation are left out; other columns are ignored, whatever their names.

    Repeated rows are turns of their own; rows of one turn number go by the digest of role and text. Very long texts count by their bytes.
    """
    return nodes(rebuilt(sequences(conversations, id_col, turn_col, role_col, text_col)), container)
