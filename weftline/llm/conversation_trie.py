"""Prefix trie of conversations: minimal-perfect-hash node tables in shards.

Every conversation is rebuilt (its base's first turns, then its own), and every
distinct sequence of first turns (role, text) is a node. A node is known by its
prefix digest: two 64-bit numbers, each the exclusive or of hashes of (turn,
position), so that digests of prefixes are running sums that can be taken in
chunks.

1. Distinct digests are counted; their number of members, smallest member and
   parent's digest make the node table.
2. Nodes of more members than a limit are *heavy*; the limit follows the rows so
   that there are at most ``HEAVY`` of them. All other nodes lie in light subtrees,
   below their first light ancestor, of at most that many conversations. Light
   subtrees are the shards, dealt out by their top's digest.
3. A shard's digests get slots of a minimal perfect hash (levels of bit arrays;
   a slot keeps its digest, so a foreign digest is told apart). Counts are scattered
   into flat arrays over the slots, and leaves and saved tokens are accumulated
   through the array of parent slots, deepest nodes first.
4. What the tops of shards have summed up goes to their parents: long
   conversations are worked off in bands of ``BAND`` depths, deepest first, and the
   heavy nodes last, in one table of at most ``HEAVY`` slots.

Defined results: turns are ordered by (turn, role, text), null turns first; null
role or text is the empty text; repeated rows are repeated turns; rows with a null
conv_id are one conversation with a null id, which has no base, precedes all
others and is written as the empty string among members (the id -2**63 counts as
null); c - c % 20 goes towards zero for negative ids; an empty table gives no node,
not even a root; texts are whole; further columns are ignored.

Scale: turns are ranked and digested in chunks of ``CHUNK`` turn numbers (one of
equal or null numbers is unsplit), so a conversation of any length is dealt out; no
text leaves the first step. Members that end at a node are joined to strings by
ranges of ids before they meet; the digest of their list is read by one task as a
stream, which SHA-256 can't do otherwise.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.llm.common import Scratch, materialize, table

#: A conversation's base is the last multiple of ``FAMILY``; it takes crc32(id) % ``HEADS`` turns from there.
FAMILY, HEADS = 20, 4
CHUNK = 256
BAND = 1024
#: Most heavy nodes; and least members of one, where the table is small.
HEAVY, LEAST_HEAVY = 1 << 18, 256
#: Nodes of a hash table, but for a shard that is larger by itself.
BLOCK = 1 << 16
LEAST_ID = -(2**63)
WORD = r"[^\x20\x09-\x0D]+"
NODE = ["depth", "a", "b"]
SUMS = "depth int, a long, b long, pa long, pb long, conv long, n_convs long, n_children long, n_leaves long, saved_tokens long, parent long, top boolean"

_ODD = np.uint64(0x9E3779B97F4A7C15)
_MORE = np.uint64(0xC2B2AE3D27D4EB4F)


class PerfectSlots:
    """Slots 0 to n-1 for n distinct digests, and for no other.

    At each level a digest points at a bit of an array somewhat larger than the
    digests left; those alone at theirs get the next slots in order of bits, the
    others go on to the next level.
    """

    def __init__(self, a: np.ndarray, b: np.ndarray):
        a, b = a.view(np.uint64), b.view(np.uint64)
        self.levels: list[np.ndarray] = []
        own = np.zeros(len(a), np.int64)
        left, used = np.arange(len(a)), 0
        while len(left):
            at = self._place(a[left], b[left], len(self.levels), len(left) + len(left) // 2 + 1)
            alone = np.bincount(at)[at] == 1
            slots = np.full(len(left) + len(left) // 2 + 1, -1)
            slots[at[alone]] = 0
            taken = slots == 0
            slots[taken] = used + np.arange(taken.sum())
            own[left[alone]] = slots[at[alone]]
            self.levels.append(slots)
            used += int(taken.sum())
            left = left[~alone]
        self.a, self.b = np.zeros_like(a), np.zeros_like(b)
        self.a[own], self.b[own] = a, b
        self.own = own

    @staticmethod
    def _place(a: np.ndarray, b: np.ndarray, level: int, size: int) -> np.ndarray:
        x = (a ^ np.uint64(level + 1)) * _ODD
        x = (x ^ (x >> np.uint64(32)) ^ b) * _MORE
        x ^= x >> np.uint64(29)
        return (x % np.uint64(size)).astype(np.int64)

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The slot of each digest, -1 for those that aren't in the table."""
        a, b = a.view(np.uint64), b.view(np.uint64)
        out, left = np.full(len(a), -1), np.arange(len(a))
        for level, slots in enumerate(self.levels):
            got = slots[self._place(a[left], b[left], level, len(slots))]
            out[left] = got
            left = left[got < 0]
        known = out >= 0
        known[known] = (self.a[out[known]] == a[known]) & (self.b[out[known]] == b[known])
        return np.where(known, out, -1)


def accumulated(nodes: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Children, leaves and saved tokens of the nodes of one table, sums of other tables below them included."""
    table = PerfectSlots(nodes["a"], nodes["b"])
    own, n = table.own, len(table.own)
    above = np.where(nodes["depth"] > 0, table.find(nodes["pa"], nodes["pb"]), -1)
    parent, depth, conv, children, leaves, saved = (np.zeros(n, np.int64) for _ in range(6))
    parent[own], depth[own], conv[own], children[own] = above, nodes["depth"], nodes["conv"], nodes["children"]
    np.add.at(children, above[above >= 0], 1)
    leaves[own] = nodes["leaves"]
    leaves += children == 0
    saved[own] = (nodes["n_convs"] - 1) * nodes["words"] + nodes["saved"]
    order = np.argsort(-depth, kind="stable")
    for layer in np.split(order, np.flatnonzero(np.diff(depth[order])) + 1):
        layer = layer[parent[layer] >= 0]
        np.add.at(leaves, parent[layer], leaves[layer])
        np.add.at(saved, parent[layer], saved[layer])
    return {"children": children[own], "leaves": leaves[own], "saved": saved[own], "parent": conv[above], "top": above < 0}


def _tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes in order of their shards -> ``SUMS``, in blocks of whole shards."""

    def done(t: pa.Table) -> pa.RecordBatch:
        nodes = {name: t[name].to_numpy() for name in t.column_names}
        got = accumulated(nodes)
        plain = [pa.array(nodes[n]) for n in ("depth", "a", "b", "pa", "pb", "conv", "n_convs")]
        parent = pa.array(got["parent"], mask=got["top"])
        return pa.RecordBatch.from_arrays([*plain, *(pa.array(got[n]) for n in ("children", "leaves", "saved")), parent, pa.array(got["top"])], names=[x.split()[0] for x in SUMS.split(", ")])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= BLOCK:
            t = pa.Table.from_batches(held)
            tops = np.stack([t["ta"].to_numpy(), t["tb"].to_numpy()])
            changes = np.flatnonzero((tops[:, 1:] != tops[:, :-1]).any(axis=0))
            if len(changes):
                cut = int(changes[-1]) + 1
                yield done(t.slice(0, cut))
                held = t.slice(cut).combine_chunks().to_batches()
    if held and sum(b.num_rows for b in held):
        yield done(pa.Table.from_batches(held))


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lists of members in order of (node, part) -> each node's digest of all of them."""
    node, digest = None, None

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([node[0]], pa.int32()), pa.array([node[1]]), pa.array([node[2]]), pa.array([digest.hexdigest()])], names=[*NODE, "ends"])

    out: list[pa.RecordBatch] = []
    for batch in batches:
        for *key, members in zip(*(c.to_pylist() for c in batch.columns)):
            if key != node:
                if node is not None:
                    out.append(row())
                node, digest = key, hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(members.encode())
        if out:
            yield pa.Table.from_batches(out).combine_chunks().to_batches()[0]
            out = []
    if node is not None:
        yield row()


def rebuilt_turns(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, turn, role, text) -> rebuilt turns (c, position, t1, t2, words) and conversations (c, turns)."""
    role, text = (F.coalesce(F.col(n).cast("string"), F.lit("")) for n in ("role", "text"))
    turn, c = F.col("turn").cast("long"), F.coalesce(F.col("conv_id").cast("long"), F.lit(LEAST_ID))
    rows = rows.select(c.alias("c"), F.coalesce(F.floor(turn / CHUNK), F.lit(LEAST_ID)).alias("chunk"), turn.alias("turn"), role.alias("role"), text.alias("text"))
    within = F.row_number().over(Window.partitionBy("c", "chunk").orderBy(F.asc_nulls_first("turn"), "role", "text"))
    hashed = [F.xxhash64(F.lit(i), "role", "text").alias(f"t{i}") for i in (1, 2)]
    turns = rows.select("c", "chunk", within.alias("within"), *hashed, F.regexp_count("text", F.lit(WORD)).cast("long").alias("words"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("c").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    chunks = rows.groupBy("c", "chunk").agg(F.count(F.lit(1)).alias("n")).withColumn("before", before)
    decimal = F.when(F.col("c") == LEAST_ID, F.lit("")).otherwise(F.col("c").cast("string"))
    convs = chunks.groupBy("c").agg(F.sum("n").alias("own")).select("c", "own", F.pmod(F.crc32(decimal.cast("binary")), F.lit(HEADS)).cast("int").alias("h"), (F.col("c") - F.col("c") % FAMILY).alias("base"))

    ranked = turns.join(chunks, ["c", "chunk"]).withColumn("rank", (F.col("before") + F.col("within") - 1).cast("int"))
    first = ranked.where((F.col("rank") < HEADS - 1) & (F.col("c") % FAMILY == 0))
    heads = first.groupBy(F.col("c").alias("base")).agg(F.array_sort(F.collect_list(F.struct("rank", "t1", "t2", "words"))).alias("head"))
    info = convs.join(heads, "base", "left").select("c", "own", "h", F.coalesce(F.slice("head", F.lit(1), F.col("h")), F.array()).alias("head"))
    info = info.withColumn("shift", F.size("head") - F.col("h")).withColumn("turns", (F.greatest(F.col("own"), F.col("h")) + F.col("shift")).cast("int"))

    placed = chunks.join(info.select("c", "h", "shift"), "c")
    own = turns.join(placed, ["c", "chunk"]).withColumn("rank", (F.col("before") + F.col("within") - 1).cast("int")).where("rank >= h")
    own = own.select("c", (F.col("rank") + F.col("shift")).alias("position"), "t1", "t2", "words")
    taken = info.select("c", F.explode("head").alias("t")).select("c", F.col("t.rank").alias("position"), "t.t1", "t.t2", "t.words")
    return own.unionByName(taken), info.select("c", "turns")


def paths(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """(c, depth, a, b, pa, pb, words, ends): the node at each depth of each conversation."""
    terms = [F.xxhash64(f"t{i}", "position").alias(f"x{i}") for i in (1, 2)]
    turns = turns.select("c", "position", F.floor(F.col("position") / CHUNK).alias("chunk"), *terms, "words")
    inside = Window.partitionBy("c", "chunk").orderBy("position")
    earlier = Window.partitionBy("c").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    sums = turns.groupBy("c", "chunk").agg(F.bit_xor("x1").alias("s1"), F.bit_xor("x2").alias("s2"))
    sums = sums.select("c", "chunk", *[F.coalesce(F.bit_xor(f"s{i}").over(earlier), F.lit(0)).alias(f"s{i}") for i in (1, 2)])
    turns = turns.select("*", *[F.bit_xor(f"x{i}").over(inside).alias(f"r{i}") for i in (1, 2)])
    a, b = (F.col(f"r{i}").bitwiseXOR(F.col(f"s{i}")) for i in (1, 2))
    at = turns.join(sums, ["c", "chunk"]).select("c", (F.col("position") + 1).alias("depth"), a.alias("a"), b.alias("b"), a.bitwiseXOR(F.col("x1")).alias("pa"), b.bitwiseXOR(F.col("x2")).alias("pb"), "words")
    zero = F.lit(0).cast("long")
    root = convs.select("c", F.lit(0).alias("depth"), *[zero.alias(n) for n in ("a", "b", "pa", "pb", "words")])
    return at.unionByName(root).join(convs, "c").withColumn("ends", F.col("depth") == F.col("turns")).drop("turns")


def _carried(sums: DataFrame) -> DataFrame:
    """What the tops of other tables add to their parents."""
    tops = sums.where("top and depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("pa").alias("a"), F.col("pb").alias("b"))
    return tops.agg(F.count(F.lit(1)).alias("children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))


def conversation_trie(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """One row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, and its digest (a, b)."""
    with Scratch(spark) as scratch:
        turns, convs = rebuilt_turns(rows)
        path = scratch.keep(paths(turns, convs), "paths")
        nodes = path.groupBy(*NODE).agg(
            F.count(F.lit(1)).alias("n_convs"), F.min("c").alias("conv"), F.min("pa").alias("pa"), F.min("pb").alias("pb"), F.max("words").alias("words"), F.count_if("ends").alias("n_ends")
        )
        nodes = scratch.keep(nodes, "nodes")
        size = nodes.agg(F.sum("n_convs").alias("rows"), F.max("depth").alias("depth")).first()
        limit = max(LEAST_HEAVY, -(-(size["rows"] or 0) // HEAVY))
        heavy = nodes.where(F.col("n_convs") > limit)  # at most HEAVY rows
        tops = path.join(F.broadcast(heavy.select(*NODE)), NODE, "left_anti").groupBy("c").agg(F.min_by(F.struct("a", "b"), "depth").alias("t"))
        light = nodes.where(F.col("n_convs") <= limit).join(tops.withColumnRenamed("c", "conv"), "conv").withColumns({"ta": F.col("t.a"), "tb": F.col("t.b")})

        def summed(part: DataFrame, below: DataFrame | None, name: str) -> DataFrame:
            zeros = {n: F.lit(0).cast("long") for n in ("children", "leaves", "saved")}
            part = part.withColumns(zeros) if below is None else part.join(below, NODE, "left").fillna(0, list(zeros))
            part = part.select(*NODE, "pa", "pb", "conv", "n_convs", "words", *zeros, "ta", "tb")
            return scratch.keep(part.mapInArrow(_tables, SUMS) if name == "heavy" else part.repartition("ta", "tb").sortWithinPartitions("ta", "tb").mapInArrow(_tables, SUMS), name)

        done, band = [], None
        for i in range((size["depth"] or 0) // BAND, -1, -1):
            part = light.where((F.col("depth") >= i * BAND) & (F.col("depth") < (i + 1) * BAND))
            band = summed(part, _carried(done[-1]) if done else None, f"band-{i}")
            done.append(band)
        sums = done[0]
        for x in done[1:]:
            sums = sums.unionByName(x)
        # tops below heavy nodes lie in any band
        below = _carried(sums).join(F.broadcast(heavy.select(*NODE)), NODE, "left_semi")
        one = F.lit(0).cast("long")
        crown = summed(heavy.withColumns({"ta": one, "tb": one}).coalesce(1), F.broadcast(below), "heavy")
        parents = heavy.unionByName(nodes.where((F.col("n_convs") <= limit) & (F.col("depth") % BAND == BAND - 1) & (F.col("n_ends") < F.col("n_convs"))))
        parents = parents.select((F.col("depth") + 1).alias("depth"), F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv").alias("above"))
        known = F.broadcast(parents) if (size["depth"] or 0) < BAND else parents
        sums = sums.unionByName(crown)
        tops = sums.where("top").join(known, ["depth", "pa", "pb"], "left").withColumn("parent", F.coalesce("parent", "above")).select(*sums.columns)
        sums = sums.where("not top").unionByName(tops)

        decimal = F.transform(F.array_sort(F.collect_list("c")), lambda c: F.when(c == LEAST_ID, F.lit("")).otherwise(c.cast("string")))
        lists = path.where("ends").repartitionByRange("c").withColumn("part", F.spark_partition_id()).groupBy(*NODE, "part").agg(F.array_join(decimal, ",").alias("members"))
        ends = lists.repartition(*NODE).sortWithinPartitions(*NODE, "part").select(*NODE, "members").mapInArrow(_ends, "depth int, a long, b long, ends string")
        out = sums.join(ends, NODE, "left").select(
            F.nullif("conv", F.lit(LEAST_ID)).alias("conv_id"), F.col("depth").cast("long").alias("depth"), F.nullif("parent", F.lit(LEAST_ID)).alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
            F.coalesce("ends", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"), "a", "b",
        )
        return materialize(spark, out, "conversation-trie")


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(spark, table(spark, sf_dir, "conversations")).drop("a", "b")
