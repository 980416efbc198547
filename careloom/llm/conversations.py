"""Prefix trie of conversations (operator 13).

Method: a turn's id is the 128-bit digest of its role and text, big-endian, so that a conversation is a
string of fixed-width ids. Distinct strings are range-partitioned and entered into adaptive
radix trees of bounded size; only byte depths that end a turn emit nodes.

A node that lies inside one tree is final there: nothing but its row leaves the task. Nodes on the
path of a tree's first or last string may continue in other trees. These few *open* nodes are
emitted in part and merged by Spark: a node is named by the XOR of the digests of (place, turn id)
along its path. Sums over subtrees then need no rounds: every open node is owned by one of the paths
through it, and a path adds what it owns from some depth on to its node at that depth.

A string holds at most ``SEGMENT`` turns. Later turns of a longer conversation stay rows from end
to end, as open nodes, so that no task ever holds a conversation of unbounded length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, LongType, StringType, StructField, StructType
from pyspark.sql.window import Window

from careloom.llm.radix import RadixTree
from careloom.llm.text import mixed
from careloom.operators.ordering import with_position, with_running_total
from careloom.session import cut_lineage

#: Bytes of a turn id, and turns of a string at most.
WIDTH = 16
SEGMENT = 1024
#: Bytes of the strings of one tree, of a batch's text of ids, and places of a bucket of a long conversation.
TREE_BYTES = 1 << 20
CHUNK_BYTES = 64 << 10
BUCKET = 4096
#: Digest of a node at which no conversation ends.
NO_ENDS = hashlib.sha256(b"").hexdigest()

NODE = StructType([
    StructField("open", BooleanType()), StructField("hi", LongType()), StructField("lo", LongType()),
    StructField("parent_hi", LongType()), StructField("parent_lo", LongType()),
    StructField("conv_id", LongType()), StructField("depth", LongType()), StructField("parent_conv_id", LongType()),
    StructField("n_convs", LongType()), StructField("n_children", LongType()), StructField("n_leaves", LongType()),
    StructField("saved_tokens", LongType()), StructField("words", LongType()), StructField("ends_sha256", StringType()),
    StructField("paths", ArrayType(LongType())),
])
NODE_ARROW = pa.schema([
    ("open", pa.bool_()), *((n, pa.int64()) for n in ("hi", "lo", "parent_hi", "parent_lo", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "words")),
    ("ends_sha256", pa.string()), ("paths", pa.list_(pa.int64())),
])


# --- strings of turns -----------------------------------------------------------------------


def turn_rows(conversations: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv_id, turn, id, words): from here on no text is moved."""
    said_by, said = F.coalesce(F.col(role).cast("string"), F.lit("")), F.coalesce(F.col(text).cast("string"), F.lit(""))
    return conversations.filter(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("conv_id"), F.col(turn).alias("turn"),
        F.md5(F.concat(F.length(said_by).cast("string"), F.lit(":"), said_by, said)).alias("id"),
        F.regexp_count(said, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"),
    )


def share(conv: Column) -> Column:
    """How many first turns a conversation takes from the one its block of 20 begins with."""
    return F.crc32(conv.cast("string")) % 4


def strings(turns: DataFrame, every: int | None, segment: int) -> tuple[DataFrame, DataFrame]:
    """(conv_id, key, words, goes_on) of every conversation, and the later turns of long ones.

    With ``every`` a conversation's first turns are those of the first conversation of its block.
    """
    numbered = with_position(turns, ["conv_id"], [F.col("turn"), F.col("id")], None, "place")
    numbered = cut_lineage(numbered.select("conv_id", "place", "id", "words"))
    early = F.when(F.col("place") <= segment + 3, F.struct("place", "id", "words"))
    convs = cut_lineage(numbered.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(early)).alias("own")))
    h = share(F.col("conv_id")) if every else F.lit(0).cast("long")
    if every:
        heads = convs.select(F.col("conv_id").alias("block"), F.slice("own", 1, 3).alias("head"))
        block = F.try_subtract(F.col("conv_id"), F.col("conv_id") % every)
        convs = convs.withColumn("block", block).join(heads, "block", "left")
        convs = convs.withColumn("head", F.slice(F.coalesce("head", F.slice("own", 1, 0)), F.lit(1), h.cast("int")))
    else:
        convs = convs.withColumn("head", F.slice("own", 1, 0))
    built = F.slice(F.concat("head", F.filter("own", lambda x: x["place"] > h)), 1, segment)
    total = F.size("head") + F.greatest(F.col("n") - h, F.lit(0))
    keys = cut_lineage(convs.select(
        "conv_id", F.unhex(F.array_join(F.transform(built, lambda x: x["id"]), "")).alias("key"),
        F.transform(built, lambda x: x["words"]).alias("words"), (total > segment).alias("goes_on"),
        F.size("head").cast("long").alias("taken"),
    ))
    late = numbered.filter(F.col("place") > segment).join(keys.filter("goes_on").select("conv_id", "taken"), "conv_id")
    late = late.select("conv_id", (F.col("place") - h + F.col("taken")).alias("depth"), "id", "words").filter(F.col("depth") > segment)
    return keys.drop("taken"), late


def place_digests(place: np.ndarray, hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of every (place, turn id); the XOR along a path names the node at its end."""
    with np.errstate(over="ignore"):
        at = mixed(place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        return mixed(hi ^ at) + mixed(lo), mixed(lo + at) ^ mixed(hi + np.uint64(0xC2B2AE3D27D4EB4F))


def halves(key: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(key, ">u8").astype(np.uint64)
    return both[0::2], both[1::2]


# --- conversations that end at a node -------------------------------------------------------


@dataclass
class Group:
    """One key's conversations so far: their number, the smallest, and the digest of their ids."""

    key: tuple
    carried: list | None = None
    n: int = 0
    least: int = 0
    sha: hashlib._Hash = field(default_factory=hashlib.sha256)

    def add(self, first: int, n: int, ids: bytes) -> None:
        self.sha.update(b"," + ids if self.n else ids)
        self.least = first if not self.n else self.least
        self.n += n


def in_chunks(rows: DataFrame, by: list[str], carried: str | None) -> DataFrame:
    """(by, carried, first, n, ids): ids of a key in ascending order, as text of bounded size.

    A hot key is range-partitioned by its ids; what is left of it is a few chunks.
    """
    listed = [*by, *([carried] if carried else [])]
    ranged = rows.select(*listed, "conv_id").repartitionByRange(*by, "conv_id").sortWithinPartitions(*by, "conv_id")
    schema = StructType([*(ranged.schema[c] for c in listed), StructField("first", LongType()), StructField("n", LongType()), StructField("ids", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, out, size = None, [], 0
        types = None
        for batch in batches:
            types = [*(batch.schema.field(c).type for c in listed), pa.int64(), pa.int64(), pa.string()]
            columns = [c.to_pylist() for c in batch.columns]
            for row in zip(*columns, strict=True):
                key, conv = row[: len(by)], row[-1]
                if key != last or size > CHUNK_BYTES:
                    if len(out) >= 4096:
                        yield flushed(out, types)
                        out = []
                    out.append((row[:-1], conv, []))
                    last, size = key, 0
                out[-1][2].append(str(conv))
                size += len(out[-1][2][-1]) + 1
        if out:
            yield flushed(out, types)

    def flushed(out: list, types: list) -> pa.RecordBatch:
        columns = [*zip(*(o[0] for o in out), strict=True), [o[1] for o in out], [len(o[2]) for o in out], [",".join(o[2]) for o in out]]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=schema.names)

    return ranged.mapInArrow(run, schema)


def groups(batches: Iterator[pa.RecordBatch], by: int, carries: bool) -> Iterator[Group]:
    """Keys of chunks that come in order, one after the other."""
    now: Group | None = None
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if now is None or row[:by] != now.key:
                if now is not None:
                    yield now
                now = Group(row[:by], row[by] if carries else None)
            now.add(row[-3], row[-2], row[-1].encode())
    if now is not None:
        yield now


def end_digests(rows: DataFrame) -> DataFrame:
    """(hi, lo, ends_sha256) of (hi, lo, conv_id)."""
    chunks = cut_lineage(in_chunks(rows, ["hi", "lo"], None)).repartitionByRange("hi", "lo").sortWithinPartitions("hi", "lo", "first")
    schema = StructType([StructField("hi", LongType()), StructField("lo", LongType()), StructField("ends_sha256", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups(batches, 2, False):
            yield pa.RecordBatch.from_arrays([pa.array([g.key[0]], pa.int64()), pa.array([g.key[1]], pa.int64()), pa.array([g.sha.hexdigest()])], names=schema.names)

    return chunks.mapInArrow(run, schema)


# --- trees ----------------------------------------------------------------------------------


@dataclass
class Below:
    """What a tree node hands up: sums over closed nodes, and the rows of the next turn depth."""

    n: int = 0
    least: int | None = None
    first: int = 1 << 62
    last: int = -1
    goes_on: bool = False
    leaves: int = 0
    saved: int = 0
    tops: list[int] = field(default_factory=list)

    def add(self, other: Below) -> None:
        self.n += other.n
        if other.least is not None:
            self.least = other.least if self.least is None else min(self.least, other.least)
        self.first, self.last = min(self.first, other.first), max(self.last, other.last)
        self.goes_on |= other.goes_on
        self.leaves += other.leaves
        self.saved += other.saved
        self.tops += other.tops


@dataclass
class Held:
    """A string of a tree: its conversations that end here and those that go on beyond the segment."""

    key: bytes
    words: list[int]
    n: int = 0
    least: int | None = None
    ends: str | None = None
    goes_on: bool = False


def tree_nodes(held: list[Held]) -> pa.RecordBatch:
    """Rows of all turn-aligned nodes of the tree of these strings, which come in order."""
    tree = RadixTree()
    for i, h in enumerate(held):
        tree.insert(h.key, i)
    sizes = np.array([len(h.key) // WIDTH for h in held])
    starts = np.cumsum(sizes) - sizes
    hi, lo = halves(b"".join(h.key for h in held))
    place = np.arange(len(hi)) - np.repeat(starts, sizes) + 1
    names = []
    for x in place_digests(place, hi, lo):
        run = np.concatenate([np.zeros(1, np.uint64), np.bitwise_xor.accumulate(x)])
        names.append(run.view(np.int64))

    def name(i: int, depth: int) -> tuple[int, int]:
        """The node at a depth of a string's path."""
        a, b = starts[i], starts[i] + depth
        return int(names[0][a] ^ names[0][b]), int(names[1][a] ^ names[1][b])

    end = len(held) - 1
    rows: list[list] = []
    parent_of: dict[int, int] = {}

    def emit(depth: int, s: Below, ends: str | None) -> None:
        """A node's row; ``s`` becomes what the node hands up."""
        opened = s.first == 0 or s.last == end or s.goes_on
        h = held[s.first]
        words = h.words[depth - 1] if depth else 0
        closed = [t for t in s.tops if not rows[t][0]]
        for t in s.tops:
            parent_of[t] = len(rows)
        leaves, saved = s.leaves, s.saved
        if not opened:
            leaves += not s.tops
            saved += (s.n - 1) * words
        paths = [held[i].least for i, on in ((0, s.first == 0), (end, s.last == end)) if on]
        up = name(s.first, depth - 1) if depth else (None, None)
        rows.append([opened, *name(s.first, depth), *up, s.least, depth, None, s.n, len(closed), leaves, saved, words, ends, paths if opened else []])
        s.tops = [len(rows) - 1]
        s.leaves, s.saved = (0, 0) if opened else (leaves, saved)

    stack: list[Below] = []
    for node, start, stop, children in tree.bottom_up():
        s = Below()
        for below in stack[len(stack) - children:]:
            s.add(below)
        del stack[len(stack) - children:]
        ends = None
        if node.value >= 0:
            h = held[node.value]
            s.add(Below(h.n, h.least, node.value, node.value, h.goes_on))
            ends = h.ends
        # turn ends on this edge, the deepest first
        for byte in range(stop // WIDTH * WIDTH, start, -WIDTH):
            emit(byte // WIDTH, s, ends if byte == stop else None)
        stack.append(s)
    for t, p in parent_of.items():
        if not rows[p][0]:
            rows[t][7] = rows[p][5]
    columns = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, NODE_ARROW, strict=True)], schema=NODE_ARROW)


def partition_nodes(batches: Iterator[pa.RecordBatch], tree_bytes: int) -> Iterator[pa.RecordBatch]:
    """Trees of neighbouring strings, one after the other."""
    held: list[Held] = []
    size = 0
    for g in groups(batches, 2, True):
        key, goes_on = g.key
        if not held or held[-1].key != key:
            if size > tree_bytes:
                yield tree_nodes(held)
                held, size = [], 0
            held.append(Held(key, g.carried))
            size += len(key) + 64
        h = held[-1]
        h.n += g.n
        h.least = g.least if h.least is None else min(h.least, g.least)
        h.goes_on |= goes_on
        if not goes_on:
            h.ends = g.sha.hexdigest()
    if held:
        yield tree_nodes(held)


# --- nodes that several trees share ---------------------------------------------------------


def long_paths(keys: DataFrame, late: DataFrame, segment: int) -> tuple[DataFrame, DataFrame]:
    """(path, depth, hi, lo) of every place of long conversations, and the open nodes beyond the segment."""
    step = StructType([StructField("path", LongType()), StructField("depth", LongType()), StructField("hi", LongType()), StructField("lo", LongType())])

    def early(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for conv, key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n = len(key) // WIDTH
                x, y = place_digests(np.arange(1, n + 1), *halves(key))
                hi, lo = (np.concatenate([np.zeros(1, np.uint64), np.bitwise_xor.accumulate(v)]).view(np.int64) for v in (x, y))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n + 1, conv)), pa.array(np.arange(n + 1)), pa.array(hi), pa.array(lo)], names=step.names)

    each = StructType([StructField("path", LongType()), StructField("depth", LongType()), StructField("x", LongType()), StructField("y", LongType()), StructField("words", LongType())])

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hi, lo = halves(bytes.fromhex("".join(batch.column(2).to_pylist())))
            x, y = place_digests(batch.column(1).to_numpy(), hi, lo)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(x.view(np.int64)), pa.array(y.view(np.int64)), batch.column(3)], names=each.names)

    head = cut_lineage(keys.filter("goes_on").select("conv_id", "key").mapInArrow(early, step))
    tail = late.select("conv_id", "depth", "id", "words").mapInArrow(digested, each)
    seed = head.filter(F.col("depth") == segment).select("path", "depth", F.col("hi").alias("x"), F.col("lo").alias("y"), F.lit(None).cast("long").alias("words"))
    run = cut_lineage(running_xor(tail.unionByName(seed)).filter(F.col("depth") > segment))
    nodes = run.select(
        F.lit(True).alias("open"), "hi", "lo", F.col("hi").bitwiseXOR(F.col("x")).alias("parent_hi"), F.col("lo").bitwiseXOR(F.col("y")).alias("parent_lo"),
        F.col("path").alias("conv_id"), "depth", F.lit(1).cast("long").alias("n_convs"), F.lit(0).cast("long").alias("n_children"),
        F.lit(0).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"), "words", F.lit(None).cast("string").alias("ends_sha256"),
    )
    return head.unionByName(run.select("path", "depth", "hi", "lo")), nodes


def running_xor(rows: DataFrame) -> DataFrame:
    """Adds ``hi`` and ``lo``, the XOR of x and of y up to each depth of a path, by buckets of places."""
    cut = cut_lineage(rows.withColumn("bucket", F.expr(f"depth div {BUCKET}")))
    before = Window.partitionBy("path").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = cut.groupBy("path", "bucket").agg(F.bit_xor("x").alias("bx"), F.bit_xor("y").alias("by"))
    sums = sums.select("path", "bucket", F.coalesce(F.bit_xor("bx").over(before), F.lit(0)).alias("bx"), F.coalesce(F.bit_xor("by").over(before), F.lit(0)).alias("by"))
    here = Window.partitionBy("path", "bucket").orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hi, lo = F.bit_xor("x").over(here).bitwiseXOR(F.col("bx")), F.bit_xor("y").over(here).bitwiseXOR(F.col("by"))
    return cut.join(sums, ["path", "bucket"]).withColumn("hi", hi).withColumn("lo", lo).drop("bucket", "bx", "by")


def merged_nodes(parts: DataFrame, paths: DataFrame) -> DataFrame:
    """Open nodes from their parts, with sums over their subtrees."""
    name = ["hi", "lo"]
    nodes = parts.groupBy(*name, "depth").agg(
        F.max("parent_hi").alias("parent_hi"), F.max("parent_lo").alias("parent_lo"), F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"),
        F.sum("n_children").alias("closed"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"), F.max("words").alias("words"), F.max("ends_sha256").alias("ends_sha256"),
    )
    nodes = cut_lineage(nodes)
    under = nodes.filter("depth > 0").groupBy(F.col("parent_hi").alias("hi"), F.col("parent_lo").alias("lo")).agg(F.count(F.lit(1)).alias("opened"))
    counted = nodes.join(under, name, "left").withColumn("n_children", F.col("closed") + F.coalesce("opened", F.lit(0)))
    counted = cut_lineage(counted.withColumn("own_leaves", F.col("leaves") + (F.col("n_children") == 0).cast("long")).withColumn("own_saved", F.col("saved") + (F.col("n_convs") - 1) * F.col("words")))
    paths = cut_lineage(paths.distinct())
    owner = paths.groupBy(*name).agg(F.min("path").alias("owner"))
    on_paths = paths.join(counted.join(owner, name).select(*name, "owner", "own_leaves", "own_saved"), name)
    owned = on_paths.select("path", "depth", *name, *[F.when(F.col("owner") == F.col("path"), F.col(c)).otherwise(0).alias(c) for c in ("own_leaves", "own_saved")])
    sums = with_running_total(owned, ["path"], [F.col("depth").desc()], -F.expr(f"depth div {BUCKET}"), {"to_leaves": "own_leaves", "to_saved": "own_saved"})
    below = sums.groupBy(*name).agg(F.sum("to_leaves").alias("n_leaves"), F.sum("to_saved").alias("saved_tokens"))
    return cut_lineage(counted.join(below, name).select(*name, "parent_hi", "parent_lo", "conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"))


def prefix_trie(
    conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    every: int | None = None, segment: int = SEGMENT, tree_bytes: int = TREE_BYTES,
) -> DataFrame:
    """One row per node of the trie of the conversations' turns.

    ``conv_id``, the smallest member; ``depth``; ``parent_conv_id``, that of the parent (null at the root);
    ``n_convs``, members; ``n_children``; ``n_leaves``, childless nodes below and the node itself;
    ``saved_tokens``, the words that members need not repeat, over the subtree; ``ends_sha256`` of the
    ids of members that end here, joined in ascending order.

    Turns are ordered by ``turn``, null first, equal ones by the digest of role and text; a null role
    or text is an empty one, and repeated rows are turns of their own. Rows without a conversation
    id belong to no conversation. With ``every``, the first 0 to 3 turns of a conversation are replaced by those
    of the conversation whose id is the next multiple of ``every`` towards zero. An empty table
    has no members and no nodes; further columns are ignored.
    """
    keys, late = strings(turn_rows(conversations, conv, turn, role, text), every, segment)
    chunks = cut_lineage(in_chunks(keys, ["key", "goes_on"], "words"))
    ordered = chunks.repartitionByRange("key").sortWithinPartitions("key", "goes_on", "first")
    found = cut_lineage(ordered.mapInArrow(lambda batches: partition_nodes(batches, tree_bytes), NODE))
    paths = found.select(F.explode("paths").alias("path"), "depth", "hi", "lo")
    parts = found.filter("open").drop("parent_conv_id", "paths")
    if not keys.filter("goes_on").isEmpty():
        more, nodes = long_paths(keys, late, segment)
        top = more.groupBy("path").agg(F.max_by(F.struct("hi", "lo"), "depth").alias("end"))
        ends = end_digests(top.select("end.hi", "end.lo", F.col("path").alias("conv_id")))
        paths = paths.unionByName(more)
        parts = parts.unionByName(nodes).join(ends.withColumnRenamed("ends_sha256", "late_ends"), ["hi", "lo"], "left")
        parts = parts.withColumn("ends_sha256", F.coalesce("ends_sha256", "late_ends")).drop("late_ends")
    opened = merged_nodes(parts, paths)
    known = opened.select(F.col("hi").alias("parent_hi"), F.col("lo").alias("parent_lo"), F.col("conv_id").alias("parent"))
    result = ["conv_id", "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256")]
    closed = found.filter("not open")
    inside = closed.filter("parent_conv_id is not null").withColumn("parent", F.col("parent_conv_id")).select(*result)
    hung = closed.filter("parent_conv_id is null").join(known, ["parent_hi", "parent_lo"]).select(*result)
    return inside.unionByName(hung).unionByName(opened.join(known, ["parent_hi", "parent_lo"], "left").select(*result))
