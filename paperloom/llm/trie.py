"""Conversation prefix trie: MSD radix partitioning of turn sequences, multikey quicksort inside small buckets."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

TURNS = "array<struct<code:bigint,size:bigint>>"
PATH = "array<struct<round:int,bucket:bigint>>"
NODE = f"conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ending long, path {PATH}"
ARROW_PATH = pa.list_(pa.struct([("round", pa.int32()), ("bucket", pa.int64())]))
#: Conversation ids joined to one string at a time.
JOINED = 1 << 16


def conversation_trie(conversations: DataFrame, **options) -> DataFrame:
    """The prefix trie of a table ``conv_id, turn, role, text``: ``prefix_trie`` of its ``turn_sequences``."""
    return prefix_trie(turn_sequences(conversations), **options)


def turn_sequences(conversations: DataFrame, id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A row a conversation: ``conv_id long, turns array<struct<code, size>>``.

    Each distinct (role, text) has a code, from a dictionary over all turns: 128-bit hashes
    of the turns are aggregated, so a turn that very many hold is one row a task before the
    shuffle.  ``size`` is the text's length in bytes.  Turns are ordered by number, null
    first; those of equal number by a hash of role and text.  Null roles and texts are empty.
    Rows of a null id take no part, repeated rows are repeated turns.  A conversation's codes
    are one row, 16 bytes a turn.  Other columns are ignored, whatever their names.
    """
    said, spoke = (F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in (text, role))
    rows = conversations.where(F.col(f"`{id}`").isNotNull()).select(
        F.col(f"`{id}`").cast("long").alias("conv_id"), F.col(f"`{turn}`").alias("turn"), F.xxhash64(spoke, said).alias("h1"), F.xxhash64(F.lit("turn"), said, spoke).alias("h2"),
        F.octet_length(said).cast("long").alias("size"),
    )
    words = materialize(rows.groupBy("h1", "h2").agg(F.min("size").alias("size")).withColumn("code", F.monotonically_increasing_id()), "turn-codes", release=True)
    coded = rows.drop("size").join(words, ["h1", "h2"])
    in_order = F.sort_array(F.collect_list(F.struct("turn", "h1", "h2", "code", "size")))
    return coded.groupBy("conv_id").agg(F.transform(in_order, lambda t: F.struct(t.code.alias("code"), t["size"].alias("size"))).alias("turns"))


def prefix_trie(sequences: DataFrame, local_turns: int = 1 << 11) -> DataFrame:
    """A row a node of the trie of ``sequences`` (``conv_id long, turns array<struct<code, size>>``).

    Equal sequences are counted first and go on as one with their number; their ids meet
    again only to be digested.  Then, from the root on, a bucket is the sequences below one
    node.  A bucket of at most ``local_turns`` remaining turns is local.  A larger one emits
    the nodes that all its sequences share, and is split by the turn behind them; a round does
    so for all large buckets, and only their rows move.  Local buckets are dealt to bins of
    about ``local_turns``; in a bin multikey quicksort orders the sequences, and every part of
    equal turns that it makes is a node.  Sums over subtrees are made in the bins, and for
    nodes of large buckets from the sums of the buckets below.

    Null turns are an empty sequence; a conversation without turns is a member of the root
    alone.  Rows of a null id take no part; a repeated id counts as often as it stands there.
    Returns, per node, ``conv_id`` (smallest member), ``depth``, ``parent_conv_id`` (null for
    the root), ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens`` (long) and
    ``ends_sha256`` (of the ids of conversations that end here, ascending, joined by commas).
    An empty table gives an empty table.
    """
    rows = sequences.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.coalesce(F.col("turns").cast(TURNS), F.array().cast(TURNS)).alias("turns"))
    rows = rows.withColumns({"k1": F.xxhash64("turns.code"), "k2": F.xxhash64(F.lit("sequence"), "turns.code")})
    rows = materialize(rows, "sequences", release=True)
    classes = materialize(rows.groupBy("k1", "k2").agg(F.count("*").alias("n"), F.min("conv_id").alias("first")), "sequence-classes", release=True)
    ones = rows.dropDuplicates(["conv_id", "k1", "k2"]).alias("r").join(classes.alias("c"), F.expr("r.conv_id = c.first AND r.k1 = c.k1 AND r.k2 = c.k2"))
    work = ones.select("turns", "n", "first", F.col("first").alias("bucket"), F.lit(0).alias("depth"), F.lit(None).cast("long").alias("parent"), F.array().cast(PATH).alias("path"))
    root = classes.agg(F.min("first")).first()[0]
    work = materialize(work.withColumn("bucket", F.lit(root).cast("long")), "trie-work", release=True)
    nodes = materialize(_nodes(work, local_turns), "trie-nodes", release=True)
    ends = _ends(rows, classes)
    return nodes.join(ends, F.col("ending") == F.col("first"), "left").select(*NODE_COLUMNS, F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))


NODE_COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]


# ------------------------------------------------------------------------- radix partitioning


def _nodes(work: DataFrame, local_turns: int) -> DataFrame:
    local, upper, round = [], [], 0
    while True:
        by_bucket = work.groupBy("bucket").agg(
            F.sum(F.size("turns") - F.col("depth")).alias("turns"), F.count("*").alias("seqs"), F.sum("n").alias("n"), F.min("first").alias("conv"), F.min("turns").alias("low"), F.max("turns").alias("high"),
            F.min("depth").alias("depth"), F.min("parent").alias("parent"), F.min("path").alias("path"),
        )
        differ = F.array_position(F.zip_with("low", "high", lambda a, b: a.eqNullSafe(b)), False)
        large = by_bucket.where((F.col("turns") > local_turns) & (F.col("seqs") > 1)).withColumn("shared", (differ - 1).cast("int"))
        large = materialize(large.select("bucket", "conv", "n", "depth", "shared", "parent", "path", F.slice("low", 1, F.col("shared")).alias("turns")), "large-buckets", release=True)
        if large.isEmpty():
            local.append(work)
            break
        local.append(work.join(large.select("bucket"), "bucket", "left_anti"))
        inside = work.select("turns", "n", "first", "bucket").join(large.select("bucket", "conv", "shared", "path"), "bucket").withColumn("next", F.get("turns", F.col("shared"))["code"])
        children = materialize(inside.groupBy("bucket", "next").agg(F.min("first").alias("child")), "child-buckets", release=True)
        of_node = children.groupBy(F.col("bucket").alias("of")).agg(F.count("next").alias("n_children"), F.max(F.when(F.col("next").isNull(), F.col("child"))).alias("ending"))
        upper.append(materialize(large.join(of_node, F.col("bucket") == F.col("of")).withColumn("round", F.lit(round)).drop("of"), "upper-nodes", release=True))
        on = children.where("next IS NOT NULL").withColumnsRenamed({"bucket": "from", "next": "by"})
        step = F.struct(F.lit(round).alias("round"), F.col("bucket").alias("bucket"))
        moved = inside.join(on, (F.col("bucket") == F.col("from")) & (F.col("next") == F.col("by")))
        work = materialize(
            moved.select("turns", "n", "first", F.col("child").alias("bucket"), (F.col("shared") + 1).alias("depth"), F.col("conv").alias("parent"), F.concat("path", F.array(step)).alias("path")), "trie-work", release=True
        )
        round += 1
    rest = local[0]
    for more in local[1:]:
        rest = rest.unionByName(more)
    bins = max(1, math.ceil((rest.agg(F.sum(F.size("turns") - F.col("depth") + 1)).first()[0] or 0) / local_turns))
    below = rest.withColumn("bin", F.pmod(F.xxhash64("bucket"), F.lit(bins)).cast("int")).groupBy("bin").applyInArrow(_finish, NODE)
    if not upper:
        return below
    below = materialize(below, "local-nodes", release=True)
    high = upper[0]
    for more in upper[1:]:
        high = high.unionByName(more)
    return below.unionByName(_upper_nodes(high, below))


def _upper_nodes(high: DataFrame, below: DataFrame) -> DataFrame:
    """The nodes that the sequences of large buckets share, with the sums of what lies below."""

    def saved(turns: Column) -> Column:
        return F.aggregate(turns, F.lit(0).cast("long"), lambda s, t: s + (F.col("n") - 1) * t["size"])

    whole = saved(F.slice("turns", F.greatest("depth", F.lit(1)), F.greatest(F.lit(0), F.col("shared") - F.greatest("depth", F.lit(1)) + 1)))
    sums = below.where("path IS NOT NULL").select("path", "n_leaves", "saved_tokens").unionByName(high.select("path", F.lit(0).cast("long").alias("n_leaves"), whole.alias("saved_tokens")))
    sums = sums.select(F.explode("path").alias("at"), "n_leaves", "saved_tokens").groupBy("at.round", "at.bucket").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved"))
    chain = high.join(sums, ["round", "bucket"]).withColumn("at", F.explode(F.sequence("depth", "shared")))
    last, top = F.col("at") == F.col("shared"), F.col("at") == F.col("depth")
    first = F.greatest("at", F.lit(1))
    own = saved(F.slice("turns", first, F.greatest(F.lit(0), F.col("shared") - first + 1)))
    return chain.select(
        F.col("conv").alias("conv_id"), F.col("at").cast("long").alias("depth"), F.when(top, F.col("parent")).otherwise(F.col("conv")).alias("parent_conv_id"), F.col("n").alias("n_convs"),
        F.when(last, F.col("n_children")).otherwise(1).cast("long").alias("n_children"), "n_leaves", (F.col("saved") + own).alias("saved_tokens"), F.when(last, F.col("ending")).alias("ending"), F.lit(None).cast(PATH).alias("path"),
    )


# -------------------------------------------------------------------- multikey quicksort in a bin


def _finish(table: pa.Table) -> pa.Table:
    table = table.combine_chunks()
    turns = table["turns"].combine_chunks()
    at = turns.offsets.to_numpy().astype(np.int64)
    codes, sizes = (turns.values.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
    n, first, bucket, depth, parent = (table[c].to_numpy() for c in ("n", "first", "bucket", "depth", "parent"))
    order = np.argsort(bucket, kind="stable")
    found = {name: [] for name in (*NODE_COLUMNS, "ending", "path")}
    for members in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
        top = int(members[0])
        above = None if np.isnan(parent[top]) else table["parent"][top].as_py()
        nodes = trie_nodes(codes, sizes, at[:-1][members], np.diff(at)[members], n[members], first[members], int(depth[top]), above)
        for name, values in zip((*NODE_COLUMNS, "ending"), nodes, strict=True):
            found[name] += values
        found["path"] += [table["path"][top].as_py(), *[None] * (len(nodes[0]) - 1)]
    return pa.table({name: pa.array(values, ARROW_PATH if name == "path" else pa.int64()) for name, values in found.items()})


def trie_nodes(codes: np.ndarray, sizes: np.ndarray, start: np.ndarray, length: np.ndarray, n: np.ndarray, first: np.ndarray, depth: int, parent: int | None) -> tuple[list, ...]:
    """The nodes of distinct sequences that share their first ``depth`` turns, that of depth ``depth`` first.

    Multikey quicksort: the sequences below a node are parted by their next turn into less
    than, equal to and greater than a pivot; the equal ones are a child, whose own are parted
    by the turn behind, the others wait for the next pivot.  A node stands before its children.
    """
    conv, depths, above, convs, children, leaves, saved, ending, up = ([] for _ in range(9))

    def emit(members: np.ndarray, d: int, over: int) -> int:
        one = int(members[0])
        conv.append(int(first[members].min()))
        depths.append(d)
        above.append(conv[over] if over >= 0 else parent)
        convs.append(int(n[members].sum()))
        saved.append((convs[-1] - 1) * int(sizes[start[one] + d - 1]) if d else 0)
        for values, value in ((children, 0), (leaves, 0), (ending, None), (up, over)):
            values.append(value)
        if over >= 0:
            children[over] += 1
        return len(conv) - 1

    everything = np.arange(len(start))
    waiting = [(everything, depth, emit(everything, depth, -1))]
    while waiting:
        members, d, node = waiting.pop()
        if len(members) == 1:  # alone: a chain to the end
            one = int(members[0])
            for d in range(d, int(length[one])):
                node = emit(members, d + 1, node)
            ending[node] = int(first[one])
            continue
        over = length[members] > d
        if not over.all():
            ending[node] = int(first[members[~over]][0])
            members = members[over]
        if not len(members):
            continue
        key = codes[start[members] + d]
        pivot = np.sort(key[[0, len(key) // 2, -1]])[1]
        equal = members[key == pivot]
        waiting += [(part, d, node) for part in (members[key < pivot], members[key > pivot]) if len(part)] + [(equal, d + 1, emit(equal, d + 1, node))]
    for i in range(len(conv) - 1, -1, -1):
        leaves[i] += not children[i]
        if up[i] >= 0:
            leaves[up[i]] += leaves[i]
            saved[up[i]] += saved[i]
    return conv, depths, above, convs, children, leaves, saved, ending


# ------------------------------------------------------------------- ids of equal conversations


def _ends(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """``first, ends_sha256`` of every class of equal sequences.

    Ids of a class are sorted by range over all tasks and joined to strings there, so a class
    of very many is some strings for the task that digests it, one after the other.
    """
    single = classes.where("n = 1").select("first", F.sha2(F.col("first").cast("string"), 256).alias("ends_sha256"))
    ids = rows.select("conv_id", "k1", "k2").join(classes.where("n > 1").select("k1", "k2", "first"), ["k1", "k2"]).select("first", "conv_id")
    sorted_ids = ids.repartitionByRange("first", "conv_id").sortWithinPartitions("first", "conv_id")
    strings = materialize(sorted_ids.mapInArrow(_strings, "first long, low long, ids string"), "end-strings", release=True)
    digests = strings.repartition("first").sortWithinPartitions("first", "low").mapInArrow(_digests, "first long, ends_sha256 string")
    return single.unionByName(digests)


def _strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    of, held = None, []

    def joined() -> pa.RecordBatch:
        return pa.record_batch({"first": pa.array([of], pa.int64()), "low": pa.array(held[:1], pa.int64()), "ids": [",".join(map(str, held))]})

    for batch in batches:
        first, ids = batch["first"].to_numpy(), batch["conv_id"].to_numpy()
        edges = np.flatnonzero(np.diff(first)) + 1
        for a, b in zip([0, *edges], [*edges, len(first)], strict=True):
            if held and (len(held) >= JOINED or of != first[a]):
                yield joined()
                held = []
            of = int(first[a])
            held += ids[a:b].tolist()
    if held:
        yield joined()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    of, digest = None, None
    for batch in batches:
        for first, ids in zip(batch["first"].to_pylist(), batch["ids"].to_pylist(), strict=True):
            if first == of:
                digest.update(b"," + ids.encode())
                continue
            if digest:
                yield pa.record_batch({"first": pa.array([of], pa.int64()), "ends_sha256": [digest.hexdigest()]})
            of, digest = first, hashlib.sha256(ids.encode())
    if digest:
        yield pa.record_batch({"first": pa.array([of], pa.int64()), "ends_sha256": [digest.hexdigest()]})
