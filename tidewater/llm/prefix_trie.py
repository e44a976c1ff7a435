"""Conversation prefix trie by fixed-length block hashing.

A turn is known by two 64-bit hashes of its place, role and text; a sequence by their exclusive or, so digests of
blocks and of prefixes combine in any grouping. Conversations are grouped by the digests of successive blocks of BLOCK
turns first. Where all that pass a block's start go on with one and the same block, its turns are chain nodes and need
no further look; only blocks whose siblings diverge are refined to turn boundaries, and each distinct block once, not
once per conversation.

A node is named by its smallest member and its depth. The nodes that one conversation names form one downward path,
so subtree sums are suffix sums along that path, plus the totals of paths that hang on it, which pointer doubling adds
up in as many rounds as the logarithm of the number of paths above one another.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewater.llm.common import keep, prepare, read
from tidewater.operators.skew import in_segments, running_sum

BLOCK = 4
CHUNK_IDS = 4096
SHARED_TURNS = 9
FAMILY = 5


def turn_digests(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, a, b, size): role and text of every turn as two hashes, and the text's UTF-8 bytes.

    A null role or text is an empty one. Rows of a null conv_id belong to no conversation and are left out.
    """
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.xxhash64(role, text).alias("a"), F.xxhash64(F.lit(7), text, role).alias("b"),
        F.octet_length(text).cast("long").alias("size"))


def in_order(digests: DataFrame) -> DataFrame:
    """Adds `pos`, from 1, by turn with null first; equal turns by their hashes. A conversation of any length is cut
    into ordered segments."""
    order = ["turn", "a", "b"]
    return running_sum(in_segments(digests, ["conv_id"], order), ["conv_id"], order, F.lit(1), "pos") \
        .select("conv_id", "pos", "a", "b", "size")


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations that start like the first of their family of five: (conv_id, pos, a, b, size), and all conv_ids.

    Conversation c gets the first h turns of c - c % 5 and then its own turns after its first h, with
    h = crc32(c) % 9; it may come out without a turn.
    """
    placed = keep(in_order(turn_digests(conversations)), "trie-turns")
    counts = placed.groupBy("conv_id").agg(F.count("*").alias("n"))
    plan = counts.select("conv_id", F.pmod(F.crc32(F.col("conv_id").cast("string")), F.lit(SHARED_TURNS)).alias("h"),
                         (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base"))
    sizes = counts.select(F.col("conv_id").alias("base"), "n")
    plan = keep(plan.join(sizes, "base", "left").withColumn("taken", F.least("h", F.coalesce("n", F.lit(0)))), "trie-plan")
    heads = placed.where(F.col("pos") < SHARED_TURNS).withColumnRenamed("conv_id", "base") \
        .join(plan.select("base", "conv_id", "taken"), "base").where("pos <= taken")
    own = placed.join(plan.select("conv_id", "h", "taken"), "conv_id").where("pos > h")
    turns = heads.select("conv_id", "pos", "a", "b", "size").unionByName(
        own.select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "a", "b", "size"))
    return turns, plan.select("conv_id")


def _running_xor(segmented: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Adds per column the exclusive or of the conversation's earlier blocks (0 in the first)."""
    totals = segmented.groupBy("conv_id", "_seg").agg(*(F.bit_xor(c).alias(f"_{c}") for c in columns))
    earlier = Window.partitionBy("conv_id").orderBy("_seg").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("conv_id", "_seg", *(F.coalesce(F.bit_xor(f"_{c}").over(earlier), F.lit(0)).alias(f"_{c}")
                                                for c in columns))
    local = Window.partitionBy("conv_id", "_seg").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    joined = segmented.join(before, ["conv_id", "_seg"])
    for column, out in columns.items():
        joined = joined.withColumn(out, F.col(f"_{column}").bitwiseXOR(F.coalesce(F.bit_xor(column).over(local), F.lit(0))))
    return joined


def distinct_blocks(turns: DataFrame) -> DataFrame:
    """(k, sa, sb, ea, eb, len, n, conv, items): block k after the prefix (sa, sb), ending in (ea, eb), with how many
    conversations take it, the smallest of them, and its turns."""
    hashed = turns.select("conv_id", F.expr(f"(pos - 1) div {BLOCK}").alias("k"), "pos", "size",
                          F.xxhash64("pos", "a", "b").alias("a"), F.xxhash64("b", "a", "pos").alias("b"))
    # At most BLOCK turns.
    blocks = hashed.groupBy("conv_id", "k").agg(
        F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"), F.count("*").alias("len"),
        F.sort_array(F.collect_list(F.struct("pos", "a", "b", "size"))).alias("items"))
    placed = _running_xor(in_segments(blocks, ["conv_id"], ["k"]), {"a": "sa", "b": "sb"})
    return placed.groupBy("k", "sa", "sb", F.col("sa").bitwiseXOR(F.col("a")).alias("ea"),
                          F.col("sb").bitwiseXOR(F.col("b")).alias("eb"), "len") \
        .agg(F.count("*").alias("n"), F.min("conv_id").alias("conv"), F.first("items").alias("items"))


def _boundaries(blocks: DataFrame) -> DataFrame:
    """One row per turn of each block: (depth, da, db, pa, pb, n, conv, size), with the digests after and before it."""
    def upto(field: str, start: str, index: Column) -> Column:
        return F.aggregate(F.slice("items", F.lit(1), index), F.col(start), lambda acc, x: acc.bitwiseXOR(x[field]))

    each = F.transform("items", lambda x, i: F.struct(
        x["pos"].alias("depth"), upto("a", "sa", i + 1).alias("da"), upto("b", "sb", i + 1).alias("db"),
        upto("a", "sa", i).alias("pa"), upto("b", "sb", i).alias("pb"), x["size"].alias("size")))
    return blocks.select("n", "conv", F.explode(each).alias("t")).select("t.depth", "t.da", "t.db", "t.pa", "t.pb", "n", "conv", "t.size")


def trie_nodes(turns: DataFrame) -> DataFrame:
    """(depth, da, db, pa, pb, n, conv, size) of every node but the root."""
    blocks = keep(distinct_blocks(turns), "trie-blocks")
    only = blocks.groupBy("k", "sa", "sb").agg(
        F.count("*").alias("ways"), F.min(F.struct("ea", "eb", "len", "n", "conv", "items")).alias("x")).where("ways = 1")
    only = keep(only.select("k", "sa", "sb", "x.*"), "trie-chains")
    diverging = blocks.join(only.select("k", "ea", "eb", "len"), ["k", "ea", "eb", "len"], "left_anti")
    refined = _boundaries(diverging).groupBy("depth", "da", "db", "pa", "pb", "size") \
        .agg(F.sum("n").alias("n"), F.min("conv").alias("conv"))
    return _boundaries(only).unionByName(refined)


def ends_digests(ends: DataFrame) -> DataFrame:
    """(depth, da, db, ends_sha256): SHA-256 of the conv_ids that end there, ascending and comma-joined.

    Ids are joined in chunks of bounded size by range-sorted tasks; a node's chunks are then hashed as they stream by,
    so that neither step holds a node's list.
    """
    key = ["depth", "da", "db"]

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, last, ids = [], None, []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[:3] != last or len(ids) >= CHUNK_IDS:
                    if ids:
                        out.append((*last, ids[0], ",".join(map(str, ids))))
                    last, ids = row[:3], []
                ids.append(row[3])
            if ids:
                out.append((*last, ids[0], ",".join(map(str, ids))))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=[*key, "first", "ids"])

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, None
        for batch in batches:
            out = []
            for depth, da, db, _, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if (depth, da, db) == last:
                    state.update(b",")
                else:
                    if last is not None:
                        out.append((*last, state.hexdigest()))
                    last, state = (depth, da, db), hashlib.sha256()
                state.update(ids.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=[*key, "ends_sha256"])
        if last is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (*last, state.hexdigest())], names=[*key, "ends_sha256"])

    width = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = ends.select(*key, "conv_id").repartitionByRange(width, *key, "conv_id").sortWithinPartitions(*key, "conv_id")
    joined = ranged.mapInArrow(chunks, "depth long, da long, db long, first long, ids string")
    return joined.repartition(width, *key).sortWithinPartitions(*key, "first") \
        .mapInArrow(hashes, "depth long, da long, db long, ends_sha256 string")


def path_totals(paths: DataFrame, top: int) -> DataFrame:
    """(conv, leaves, saved) of whole subtrees from (conv, up, leaves, saved), where `up` is the path that conv hangs
    on; it is null only for `top`, on which most paths may hang. Pointer doubling."""
    state = paths
    while True:
        state = keep(state, "trie-paths")
        hung = state.where("up is not null")
        if hung.isEmpty():
            return state.drop("up")
        more = hung.groupBy(F.col("up").alias("conv")).agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
        above = hung.select(F.col("conv").alias("up"), F.col("up").alias("next"))
        # What hangs on the top is done; it is kept out of the join, as it may be nearly everything.
        far = hung.where(F.col("up") != top).join(above, "up").select("conv", F.col("next").alias("up"))
        state = state.drop("up").join(far, "conv", "left").join(more, "conv", "left").select(
            "conv", "up", (F.col("leaves") + F.coalesce("l", F.lit(0))).alias("leaves"),
            (F.col("saved") + F.coalesce("s", F.lit(0))).alias("saved"))


def prefix_trie(turns: DataFrame, ids: DataFrame) -> DataFrame:
    """Every node of the trie over (conv_id, pos, a, b, size), where ids (conv_id) lists all conversations, turnless
    ones included: (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256).

    pos counts 1, 2, ... within a conversation. Conversations of equal turns share all their nodes. Without a
    conversation there is no node, not even a root.
    """
    turns, ids = keep(turns, "trie-turns"), keep(ids, "trie-ids")
    top, members = ids.agg(F.min("conv_id"), F.count("*")).first()
    last = turns.groupBy("conv_id").agg(
        F.count("*").alias("depth"), F.bit_xor(F.xxhash64("pos", "a", "b")).alias("da"), F.bit_xor(F.xxhash64("b", "a", "pos")).alias("db"))
    ends = keep(ids.join(last, "conv_id", "left").select("conv_id", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("depth", "da", "db"))),
                "trie-ends")
    # One row: the root, where there is a conversation.
    root = ids.sparkSession.createDataFrame([(0, 0, 0, None, None, members, top, 0)] if members else [],
                                            "depth long, da long, db long, pa long, pb long, n long, conv long, size long")
    nodes = keep(trie_nodes(turns).unionByName(root), "trie-nodes")
    at = ["depth", "da", "db"]
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("pa").alias("da"), F.col("pb").alias("db")) \
        .agg(F.count("*").alias("n_children"))
    # Children of the root need no join to know their parent.
    owners = nodes.where("depth > 0").select((F.col("depth") + 1).alias("depth"), F.col("da").alias("pa"), F.col("db").alias("pb"),
                                             F.col("conv").alias("parent"))
    deep = nodes.where("depth > 1").join(owners, ["depth", "pa", "pb"])
    near = nodes.where("depth <= 1").withColumn("parent", F.when(F.col("depth") == 1, F.lit(top)).cast("long"))
    known = deep.unionByName(near).join(children, at, "left").join(ends_digests(ends), at, "left").select(
        F.col("conv").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"),
        F.coalesce("n_children", F.lit(0)).alias("n_children"), ((F.col("n") - 1) * F.col("size")).alias("own_saved"),
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))
    known = keep(known.withColumn("own_leaf", (F.col("n_children") == 0).cast("long")), "trie-known")
    head = (F.col("parent_conv_id") != F.col("conv_id"))
    paths = known.groupBy(F.col("conv_id").alias("conv")).agg(
        F.max(F.when(head, F.col("parent_conv_id"))).alias("up"), F.max(F.when(head, F.col("depth") - 1)).alias("up_depth"),
        F.sum("own_leaf").alias("leaves"), F.sum("own_saved").alias("saved"))
    paths = keep(paths, "trie-paths")
    totals = path_totals(paths.drop("up_depth"), top)
    hung = paths.where("up is not null").select("conv", "up", "up_depth").join(totals, "conv") \
        .groupBy(F.col("up").alias("conv_id"), F.col("up_depth").alias("depth")) \
        .agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
    summed = known.join(hung, ["conv_id", "depth"], "left") \
        .withColumn("l", F.col("own_leaf") + F.coalesce("l", F.lit(0))) \
        .withColumn("s", F.col("own_saved") + F.coalesce("s", F.lit(0))).withColumn("height", -F.col("depth"))
    rows = in_segments(summed, ["conv_id"], ["height"])
    for value, out in (("l", "n_leaves"), ("s", "saved_tokens")):
        rows = running_sum(rows, ["conv_id"], ["height"], F.col(value), out)
    return rows.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The trie of a table (conv_id, turn, role, text) as it stands; other columns are not read."""
    prepare(conversations.sparkSession)
    placed = keep(in_order(turn_digests(conversations)), "trie-placed")
    return prefix_trie(placed, placed.select("conv_id").distinct())


def op12_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix trie of all conversations, each rebuilt to begin like the first of its family."""
    return prefix_trie(*rebuilt(read(spark, sf_dir, "conversations")))
