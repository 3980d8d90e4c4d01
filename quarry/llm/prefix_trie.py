"""Conversation prefix trie: nodes in preorder, subtrees as intervals, their figures by differences of prefix sums.

A node is a distinct sequence of first turns.  Whole conversations are ranked
lexicographically, ``BLOCK`` turns at a time: the distinct blocks are sorted
and numbered, then the blocks of their numbers, until one number is left of
each conversation, so no task gathers more than a block of a conversation.
The conversations below a node have neighbouring ranks; sorted by its first
rank and its depth, nodes are in preorder, and a subtree ends with the last
node that its last rank brings in.  Leaves and savings of a subtree are
differences of two prefix sums along that order, which are added up range by
range.  No step depends on the depth of the trie or on how many conversations
share a node.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quarry.llm.scratch import discard, materialise

#: Turns, or numbers of blocks, that are ranked at a time.
BLOCK = 64
#: Conversation ids (as a power of two) that are joined to one piece of a node's list at most.
PIECE = 12
WORD = r"[^\x20\x09-\x0D]+"
NODE = ["d", "p1", "p2"]


def running_sums(rows: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """``rows`` and, for each name, the sum of its column up to the row, itself included, in ``order``.

    Ranges of rows are sorted and added up each for itself, then their totals,
    a row a range.  Where ranges end comes from a sample, another one each
    time, so they are written once.
    """
    kept = rows.columns
    ranged = rows.withColumns({f"__v{k}": v for k, v in enumerate(sums.values())}).repartitionByRange(*order).withColumn("__part", F.spark_partition_id())
    ranged = materialise(ranged, "ranges")
    earlier = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    totals = ranged.groupBy("__part").agg(*(F.sum(f"__v{k}").alias(f"__t{k}") for k in range(len(sums))))
    bases = totals.select("__part", *(F.coalesce(F.sum(f"__t{k}").over(earlier), F.lit(0)).alias(f"__b{k}") for k in range(len(sums))))
    upto = W.partitionBy("__part").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    own = ranged.withColumns({f"__s{k}": F.sum(f"__v{k}").over(upto) for k in range(len(sums))})
    out = own.join(F.broadcast(bases), "__part")
    return out.select(*kept, *((F.col(f"__b{k}") + F.col(f"__s{k}")).alias(name) for k, name in enumerate(sums)))


def turn_places(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, place, key, words) for every turn of a conversation with an id: its place from 0, a digest of role and text, the text's words.

    In the order of ``turn_col``, null first; turns of one number are ordered
    by role, then text.  A null role or text is an empty one.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    t = turns.select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text")).where("conv is not null")
    key = F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary")))
    t = t.withColumn("words", F.size(F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).cast("long")).withColumn("key", key)
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    placed = materialise(running_sums(t, order, {"upto": F.lit(1)}).select("conv", "key", "words", "upto"), "turns")
    first = placed.groupBy("conv").agg(F.min("upto").alias("first"))
    return materialise(placed.join(first, "conv").select("conv", (F.col("upto") - F.col("first")).alias("place"), "key", "words"), "places")


def _gathered(rows: DataFrame, place: str, value: str) -> DataFrame:
    """(conv, block, arr): the values of ``BLOCK`` neighbouring places each, in order."""
    held = F.sort_array(F.collect_list(F.struct(F.col(place).alias("at"), F.col(value).alias("x"))))
    return rows.groupBy("conv", F.expr(f"{place} div {BLOCK}").alias("block")).agg(F.transform(held, lambda e: e["x"]).alias("arr"))


def conversation_ranks(places: DataFrame) -> DataFrame:
    """(conv, rank): equal sequences of turns have one rank from 1, a sequence comes before its extensions, and all that begin alike are neighbours."""
    level = materialise(_gathered(places, "place", "key"), "blocks")
    while True:
        numbers = running_sums(level.select("arr").distinct(), [F.col("arr")], {"rank": F.lit(1)})
        ranked = materialise(level.join(numbers, "arr").select("conv", "block", "rank"), "ranks")
        discard(level)
        if (ranked.agg(F.max("block")).first()[0] or 0) == 0:
            return ranked.select("conv", "rank")
        level = materialise(_gathered(ranked, "block", "rank"), "blocks")
        discard(ranked)


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's pieces, which come in order and stand together: a node's list is never held."""
    node, digest = None, None

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"d": [node[0]], "p1": [node[1]], "p2": [node[2]], "ends_sha256": [digest.hexdigest()]})

    for batch in batches:
        rows, closed = batch.to_pydict(), []
        for *key, ids in zip(rows["d"], rows["p1"], rows["p2"], rows["ids"], strict=True):
            if key != node:
                if node is not None:
                    closed.append((*node, digest.hexdigest()))
                node, digest = key, hashlib.sha256(ids.encode())
            else:
                digest.update(b"," + ids.encode())
        if closed:
            yield pa.RecordBatch.from_pydict(dict(zip(("d", "p1", "p2", "ends_sha256"), map(list, zip(*closed, strict=True)), strict=True)))
    if node is not None:
        yield done()


def trie_nodes(places: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """The nodes of the trie of ``places`` (conv, place, key, words; places are dense from 0), the root included.

    ``members`` (conv, each once) are all conversations, those without a turn
    included; by default those of ``places``.  No member: no node.
    """
    ranks = conversation_ranks(places)
    blocks = places.groupBy("conv", F.expr(f"place div {BLOCK}").alias("block")).agg(F.count("*").alias("k"), F.bit_xor(F.xxhash64("place", "key")).alias("x1"), F.bit_xor(F.xxhash64("key", "place")).alias("x2"))
    # A sequence is told by the exclusive-or of its placed turns' hashes, of which there are two.
    earlier = W.partitionBy("conv").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    before = {f"b{k}": F.coalesce(F.bit_xor(f"x{k}").over(earlier), F.lit(0)) for k in (1, 2)}
    blocks = blocks.withColumns(before).withColumn("n", F.sum("k").over(W.partitionBy("conv"))).join(ranks, "conv").select("conv", "block", "b1", "b2", "n", "rank")
    upto = W.partitionBy("conv", "block").orderBy("place").rowsBetween(W.unboundedPreceding, W.currentRow)
    steps = places.withColumn("block", F.expr(f"place div {BLOCK}")).withColumns({"h1": F.xxhash64("place", "key"), "h2": F.xxhash64("key", "place")})
    steps = steps.withColumns({f"s{k}": F.bit_xor(f"h{k}").over(upto) for k in (1, 2)}).join(blocks, ["conv", "block"])
    steps = steps.withColumns({f"p{k}": F.col(f"s{k}").bitwiseXOR(F.col(f"b{k}")) for k in (1, 2)})
    steps = steps.select("conv", (F.col("place") + 1).alias("d"), "p1", "p2", *(F.col(f"p{k}").bitwiseXOR(F.col(f"h{k}")).alias(f"q{k}") for k in (1, 2)), "n", "rank", "words")
    steps = materialise(steps, "steps")

    told = (F.count("*").alias("n_convs"), F.min("conv").alias("conv_id"), F.min("rank").alias("first"), F.max("rank").alias("last"), F.max("words").alias("words"))
    zero = F.lit(0).cast("long")
    everyone = places.select("conv").distinct() if members is None else members.select(F.col("conv").cast("long").alias("conv")).where("conv is not null").distinct()
    turned = materialise(everyone.join(ranks, "conv", "left").select("conv", F.coalesce("rank", zero).alias("rank"), zero.alias("words")), "members")
    root = turned.agg(*told).where("n_convs > 0").select(zero.alias("d"), zero.alias("p1"), zero.alias("p2"), zero.alias("q1"), zero.alias("q2"), "n_convs", "conv_id", "first", "last", "words")
    nodes = steps.groupBy(*NODE).agg(*told, F.min("q1").alias("q1"), F.min("q2").alias("q2"))
    nodes = materialise(root.unionByName(nodes), "nodes")

    up = nodes.where("d > 0").select((F.col("d") - 1).alias("d"), F.col("q1").alias("p1"), F.col("q2").alias("p2"))
    nodes = nodes.join(up.groupBy(*NODE).agg(F.count("*").alias("n_children")), NODE, "left").withColumn("n_children", F.coalesce("n_children", zero))
    nodes = nodes.withColumn("leaf", (F.col("n_children") == 0).cast("long")).withColumn("own", (F.col("n_convs") - 1) * F.col("words"))
    order = [F.col("first"), F.col("d")]
    placed = materialise(running_sums(nodes, order, {"position": F.lit(1), "leaves": F.col("leaf"), "saved": F.col("own")}), "preorder")
    # The nodes that a rank brings in stand together, so a subtree ends with the last node of its last rank.
    ends = placed.groupBy(F.col("first").alias("last")).agg(F.max("position").alias("subtree_end"), F.max("leaves").alias("all_leaves"), F.max("saved").alias("all_saved"))
    placed = placed.join(ends, "last")

    final = steps.where("d = n").select("conv", *NODE).unionByName(turned.where("rank = 0").select("conv", zero.alias("d"), zero.alias("p1"), zero.alias("p2")))
    pieces = final.groupBy(*NODE, F.shiftright("conv", PIECE).alias("piece")).agg(F.array_join(F.sort_array(F.collect_list("conv")).cast("array<string>"), ",").alias("ids"))
    lists = pieces.repartition(*NODE).sortWithinPartitions(*NODE, "piece").mapInArrow(_digested, "d long, p1 long, p2 long, ends_sha256 string")
    parents = placed.select(F.col("d").alias("pd"), F.col("p1").alias("pp1"), F.col("p2").alias("pp2"), F.col("conv_id").alias("parent_conv_id"))
    out = placed.join(parents, (F.col("d") - 1 == F.col("pd")) & (F.col("q1") == F.col("pp1")) & (F.col("q2") == F.col("pp2")), "left").join(lists, NODE, "left")
    return out.select(
        "conv_id",
        F.col("d").alias("depth"),
        "parent_conv_id",
        "n_convs",
        "n_children",
        (F.col("all_leaves") - F.col("leaves") + F.col("leaf")).alias("n_leaves"),
        (F.col("all_saved") - F.col("saved") + F.col("own")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
        "position",
        "subtree_end",
    )


def prefix_trie(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per node of the trie of all conversations' turns (role, text), the textless root (depth 0) included.

    ``conv_id``: smallest member, a member being a conversation that starts
    with the node's turns; ``n_convs``: members; ``parent_conv_id``: that of
    the parent (root: null); ``n_children``; ``n_leaves``: nodes without
    children in the subtree, the node included; ``saved_tokens``: over the
    subtree, each node's (n_convs - 1) times words of its last text;
    ``ends_sha256``: SHA-256 of the ids of the members that end here, ascending,
    comma-joined; ``position`` and ``subtree_end``: the subtree's interval in preorder.

    Turns are ordered as :func:`turn_places` says.  Rows without a
    conversation id are in no conversation; an empty table has no node.
    Repeated rows are repeated turns.
    """
    return trie_nodes(turn_places(turns, conv_col, turn_col, role_col, text_col))
