"""Trie of conversation prefixes, with subtree totals summed over members.

A prefix of d turns is known by d and the sum of a hash of every (place, role, text) in it, so running
sums identify all prefixes of conversations of any length. A node is the group of conversations with
one prefix, named by its smallest member. If a conversation names a prefix it names its longer ones, too,
so the nodes that a conversation names are the end of its path. Of the nodes named by a member of a node all
lie below it, but those that its own name gives to shorter prefixes. A subtree's total is therefore the sum,
over the members of its top, of what each member names, less what the top's name gives to shorter prefixes: one
grouping and one running sum, for tries of any depth.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keyed import spread_join
from ..functions.ordering import scan_within, sorted_blocks
from .scratch import Scratch

WORD = r"[^\x20\x09-\x0D]+"
#: Conversations of one family share the first turns of its first member.
FAMILY, SHARED = 20, 4
#: Ids joined to one piece of text before it is hashed.
PIECE = 1_000
_NONE = hashlib.sha256(b"").hexdigest()
_SUMS = ("s0", "s1", "s2", "s3")


def shared_turns(conv: Column) -> Column:
    """Number of turns a conversation takes from the first of its family."""
    return (F.crc32(conv.cast("string").cast("binary")) % SHARED).cast("long")


def rebuilt_turns(scratch: Scratch, turns: DataFrame, conv: str, turn: str, role: str, text: str) -> tuple[DataFrame, DataFrame]:
    """((conv, place, a, b, words) of every rebuilt turn, one row per conversation).

    ``a`` and ``b`` are hashes of role and text. Own and shared turns are numbered from 1 in the
    order of ``turn``, null first, equal ones by hash.
    """
    r, t = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    given = turns.where(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("conv"), F.col(turn).alias("turn"), F.xxhash64(r, t).alias("a"),
        F.xxhash64(F.lit(1), t, r).alias("b"), F.regexp_count(t, F.lit(WORD)).cast("long").alias("words"),
    )
    order = [F.col("turn").asc_nulls_first(), F.col("a"), F.col("b")]
    ordered = scratch.stage(scan_within(given, ["conv"], order, rank="place").drop("turn"), "ordered")
    convs = ordered.groupBy("conv").agg(F.count("*").alias("own"))
    plan = convs.select("conv", (F.col("conv") - F.col("conv") % FAMILY).alias("head"), shared_turns(F.col("conv")).alias("h"))
    # At most SHARED - 1 turns of a head, at most FAMILY conversations to each.
    heads = ordered.where(F.col("place") < SHARED).withColumnRenamed("conv", "head")
    taken = plan.join(heads, "head").where(F.col("place") <= F.col("h")).select("conv", "place", "a", "b", "words")
    sizes = convs.select(F.col("conv").alias("head"), F.col("own").alias("_own"))
    moved = plan.join(sizes, "head", "left").select(
        "conv", "h", (F.col("h") - F.least("h", F.coalesce("_own", F.lit(0)))).alias("back")
    )
    own = spread_join(ordered, moved, "conv").where(F.col("place") > F.col("h"))
    own = own.select("conv", (F.col("place") - F.col("back")).alias("place"), "a", "b", "words")
    return taken.unionByName(own), convs


def prefix_rows(rebuilt: DataFrame) -> DataFrame:
    """(conv, depth, words, node, parent): one row per rebuilt turn, with the ids of its prefix and the one before."""
    spots = {}
    for i in (0, 1):
        spread = F.xxhash64(F.lit(i), "place", "a", "b")
        # Halves of 32 bits, so that sums do not overflow.
        spots[f"p{2 * i}"], spots[f"p{2 * i + 1}"] = spread.bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned(spread, 32)
    rows = rebuilt.withColumns(spots).drop("a", "b")
    summed = scan_within(rows, ["conv"], ["place"], sums={s: f"p{i}" for i, s in enumerate(_SUMS)})
    before = [F.col(s) - F.col(f"p{i}") for i, s in enumerate(_SUMS)]
    return summed.select(
        "conv", F.col("place").alias("depth"), "words", _node(F.col("place"), [F.col(s) for s in _SUMS]).alias("node"),
        _node(F.col("place") - 1, before).alias("parent"),
    )


def _node(depth: Column, sums: list[Column]) -> Column:
    return F.md5(F.concat_ws(",", depth.cast("string"), *[s.cast("string") for s in sums]))


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes of the pieces of each node in order; one piece at a time is in memory."""
    node, state = None, None
    for batch in batches:
        for key, piece in zip(batch.column("node").to_pylist(), batch.column("ids").to_pylist()):
            if key == node:
                state.update(b"," + piece.encode())
                continue
            if node is not None:
                yield pa.RecordBatch.from_pydict({"node": [node], "ends_sha256": [state.hexdigest()]})
            node, state = key, hashlib.sha256(piece.encode())
    if node is not None:
        yield pa.RecordBatch.from_pydict({"node": [node], "ends_sha256": [state.hexdigest()]})


def end_hashes(scratch: Scratch, ends: DataFrame) -> DataFrame:
    """(node, ends_sha256) from (conv, node) of every conversation's last prefix.

    Ids are joined to pieces of at most ``PIECE`` in many tasks; a node's hash is then one piece
    after the other, as SHA-256 needs, without holding them together.
    """
    blocks = sorted_blocks(ends, ["node", "conv"])
    pieces = blocks.groupBy("node", "__block", (F.col("__spot") / PIECE).cast("long").alias("part")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("conv")), lambda c: c.cast("string")), ",").alias("ids")
    )
    pieces = scratch.stage(pieces, "pieces")
    many = pieces.groupBy("node").agg(F.count("*").alias("n"), F.max("ids").alias("ids"))
    single = many.where("n = 1").select("node", F.sha2("ids", 256).alias("ends_sha256"))
    several = pieces.join(many.where("n > 1").select("node"), "node", "left_semi")
    streamed = several.repartition("node").sortWithinPartitions("node", "__block", "part").select("node", "ids")
    return single.unionByName(streamed.mapInArrow(_digest, "node string, ends_sha256 string"))


def subtree_totals(members: DataFrame, named: DataFrame, totals: list[str]) -> DataFrame:
    """(node, totals) summed over subtrees, from the (conv, node) of every prefix and the nodes (node, conv_id, depth, totals)."""
    owned = named.groupBy(F.col("conv_id").alias("conv")).agg(*[F.sum(c).alias(f"_{c}") for c in totals])
    whole = spread_join(members.select("conv", "node"), owned, "conv").groupBy("node").agg(*[F.sum(f"_{c}").alias(f"_{c}") for c in totals])
    running = scan_within(named.select("node", "conv_id", "depth", *totals), ["conv_id"], ["depth"], sums={f"_upto_{c}": c for c in totals})
    return whole.join(running, "node").select("node", *[(F.col(f"_{c}") - F.col(f"_upto_{c}") + F.col(c)).alias(c) for c in totals])


def conversation_trie(
    turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """One row per prefix of the rebuilt conversations, with members, children and subtree totals.

    A node is named by its smallest member and its depth. Columns: conv_id, depth, parent_conv_id,
    n_convs, n_children, n_leaves, saved_tokens, ends_sha256. Turns without a conversation id are
    left out; a null role or text is empty; turns of equal number, repeated rows among them, all stay,
    ordered by a hash of role and text. A conversation whose rebuilt form is empty is a member of the
    root only. Without conversations there is no row. Other columns are not read.
    """
    with Scratch(turns.sparkSession, "conversation-trie") as scratch:
        rebuilt, convs = rebuilt_turns(scratch, turns, conv, turn, role, text)
        rebuilt, convs = scratch.stage(rebuilt, "rebuilt"), scratch.stage(convs.select("conv"), "convs")
        rows = scratch.stage(prefix_rows(rebuilt), "prefixes")
        root = _node(F.lit(0), [F.lit(0)] * len(_SUMS))
        tops = convs.select("conv", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("words"), root.alias("node"))
        members = rows.unionByName(tops.withColumn("parent", F.lit(None).cast("string")))
        nodes = members.groupBy("node").agg(
            F.min("conv").alias("conv_id"), F.count("*").alias("n_convs"), F.max("depth").alias("depth"), F.max("words").alias("words"),
            F.max("parent").alias("parent"),
        )
        nodes = scratch.stage(nodes, "nodes")
        lasts = members.groupBy("conv").agg(F.max_by("node", "depth").alias("node"))
        hashes = end_hashes(scratch, lasts)
        up = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
        saved = (F.col("n_convs") - 1) * F.col("words")
        kids = nodes.where(F.col("parent").isNotNull()).groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
        named = spread_join(nodes, up, "parent", "left").join(kids, "node", "left").join(hashes, "node", "left")
        n_children = F.coalesce("n_children", F.lit(0))
        named = scratch.stage(named.select(
            "node", "conv_id", "depth", "parent_conv_id", "n_convs", n_children.alias("n_children"), (n_children == 0).cast("long").alias("n_leaves"),
            saved.alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(_NONE)).alias("ends_sha256"),
        ), "named")
        totals = subtree_totals(members, named, ["n_leaves", "saved_tokens"])
        out = named.drop("n_leaves", "saved_tokens").join(totals, "node").select(
            "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"
        )
        return scratch.result(out, "trie")
