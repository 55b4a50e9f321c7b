"""The trie of conversation prefixes, by prefix doubling.

Every distinct turn (role and text) gets a dense number, its name. A block of 2^k turns that begins at a multiple of 2^k is named by the
pair of names of its halves, so the names of all such blocks come in as many rounds as the longest conversation's length has binary
digits, and each round has half the rows of the one before. A prefix of d turns is a prefix of d less its lowest binary digit, which is
named already, and one block: rounds from the largest block to the smallest name all prefixes, each once. Members of a name are
grouped, and the smallest conversation with it names the node.

A node's subtree isn't walked: a leaf's or a node's own smallest conversation is a member of all nodes above it, so leaves and saved tokens
of a subtree are sums over the members of its top.

Hot names (a first turn that a third of the conversations share) are grouped with partial aggregates and joined by plain joins, which Spark
splits; turns are numbered and summed over ranges of (conversation, turn), so a very long conversation is no task's either. The ids of
conversations that end at a node are joined to pieces of at most `PIECE` ids, wherever they lie, and hashed piece by piece:
the one task that hashes a node's list reads its pieces as a stream and holds one at a time.

Defined results: rows without a conv_id are left out; a null role or text is empty; turns that share a number (null first) go by role and then by
the SHA-256 of role and text, and repeated rows are turns of their own; an empty table gives an empty table (no root, as it has no
members); a conversation that is rebuilt without turns ends at the root; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from holdfast.llm.common import Scope

WORD = r"[^\x20\x09-\x0D]+"
#: A conversation's first turns are those of the first one of its group of so many ids, as many as its hash modulo MOST_HEADS says.
GROUP, MOST_HEADS = 20, 4
PIECE = 4096


def with_running(scope: Scope, rows: DataFrame, key: str, order: list[str], values: dict[str, str], label: str) -> DataFrame:
    """rows with, for each new column, the sum of a value column over the rows of the key up to this one, in the given order.

    Rows are dealt out by ranges of key and order, summed inside each range, and ranges are added up before each, so a key of any size
    falls into many tasks.
    """
    dealt = scope.write(rows.repartitionByRange(key, *order).withColumn("part", F.spark_partition_id()), label)
    inside = Window.partitionBy("part", key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    # the parts of a key: as many as there are partitions at most, and one for nearly all keys
    before = Window.partitionBy(key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy(key, "part").agg(*[F.sum(v).alias(v) for v in set(values.values())])
    split = sums.withColumn("parts", F.count(F.lit(1)).over(Window.partitionBy(key))).where("parts > 1")
    offsets = split.select(F.col(key).alias("k"), F.col("part").alias("p"), *[F.coalesce(F.sum(v).over(before), F.lit(0)).alias(f"before_{name}") for name, v in values.items()])
    out = dealt.withColumns({name: F.sum(v).over(inside) for name, v in values.items()})
    # few keys lie in more than one range
    out = out.join(offsets, (F.col(key) == F.col("k")) & (F.col("part") == F.col("p")), "left")
    return out.withColumns({name: F.col(name) + F.coalesce(f"before_{name}", F.lit(0)) for name in values}).drop("part", "k", "p", *[f"before_{name}" for name in values])


def turns_of(scope: Scope, conversations: DataFrame) -> DataFrame:
    """conv, at (from 0), key (hash of role and text), words of every turn in its order."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    key = F.unhex(F.sha2(F.concat_ws(":", F.length(role).cast("string"), role, text).cast("binary"), 256))
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv"),
        F.col("turn").isNotNull().cast("int").alias("given"),
        F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("turn"),
        role.alias("role"),
        key.alias("key"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"),
        F.lit(1).cast("long").alias("one"),
    ).where("conv is not null")
    placed = with_running(scope, rows, "conv", ["given", "turn", "role", "key"], {"upto": "one"}, "own")
    return placed.select("conv", (F.col("upto") - 1).alias("at"), "key", "words")


def heads(conv: Column) -> Column:
    """How many first turns of another conversation go before a conversation's own."""
    return (F.crc32(conv.cast("string").cast("binary")) % MOST_HEADS).cast("long")


def rebuilt(scope: Scope, turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The turns of rebuilt conversations (conv, at, key, words), and of every conversation conv, len.

    At most GROUP conversations share a first one, and it gives at most MOST_HEADS - 1 turns to each.
    """
    first = scope.write(turns.where((F.col("conv") % GROUP == 0) & (F.col("at") < MOST_HEADS - 1)), "first")
    lent = first.groupBy(F.col("conv").alias("base")).agg(F.count(F.lit(1)).alias("n_first"))
    own = turns.groupBy("conv").agg(F.count(F.lit(1)).alias("n_own")).withColumns({"h": heads(F.col("conv")), "base": F.col("conv") - F.col("conv") % GROUP})
    plan = own.join(lent, "base", "left").withColumn("taken", F.least("h", F.coalesce("n_first", F.lit(0).cast("long"))))
    plan = scope.write(plan.withColumn("len", F.col("taken") + F.greatest(F.col("n_own") - F.col("h"), F.lit(0))).select("conv", "base", "h", "taken", "len"), "plan")
    given = plan.where("taken > 0").select("conv", "base", "taken").join(first.select(F.col("conv").alias("base"), "at", "key", "words"), "base").where("at < taken").select("conv", "at", "key", "words")
    kept = turns.where(F.col("at") >= heads(F.col("conv"))).join(plan.select("conv", "h", "taken"), "conv").select("conv", (F.col("at") - F.col("h") + F.col("taken")).alias("at"), "key", "words")
    return scope.write(given.unionByName(kept), "rebuilt"), plan.select("conv", "len")


def named(scope: Scope, rows: DataFrame, key: list[str], label: str, least: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """rows with `name` in place of the key's columns (but those in keep): a dense number from 0 of each distinct key. least: a column whose
    smallest value under the key is added as `rep`."""
    distinct = rows.groupBy(*key).agg(F.min(least).alias("rep")) if least else rows.select(*key).distinct()
    distinct = scope.write(distinct.withColumn("part_row", F.monotonically_increasing_id()), f"{label}_keys")
    part = F.shiftright("part_row", 33)
    # a row for each partition that has any
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = distinct.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    numbers = distinct.withColumn("part", part).join(F.broadcast(offsets), "part")
    numbers = numbers.withColumn("name", F.col("offset") + F.col("part_row").bitwiseAND(F.lit((1 << 33) - 1))).drop("part", "offset", "part_row")
    return scope.write(rows.join(numbers, key).drop(*[c for c in key if c not in keep]), label)


def blocks_of(scope: Scope, turns: DataFrame, longest: int) -> list[DataFrame]:
    """For k = 0, 1, 2 ... while 2^k is at most longest: conv, at, name of all whole blocks of 2^k turns at multiples of 2^k; at counts blocks."""
    levels = [named(scope, turns.select("conv", "at", "key"), ["key"], "blocks0")]
    for k in range(1, max(longest, 1).bit_length()):
        # a block's halves are two rows, whatever the conversation
        side = lambda s: F.max(F.when(F.col("at") % 2 == s, F.col("name")))
        pairs = levels[-1].groupBy("conv", F.shiftright("at", 1).alias("at")).agg(side(0).alias("left"), side(1).alias("right")).where("right is not null")
        levels.append(named(scope, pairs, ["left", "right"], f"blocks{k}"))
    return levels


def prefixes_of(scope: Scope, levels: list[DataFrame]) -> DataFrame:
    """conv, depth (from 1), rep: the smallest conversation with the same first `depth` turns."""
    done: DataFrame | None = None
    for k in range(len(levels) - 1, -1, -1):
        # blocks at even places end a prefix whose lowest binary digit is k; what is before them has a larger one
        blocks = levels[k].where(F.col("at") % 2 == 0).select("conv", F.shiftleft("at", k).alias("start"), F.col("name").alias("block"))
        if done is None:
            before = blocks.withColumn("prefix", F.lit(0).cast("long"))
        else:
            known = done.select(F.col("conv").alias("c"), "depth", F.col("name").alias("prefix"))
            before = blocks.join(known, (F.col("conv") == F.col("c")) & (F.col("start") == F.col("depth")), "left").drop("c", "depth")
            before = before.withColumn("prefix", F.coalesce("prefix", F.lit(0).cast("long")))
        rows = before.withColumn("depth", F.col("start") + (1 << k)).drop("start")
        found = named(scope, rows, ["depth", "prefix", "block"], f"prefixes{k}", "conv", ("depth",))
        done = found if done is None else done.unionByName(found)
    return done.select("conv", "depth", "rep")


def _pieces(batches):
    """Of rows sorted by node and conversation: one row for each PIECE ids of a node, joined by commas."""
    node, ids = None, []

    def piece():
        return pa.RecordBatch.from_pydict({"rep": pa.array([node[0]], pa.int64()), "depth": pa.array([node[1]], pa.int64()), "first": pa.array([ids[0]], pa.int64()), "ids": pa.array([",".join(map(str, ids))], pa.string())})

    for b in batches:
        for rep, depth, conv in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if ids and (node != (rep, depth) or len(ids) == PIECE):
                yield piece()
                ids = []
            node = (rep, depth)
            ids.append(conv)
    if ids:
        yield piece()


def _hashed(batches):
    """Of pieces sorted by node and first id: the SHA-256 of each node's whole list."""
    node, digest, out = None, None, []
    for b in batches:
        for rep, depth, ids in zip(*(b.column(c).to_pylist() for c in ("rep", "depth", "ids")), strict=True):
            if node != (rep, depth):
                out += [(*node, digest.hexdigest())] if node else []
                node, digest = (rep, depth), hashlib.sha256(ids.encode())
            else:
                digest.update(b"," + ids.encode())
        yield _rows(out)
        out = []
    yield _rows([(*node, digest.hexdigest())] if node else [])


def _rows(out: list[tuple[int, int, str]]) -> pa.RecordBatch:
    columns = zip(*out, strict=True) if out else ([], [], [])
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string()), strict=True)], names=["rep", "depth", "ends_sha256"])


def ends_of(ends: DataFrame) -> DataFrame:
    """rep, depth, ends_sha256 of nodes where conversations end. ends: rep, depth, conv."""
    order = ["rep", "depth", "conv"]
    pieces = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_pieces, "rep long, depth long, first long, ids string")
    return pieces.repartition("rep", "depth").sortWithinPartitions("rep", "depth", "first").mapInArrow(_hashed, "rep long, depth long, ends_sha256 string")


def trie(scope: Scope, turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """The nodes of the trie over turns (conv, at, key, words) of conversations (conv, len)."""
    root, longest = lengths.agg(F.min("conv"), F.max("len")).first()
    found = prefixes_of(scope, blocks_of(scope, turns, longest or 0))
    members = found.join(turns.select(F.col("conv").alias("c"), (F.col("at") + 1).alias("d"), "words"), (F.col("conv") == F.col("c")) & (F.col("depth") == F.col("d"))).drop("c", "d")
    members = members.unionByName(lengths.select("conv", F.lit(0).cast("long").alias("depth"), F.lit(root).cast("long").alias("rep"), F.lit(0).cast("long").alias("words")))
    # each member saves the words of its turns from here on, but those of which it is the node's own conversation
    members = members.join(lengths, "conv").withColumns({"saving": F.when(F.col("rep") == F.col("conv"), 0).otherwise(F.col("words")), "deep": -F.col("depth")})
    members = scope.write(with_running(scope, members, "conv", ["deep"], {"saved": "saving"}, "summed").select("conv", "depth", "rep", "len", "saved"), "members")
    nodes = scope.write(members.groupBy("rep", "depth").agg(F.count(F.lit(1)).alias("n_convs"), F.sum("saved").alias("saved_tokens"), F.max("len").alias("longest")), "nodes")
    # a conversation stands for one leaf at most: for the node where it ends
    leaves = nodes.where("longest = depth").select(F.col("rep").alias("conv"))
    n_leaves = members.select("conv", "rep", "depth").join(leaves, "conv", "left_semi").groupBy("rep", "depth").agg(F.count(F.lit(1)).alias("n_leaves"))
    above = members.select(F.col("conv").alias("c"), (F.col("depth") + 1).alias("d"), F.col("rep").alias("parent_conv_id"))
    nodes = scope.write(nodes.drop("longest").join(above, (F.col("rep") == F.col("c")) & (F.col("depth") == F.col("d")), "left").drop("c", "d"), "with_parents")
    n_children = nodes.where("depth > 0").groupBy(F.col("parent_conv_id").alias("rep"), (F.col("depth") - 1).alias("depth")).agg(F.count(F.lit(1)).alias("n_children"))
    ends = ends_of(members.where("depth = len"))
    out = nodes.join(n_children, ["rep", "depth"], "left").join(n_leaves, ["rep", "depth"], "left").join(ends, ["rep", "depth"], "left")
    none = F.lit(0).cast("long")
    return out.select(
        F.col("rep").alias("conv_id"),
        "depth",
        "parent_conv_id",
        "n_convs",
        F.coalesce("n_children", none).alias("n_children"),
        F.coalesce("n_leaves", none).alias("n_leaves"),
        "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The trie of the conversations as they are. Columns: conv_id, turn, role, text."""
    scope = Scope(conversations.sparkSession)
    turns = scope.write(turns_of(scope, conversations), "turns")
    out = trie(scope, turns, scope.write(turns.groupBy("conv").agg(F.count(F.lit(1)).alias("len")), "plan"))
    scope.release("members", "nodes", "with_parents")
    return out


def rebuilt_trie(conversations: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations."""
    scope = Scope(conversations.sparkSession)
    out = trie(scope, *rebuilt(scope, scope.write(turns_of(scope, conversations), "turns")))
    scope.release("members", "nodes", "with_parents")
    return out
