"""The prefix tree of conversations: which turns they share, and the words that sharing saves.

A node is a distinct sequence of first turns (role, text); its members are the conversations that start with it. The
tree is built level by level:

1. Turns are numbered within their conversations by a range sort that parts a long conversation over many tasks.
2. Equal conversations form classes; a class's least conv_id stands for it with the class's size as its weight.
3. A level groups the live conversations by (parent node, next turn). A group's least conv_id names its node; with the
   depth it identifies it. Groups of one class need no further levels: the rest of its turns are nodes of its members
   alone. Only conversations that still share a node go on, so the levels built are those at which texts are shared.
4. From the deepest level up, each level's leaves and savings are summed by parent and joined to the nodes above.

Defined results: rows without conv_id belong to no conversation; null role or text is empty; turns are ordered by turn
(null first), equal ones by role, then text, repeated rows are turns of their own; without conversations there is no
node, not even the root; other columns are ignored. Turns are told apart by 128 bits of SHA-256 of role and text,
classes by their length and two sums of 64-bit hashes.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .mixing import WORD
from .work import scoped, table

#: Conversations with ids in one range of 2 ** BLOCK_BITS are listed in one row.
BLOCK_BITS = 16
_NUMBERED = "part int, conv_id bigint, i bigint, turn binary, words bigint, upto bigint"
_NONE = hashlib.sha256(b"").hexdigest()


def _number(batches):
    """(part, conv_id, i, turn, words, upto) of rows (conv_id, turn, words) in order: place and words so far within this part of the conversation."""
    from pyspark import TaskContext

    part, conv, count, total = TaskContext.get().partitionId(), None, 0, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        ids, words = batch.column("conv_id").to_numpy(), batch.column("words").to_numpy()
        begins = np.flatnonzero(np.concatenate([[conv is None or ids[0] != conv], ids[1:] != ids[:-1]]))
        place, upto = np.arange(len(ids)), np.cumsum(words)
        run = np.searchsorted(begins, place, "right") - 1
        start, before = np.concatenate([[-count], begins]), np.concatenate([[-total], upto[begins] - words[begins]])
        place, upto = place - start[run + 1], upto - before[run + 1]
        conv, count, total = ids[-1], int(place[-1]) + 1, int(upto[-1])
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), part, np.int32)), batch.column("conv_id"), pa.array(place), batch.column("turn"), batch.column("words"), pa.array(upto)], names=["part", "conv_id", "i", "turn", "words", "upto"])


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, i (the turn's place from 0), turn (a hash), words, upto (words of the conversation so far) of conversations (conv_id, turn, role, text)."""
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("at"), role.alias("role"), text.alias("text"), F.monotonically_increasing_id().alias("row"))
    named = F.unhex(F.substring(F.sha2(F.concat_ws(":", F.length("role"), "role", "text"), 256), 1, 32))
    rows = rows.withColumns({"turn": named, "words": F.regexp_count("text", F.lit(WORD)).cast("long")})
    order = [F.col("conv_id"), F.col("at").asc_nulls_first(), F.col("role"), F.col("text"), F.col("row")]
    parts = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("conv_id", "turn", "words")
    numbered = table(placed.mapInArrow(_number, _NUMBERED))
    # only conversations that cross from one part to the next have several rows here: two a part at most
    crossing = numbered.groupBy("conv_id", "part").agg(F.count("*").alias("n"), F.sum("words").alias("words"))
    crossing = crossing.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("part", "n", "words"))).alias("parts")).where(F.size("parts") > 1)
    before = lambda x: F.filter("parts", lambda p: p["part"] < x["part"])
    sums = lambda x: F.aggregate(before(x), F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("words")), lambda a, p: F.struct((a["n"] + p["n"]).alias("n"), (a["words"] + p["words"]).alias("words")))
    offsets = crossing.select("conv_id", F.inline(F.transform("parts", lambda x: F.struct(x["part"].alias("part"), sums(x).alias("before")))))
    found = numbered.join(F.broadcast(offsets), ["conv_id", "part"], "left")
    plus = lambda c, f: (F.col(c) + F.coalesce(F.col("before")[f], F.lit(0))).alias(c)
    return found.select("conv_id", plus("i", "n"), "turn", "words", plus("upto", "words"))


def with_heads(turns: DataFrame, every: int, heads: int) -> tuple[DataFrame, DataFrame]:
    """Conversations whose first turns are those of another, as (conv_id, length, total words) and their turns (conv_id, depth from 1, turn, words, upto).

    Conversation c is the first h turns of conversation c - c % every (all if fewer, none if absent), then its own
    after its first h; h = crc32(decimal c) % heads, so with one head all stay as they are. turns: as of ordered_turns.
    """
    first = F.when(F.col("i") < heads - 1, F.struct("i", "turn", "words", "upto"))
    own = table(turns.groupBy("conv_id").agg(F.count("*").alias("n"), F.max("upto").alias("total"), F.array_sort(F.collect_list(first)).alias("head")))
    base = own.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"), F.col("head").alias("given"))
    own = own.withColumn("h", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int"))
    own = own.join(base, F.col("conv_id") - F.col("conv_id") % every == F.col("base"), "left")
    taken = F.least("h", F.coalesce("n_base", F.lit(0))).cast("int")
    upto = lambda head, k: F.when(k > 0, F.try_element_at(head, k)["upto"]).otherwise(0)
    own = own.withColumns({"given": F.slice(F.coalesce("given", F.col("head")), F.lit(1), taken), "shift": taken - F.col("h"), "more": upto(F.col("given"), taken) - upto(F.col("head"), F.least("h", F.col("n").cast("int")))})
    own = own.withColumns({"length": F.size("given") + F.greatest(F.col("n") - F.col("h"), F.lit(0)), "total": F.col("total") + F.col("more")})
    own = table(own.select("conv_id", "length", "total", "h", "given", "shift", "more"))
    heads_of = own.select("conv_id", F.inline("given")).select("conv_id", (F.col("i") + 1).alias("depth"), "turn", "words", "upto")
    tails = turns.join(own.select("conv_id", "h", "shift", "more"), "conv_id").where("i >= h").select("conv_id", (F.col("i") + 1 + F.col("shift")).alias("depth"), "turn", "words", (F.col("upto") + F.col("more")).alias("upto"))
    return own.select("conv_id", "length", "total"), table(heads_of.unionByName(tails))


def _digest(batches):
    """Of rows (class, ids, least, n, length, total) in order of class and ids: one row a class, with the SHA-256 of all its ids."""
    held = None  # class, least, n, length, total and the hash so far

    def done():
        return dict(zip(("conv_id", "weight", "length", "total", "sha"), (*held[1:5], held[5].hexdigest()), strict=True))

    for batch in batches:
        out = []
        for r in batch.to_pylist():
            if held and held[0] == r["class"]:
                held[2] += r["n"]
                held[5].update(b"," + r["ids"].encode())
            else:
                out += [done()] if held else []
                held = [r["class"], r["least"], r["n"], r["length"], r["total"], hashlib.sha256(r["ids"].encode())]
        yield pa.RecordBatch.from_pylist(out, schema=_CLASS)
    if held:
        yield pa.RecordBatch.from_pylist([done()], schema=_CLASS)


_CLASS = pa.schema([("conv_id", pa.int64()), ("weight", pa.int64()), ("length", pa.int64()), ("total", pa.int64()), ("sha", pa.string())])


def classes(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """Classes of equal conversations: conv_id (the least), weight (how many), length, total and sha (of their ids, ascending, joined by commas)."""
    sums = turns.groupBy("conv_id").agg(*[F.sum(F.xxhash64(F.lit(seed), "depth", "turn").cast("decimal(38,0)")).alias(name) for seed, name in ((1, "a"), (2, "b"))])
    keyed = convs.join(sums, "conv_id", "left").withColumn("class", F.concat_ws(":", "length", "a", "b"))
    # ids are distinct, so a list holds 2 ** BLOCK_BITS at most
    listed = keyed.groupBy("class", F.shiftright("conv_id", BLOCK_BITS).alias("block")).agg(F.array_join(F.array_sort(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"), F.min("conv_id").alias("least"), F.count("*").alias("n"), F.max("length").alias("length"), F.max("total").alias("total"))
    parts = int(convs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return listed.repartition(parts, "class").sortWithinPartitions("class", "block").drop("block").mapInArrow(_digest, "conv_id bigint, weight bigint, length bigint, total bigint, sha string")


def _saved(total: Column) -> Column:
    return (F.col("weight") - 1) * total


def prefix_trie(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """The nodes of the prefix tree of convs (conv_id, length, total words) with their turns (conv_id, depth, turn, words, upto).

    Returns conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256.
    """
    parts = int(convs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    members = table(classes(convs, turns))
    turns = turns.join(members.select("conv_id"), "conv_id", "left_semi")
    # in order of depth, so that a level reads its own rows only
    turns = table(turns.repartitionByRange(parts, "depth", "conv_id").sortWithinPartitions("depth", "conv_id"))
    root = members.agg(F.min("conv_id").alias("conv_id"), F.sum("weight").alias("n_convs")).where("conv_id is not null")
    least = (root.head() or [None])[0]
    live = members.where("length > 0").select("conv_id", "weight", "length", "total", F.lit(least).cast("long").alias("node"))
    nodes = [root.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", F.lit(0).cast("long").alias("words"))]
    alone, ends = [], [members.where("length = 0").select(F.lit(least).cast("long").alias("node"), F.lit(0).cast("long").alias("depth"), "sha")]
    shas = members.select("conv_id", "sha")
    while True:
        depth = len(nodes)
        following = live.join(turns.where(F.col("depth") == depth).select("conv_id", "turn", "words", "upto"), "conv_id")
        groups = following.groupBy("node", "turn").agg(F.min("conv_id").alias("conv_id"), F.sum("weight").alias("weight"), F.count("*").alias("n_classes"), *[F.max(c).alias(c) for c in ("words", "length", "total", "upto")])
        groups = table(groups.withColumn("depth", F.lit(depth).cast("long")))
        alone.append(groups.where("n_classes = 1").select("conv_id", "weight", "length", "total", F.col("depth").alias("start"), F.col("node").alias("parent"), _saved(F.col("total") - F.col("upto") + F.col("words")).alias("saved")))
        shared = groups.where("n_classes > 1")
        if shared.isEmpty():
            break
        nodes.append(shared.select("conv_id", "depth", F.col("node").alias("parent_conv_id"), F.col("weight").alias("n_convs"), "words"))
        live = table(following.drop("words", "upto").join(shared.select("node", "turn", F.col("conv_id").alias("next")), ["node", "turn"]).select("conv_id", "weight", "length", "total", F.col("next").alias("node")))
        ends.append(live.where(F.col("length") == depth).join(shas, "conv_id").select("node", F.lit(depth).cast("long").alias("depth"), "sha"))
        live = live.where(F.col("length") > depth)

    below, summed = None, []
    for level, single in zip(reversed(nodes), reversed(alone), strict=True):
        children = single.select("parent", F.lit(1).cast("long").alias("leaves"), "saved")
        if below is not None:
            children = children.unionByName(below.select(F.col("parent_conv_id").alias("parent"), F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved")))
        children = children.groupBy("parent").agg(F.count("*").alias("n_children"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
        found = level.join(children, F.col("conv_id") == F.col("parent"), "left")
        saved = (F.col("n_convs") - 1) * F.col("words") + F.coalesce("saved", F.lit(0))
        below = table(found.select("conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), F.coalesce("leaves", F.lit(1)).alias("n_leaves"), saved.alias("saved_tokens")))
        summed.append(below)
    union = functools.partial(functools.reduce, DataFrame.unionByName)
    upper = union(summed).join(union(ends).withColumnRenamed("node", "conv_id"), ["conv_id", "depth"], "left")
    single = turns.join(union(alone).drop("saved"), "conv_id").where("depth >= start").join(shas, "conv_id")
    lower = single.select(
        "conv_id",
        "depth",
        F.when(F.col("depth") == F.col("start"), F.col("parent")).otherwise(F.col("conv_id")).alias("parent_conv_id"),
        F.col("weight").alias("n_convs"),
        (F.col("depth") < F.col("length")).cast("long").alias("n_children"),
        F.lit(1).cast("long").alias("n_leaves"),
        _saved(F.col("total") - F.col("upto") + F.col("words")).alias("saved_tokens"),
        F.when(F.col("depth") == F.col("length"), F.col("sha")).alias("sha"),
    )
    return upper.unionByName(lower).withColumn("ends_sha256", F.coalesce("sha", F.lit(_NONE))).drop("sha")


@scoped
def conversation_trie(conversations: DataFrame, every: int = 20, heads: int = 1) -> DataFrame:
    """The prefix tree of conversations (conv_id, turn, role, text); with several heads, of those that with_heads makes of them."""
    return prefix_trie(*with_heads(ordered_turns(conversations), every, heads))
