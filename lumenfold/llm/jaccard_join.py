"""N-gram Jaccard join with a token-group matrix.

1. Each text becomes its set of word shingles (64-bit hashes). Equal sets make one node.
2. All sets share one order of tokens: by hash, those that many nodes would meet by (DEMOTE_ABOVE) last. Two sets
   that are similar enough share a token among the first n - ceil(percent * n / 100) + 1 of each, its head. Which
   tokens are put last changes the cost, never the result.
3. Nodes that share a head token are partitioned into groups: those with the same most frequent head token, in
   order of size, at most GROUP_SIZE to a group. The matrix holds for each group the union of its heads.
4. The matrix meets the heads of all nodes. A node's head tokens up to the group's end that the group lacks are
   missing from every member, which bounds the overlap with any of them; only groups that the bound lets pass are
   opened.
5. Opened groups are verified on whole sets in tasks of at most QUERY_SIZE nodes against one group. Of the links
   found, a task returns a spanning forest: what is connected already needs no further link, so a group of
   thousands of near copies yields as many rows as copies, not as pairs; and once a group's members are connected,
   a node is compared with one of them before it is with all.
6. The links' connected components are contracted by joins.

Defined results: A-Z are lowered, words are runs of non-blank characters; a text with fewer words than a shingle has
its whole sequence as one shingle; a text without words (or null) has an empty set and is linked with nothing;
component_id is the least id in the component, ids that are null counting last; rows of equal id are rows of
their own.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import hashing
from .components import components
from .work import release, scoped, table

#: Tokens put last, at most: they are broadcast. It changes the cost alone.
DEMOTE_ABOVE, DEMOTE_MOST = 32, 1_000_000
GROUP_SIZE, QUERY_SIZE = 512, 512
#: Document ids broadcast at most to fetch texts; beyond it they are joined.
MOST_BROADCAST_IDS = 1_000_000
_LAST = np.int64(1 << 62)


def _ordered(tokens: np.ndarray, late: np.ndarray) -> np.ndarray:
    """Tokens as order keys, ascending; those in late (sorted keys) come last."""
    keys = (tokens >> np.uint64(2)).view(np.int64)
    if len(late):
        keys = np.where(late[np.minimum(np.searchsorted(late, keys), len(late) - 1)] == keys, keys + _LAST, keys)
        keys = np.sort(keys)
    return keys


def _node(keys: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(keys.tobytes(), digest_size=8).digest(), "little", signed=True)


def _sets(docs: DataFrame, words: int, percent: int, late: np.ndarray, whole: bool) -> DataFrame:
    """doc_id, node, n and the head (or the whole set) of every text."""
    shared = docs.sparkSession.sparkContext.broadcast(late)

    def run(batches):
        late = shared.value
        for batch in batches:
            texts, ids = batch.column("text").to_pylist(), batch.column("doc_id").to_pylist()
            rows: list = []
            size = 0
            for i, tokens in hashing.shingle_sets(texts, words):
                plain = (tokens >> np.uint64(2)).view(np.int64)
                n = len(plain)
                keys = _ordered(tokens, late)
                rows.append((ids[i], _node(plain), n, keys.tobytes() if whole else keys[: n - -(-percent * n // 100) + 1 if n else 0]))
                size += n
                if size > 500_000:
                    yield _batch(rows)
                    rows, size = [], 0
            if rows:
                yield _batch(rows)

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id bigint, node bigint, n int, keys {'binary' if whole else 'array<bigint>'}")


def _batch(rows: list) -> pa.RecordBatch:
    ids, nodes, counts, keys = zip(*rows, strict=True)
    if isinstance(keys[0], bytes):
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(nodes, pa.int64()), pa.array(counts, pa.int32()), pa.array(keys, pa.binary())], names=["doc_id", "node", "n", "keys"])
    offsets = np.zeros(len(keys) + 1, np.int32)
    np.cumsum([len(k) for k in keys], out=offsets[1:])
    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(keys)))
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(nodes, pa.int64()), pa.array(counts, pa.int32()), lists], names=["doc_id", "node", "n", "keys"])


def _nodes(sets: DataFrame) -> DataFrame:
    return sets.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("first_id"), F.first("n").alias("n"), F.first("keys").alias("keys"))


def _late(nodes: DataFrame) -> np.ndarray:
    often = nodes.select(F.explode("keys").alias("token")).groupBy("token").count().where(F.col("count") > DEMOTE_ABOVE)
    # at most DEMOTE_MOST numbers
    rows = often.orderBy(F.desc("count"), "token").limit(DEMOTE_MOST).select("token").toArrow()
    return np.sort(rows.column(0).to_numpy()) if rows.num_rows else np.zeros(0, np.int64)


def _opened(nodes: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(members: node, gid) and (opened: node, gid): which groups each node has to be verified against."""
    by_token = Window.partitionBy("token")
    tokens = nodes.select(F.explode("keys").alias("token"), "node", "n", F.element_at("keys", -1).alias("end"))
    tokens = all_tokens = table(tokens.withColumn("df", F.count("*").over(by_token)).where("df > 1"))
    best = tokens.groupBy("node").agg(F.max(F.struct("df", "token")).alias("best"), F.first("n").alias("n"), F.first("end").alias("end"))
    place = F.row_number().over(Window.partitionBy("best.token").orderBy("n", "node"))
    members = table(best.select("node", "n", "end", F.xxhash64("best.token", F.floor((place - 1) / GROUP_SIZE)).alias("gid")))
    groups = members.groupBy("gid").agg(F.min("end").alias("g_end"))
    tokens = tokens.drop("df", "end").join(members.select("node", "gid"), "node")
    matrix = tokens.groupBy("token", "gid").agg(F.count("*").alias("g_count"), F.min("n").alias("g_low"), F.max("n").alias("g_high"))
    matrix = matrix.withColumnRenamed("gid", "g")
    fits = (F.col("g_high") * 100 >= F.col("n") * percent) & (F.col("n") * 100 >= F.col("g_low") * percent)
    met = tokens.join(matrix, "token").where((F.col("gid") <= F.col("g")) & fits & ((F.col("gid") != F.col("g")) | (F.col("g_count") > 1)))
    met = met.groupBy("node", "g").agg(F.count("*").alias("shared"), F.min("g_low").alias("g_low"))
    bound = met.join(nodes.select("node", "n", "keys"), "node").join(groups.withColumnRenamed("gid", "g"), "g")
    inside = F.size(F.filter("keys", lambda t: t <= F.col("g_end")))
    least = F.greatest(F.col("g_low"), F.ceil(F.col("n") * percent / 100))
    needed = F.ceil(percent * (F.col("n") + least) / (100 + percent))
    opened = bound.where(F.col("n") - F.greatest(F.lit(0), inside - F.col("shared")) >= needed).select("node", F.col("g").alias("gid"))
    opened = table(opened)
    release(all_tokens)
    return members.select("node", "gid"), opened


class _Forest:
    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        while (y := self.up.get(x, x)) != x:
            self.up[x] = x = self.up.get(y, y)
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


#: What a node is to a group: members come first.
_MEMBER, _BOTH, _ASKS = range(3)


class _Group:
    """Members of a group and the links found between them and nodes that ask."""

    def __init__(self, members: list[tuple[int, int, bytes]], percent: int):
        self.percent = percent
        self.names, sizes, keys = (list(x) for x in zip(*members, strict=True))
        self.sizes, self.keys = np.array(sizes), [np.frombuffer(k, np.int64) for k in keys]
        every, owner = np.concatenate(self.keys), np.repeat(np.arange(len(members)), self.sizes)
        order = np.argsort(every, kind="stable")
        self.every, self.owner = every[order], owner[order]
        self.forest, self.joined, self.near = _Forest(), len(members) == 1, 0

    def _links(self, n: int, sizes, common):
        return 100 * common >= self.percent * (n + sizes - common)

    def links(self, node: int, n: int, packed: bytes) -> list[tuple[int, int]]:
        """Links of the node to members, as many as connect it to all that it is linked with; those that earlier links connect already are left out."""
        keys, found = np.frombuffer(packed, np.int64), []
        if self.joined:  # all members are connected: one link is enough, and the member that was linked last is likely to give it
            if self.forest.root(node) == self.forest.root(self.names[0]):
                return found
            common = len(np.intersect1d(keys, self.keys[self.near], assume_unique=True))
            if self._links(n, self.sizes[self.near], common):
                self.forest.join(node, self.names[self.near])
                return [(node, self.names[self.near])]
        low, high = np.searchsorted(self.every, keys), np.searchsorted(self.every, keys, "right")
        lengths = high - low
        at = np.repeat(low - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(lengths.sum())
        common = np.bincount(self.owner[at], minlength=len(self.names))
        for i in np.flatnonzero(self._links(n, self.sizes, common)).tolist():
            if self.names[i] != node and self.forest.join(node, self.names[i]):
                found.append((node, self.names[i]))
                self.near = i
        if found and not self.joined:
            self.joined = len({self.forest.root(x) for x in self.names}) == 1
        return found


def _verified(units: DataFrame, percent: int) -> DataFrame:
    """units: (gid, part, asks, node, n, keys), sorted so; members of a group come before the nodes that ask. Links (a, b)."""

    def opened(members: list) -> tuple[_Group, list]:
        """The group, and the links among its members."""
        group = _Group([m[:3] for m in members], percent)
        return group, [x for node, n, keys, asks in members if asks == _BOTH for x in group.links(node, n, keys)]

    def run(batches):
        current, members, group = None, [], None
        for batch in batches:
            found: list[tuple[int, int]] = []
            for gid, part, asks, node, n, keys in zip(*(batch.column(c).to_pylist() for c in ("gid", "part", "asks", "node", "n", "keys")), strict=True):
                if (gid, part) != current:
                    if members:
                        found += opened(members)[1]
                    current, members, group = (gid, part), [], None
                if asks != _ASKS:
                    members.append((node, n, keys, asks))
                    continue
                if members:
                    group, links = opened(members)
                    found += links
                    members = []
                if group:
                    found += group.links(node, n, keys)
            yield pa.RecordBatch.from_pylist([{"a": a, "b": b} for a, b in found], schema=types)
        if members:
            yield pa.RecordBatch.from_pylist([{"a": a, "b": b} for a, b in opened(members)[1]], schema=types)

    types = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    return units.mapInArrow(run, "a bigint, b bigint")


def _fetch(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of docs whose id is in ids (doc_id; null matches null)."""
    ids = table(ids.distinct())
    if ids.count() <= MOST_BROADCAST_IDS:
        ids = F.broadcast(ids)
    return docs.join(ids.withColumnRenamed("doc_id", "_id"), F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")


def jaccard_links(docs: DataFrame, *, words: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sets: doc_id, node, n of every row; nodes: node, first_id; links: a, b between nodes, connecting every component)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    heads = table(_sets(docs, words, percent, np.zeros(0, np.int64), False))
    sets, headed = table(heads.drop("keys")), table(_nodes(heads))
    release(heads)
    late = _late(headed)
    if len(late):
        release(headed)
        headed = table(_nodes(_sets(docs, words, percent, late, False)))
    members, opened = _opened(headed, percent)
    nodes = table(headed.select("node", "first_id"))
    release(headed)
    groups = opened.groupBy("gid").agg(F.ceil(F.count("*") / QUERY_SIZE).alias("parts"))
    asking = opened.join(groups, "gid").select("gid", F.pmod(F.xxhash64("node"), F.col("parts")).alias("part"), "node", F.lit(False).alias("inside"))
    inside = members.join(groups, "gid").select("gid", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), "node", F.lit(True).alias("inside"))
    # a member that asks its own group is sent there once
    code = F.when(~F.bool_or("inside"), _ASKS).when(F.bool_and("inside"), _MEMBER).otherwise(_BOTH)
    units = table(asking.unionByName(inside).groupBy("gid", "part", "node").agg(code.alias("asks")))
    wanted = units.select("node").distinct()
    texts = _fetch(docs, nodes.join(wanted, "node", "left_semi").select(F.col("first_id").alias("doc_id")))
    whole = _sets(texts, words, percent, np.zeros(0, np.int64), True).join(wanted, "node", "left_semi").groupBy("node").agg(F.first("n").alias("n"), F.first("keys").alias("keys"))
    ready = units.join(whole, "node").select("gid", "part", "asks", "node", "n", "keys")
    ready = ready.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "gid", "part").sortWithinPartitions("gid", "part", "asks", "node")
    return sets, nodes, table(_verified(ready, percent))


@scoped
def jaccard_components(docs: DataFrame, *, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id that links reach) for every row of docs (doc_id, text)."""
    sets, nodes, links = jaccard_links(docs, words=words, percent=percent)
    roots = components(links)
    nodes = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = nodes.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = nodes.join(named, "root").select("node", "component_id")
    # a node with very many equal texts is a skewed key on the left side alone, which adaptive execution splits
    out = sets.join(named, "node", "left")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each_group(docs: DataFrame, *, words: int = 5, percent: int = 80) -> DataFrame:
    """docs without the rows whose component has a smaller doc_id; of rows with the same id the first by text stays. Rows without an id stay."""
    found = jaccard_components(docs, words=words, percent=percent).where("doc_id is not null").groupBy("doc_id")
    found = table(found.agg(F.min("component_id").alias("component_id"), F.count("*").alias("n")).where("component_id < doc_id or n > 1"))
    ids = found.select(F.col("doc_id").alias("_id"), (F.col("component_id") < F.col("doc_id")).alias("_gone"))
    if ids.count() <= MOST_BROADCAST_IDS:
        ids = F.broadcast(ids)
    marked = docs.join(ids, F.col("doc_id") == F.col("_id"), "left")
    single = marked.where("_id is null")
    repeated = marked.where("not _gone").withColumn("_nth", F.row_number().over(Window.partitionBy("doc_id").orderBy("text"))).where("_nth = 1")
    return single.drop("_id", "_gone").unionByName(repeated.drop("_id", "_gone", "_nth"))
