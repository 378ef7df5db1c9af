"""Mixing sources to target weights with exact block quotas.

Every source is cut into blocks (hash buckets of its documents of about ``block_words`` words). A source's
target decides how many blocks are drawn, in a fresh permutation for each pass over the source; the last
block of a pass is taken in part. A splitting tree then divides the vector of block quotas among the output
shards: each node gives its left child a multivariate hypergeometric share, so every shard's composition is
distributed as if all drawn blocks had been dealt at random, while the totals stay exact. Each shard takes the
next run of every source's permuted blocks and shuffles its own rows.

Everything runs as DataFrame expressions. Only the narrow per-document rows are shuffled, by block, so a source
with a third of all rows is spread over as many tasks as it has blocks.

Defined results: a null text has size 0; a null source is a source of its own and ranks last; a source of size 0
has target 0; identical rows share an order key and are interchangeable; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .work import table

WORD = r"[^\x20\x09-\x0D]+"

#: Beyond this many sources their table is joined with salted keys instead of being broadcast.
MOST_BROADCAST_SOURCES = 100_000
_SALTS = 64
#: Output shards unless told otherwise: about SHARD_WORDS words each, LEAST_SHARDS at least (as a power of two).
LEAST_SHARDS, SHARD_WORDS = 64, 1 << 26


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """sizes: (source, source_size). Adds sidx (rank by code point, null last) and target.

    Targets are weights times one level, each at most cap times its source's size, and sum to share times
    all sizes. With c the caps in order of c / weight, the level is the largest of the levels that each
    linear piece of the (concave) total would give.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy("ratio", "sidx")
    ranked = sizes.withColumn("sidx", F.row_number().over(by_name) - 1)
    ranked = ranked.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod("sidx", F.lit(len(weights))) + 1))
    ranked = ranked.withColumn("most", cap * F.col("source_size")).withColumn("ratio", F.col("most") / F.col("weight"))
    everything = Window.partitionBy()
    below = F.coalesce(F.sum("most").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    above = F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    total = share * F.sum("source_size").over(everything)
    ranked = ranked.withColumn("piece", (total - below) / above)
    level = F.max("piece").over(everything)
    return ranked.select("source", "source_size", "sidx", F.greatest(F.lit(0.0), F.least("most", level * F.col("weight"))).alias("target"))


def _log_factorial(x: str) -> str:
    return f"(case when {x} < 2 then 0D else ({x} + 0.5D) * ln({x}) - {x} + 0.9189385332046727D + 1D / (12D * {x}) - 1D / (360D * pow({x}, 3)) + 1D / (1260D * pow({x}, 5)) end)"


def _hypergeometric(total: str, marked: str, drawn: str, uniform: str) -> str:
    """SQL for a draw by inversion: marked ones among `drawn` of `total`; values are tried from the mode outwards."""
    low, high = f"greatest(0L, v.d - v.r + v.k)", "least(v.k, v.d)"
    mode = f"least({high}, greatest({low}, cast(floor((v.d + 1D) * (v.k + 1D) / (v.r + 2D)) as bigint)))"
    log_choose = lambda n, k: f"({_log_factorial(n)} - {_log_factorial(k)} - {_log_factorial(f'({n} - {k})')})"
    at_mode = f"exp({log_choose('v.k', 'v.m')} + {log_choose('(v.r - v.k)', '(v.d - v.m)')} - {log_choose('v.r', 'v.d')})"
    deviation = "sqrt(greatest(0D, cast(v.d as double) * v.k / greatest(1, v.r) * (1 - cast(v.k as double) / greatest(1, v.r))))"
    steps = f"cast(least(greatest({high} - v.m, v.m - {low}), ceil(12 * {deviation}) + 8) as int)"
    up = f"if(v.m + i <= {high}, a.up * (v.k - v.m - i + 1D) * (v.d - v.m - i + 1D) / ((v.m + i) * (v.r - v.k - v.d + v.m + i + 0D)), 0D)"
    down = f"if(v.m - i >= {low}, a.down * (v.m - i + 1D) * (v.r - v.k - v.d + v.m - i + 1D) / ((v.k - v.m + i + 0D) * (v.d - v.m + i)), 0D)"
    one = lambda fields, name, body: f"element_at(transform(array({fields}), {name} -> {body}), 1)"
    step = one(f"named_struct('up', {up}, 'down', {down})", "s", "named_struct('x', case when v.u < a.c + s.up then v.m + i when v.u < a.c + s.up + s.down then v.m - i else -1L end, 'c', a.c + s.up + s.down, 'up', s.up, 'down', s.down)")
    search = f"aggregate(if({steps} >= 1, sequence(1, {steps}), cast(array() as array<int>)), named_struct('x', if(v.u < v.p, v.m, -1L), 'c', v.p, 'up', v.p, 'down', v.p), (a, i) -> if(a.x >= 0, a, {step}), a -> if(a.x >= 0, a.x, v.m))"
    with_mode = one(f"named_struct('r', v.r, 'k', v.k, 'd', v.d, 'u', v.u, 'm', {mode})", "v", one(f"named_struct('r', v.r, 'k', v.k, 'd', v.d, 'u', v.u, 'm', v.m, 'p', {at_mode})", "v", search))
    return one(f"named_struct('r', {total}, 'k', {marked}, 'd', {drawn}, 'u', {uniform})", "v", with_mode)


def _left_share(seed: int) -> str:
    """SQL for the left child's quotas: a multivariate hypergeometric draw of half of the node's blocks, source by source."""
    uniform = f"((shiftrightunsigned(xxhash64({seed}L, node, i), 11) + 0.5D) / 9007199254740992D)"
    draw = _hypergeometric("t.r", "element_at(quotas, i + 1)", "t.d", uniform)
    total = "aggregate(quotas, 0L, (s, q) -> s + q)"
    step = f"element_at(transform(array({draw}), x -> named_struct('r', t.r - element_at(quotas, i + 1), 'd', t.d - x, 'out', concat(t.out, array(x)))), 1)"
    return f"aggregate(sequence(0, size(quotas) - 1), named_struct('r', {total}, 'd', {total} div 2, 'out', cast(array() as array<bigint>)), (t, i) -> {step}, t -> t.out)"


def split_quotas(quotas: DataFrame, levels: int, seed: int) -> DataFrame:
    """quotas: (sidx 0.., n). Rows (sidx, shard, n) of the splitting tree's 2 ** levels leaves; sums by sidx stay exact."""
    nodes = quotas.groupBy().agg(F.sort_array(F.collect_list(F.struct("sidx", "n"))).alias("q")).where(F.size("q") > 0)
    nodes = nodes.select(F.lit(1).cast("long").alias("node"), F.col("q.n").alias("quotas"))
    for _ in range(levels):
        nodes = nodes.select("node", "quotas", F.expr(_left_share(seed)).alias("left"))
        nodes = nodes.select(F.explode(F.expr("array(named_struct('node', 2 * node, 'quotas', left), named_struct('node', 2 * node + 1, 'quotas', zip_with(quotas, left, (a, b) -> a - b)))")).alias("child"))
        nodes = nodes.select("child.node", "child.quotas")
    return nodes.select((F.col("node") - (1 << levels)).cast("int").alias("shard"), F.posexplode("quotas").alias("sidx", "n"))


def _with_sources(rows: DataFrame, sources: DataFrame, count: int) -> DataFrame:
    """rows joined with their source's columns; a hot source is never gathered into one task."""
    sources = sources.withColumnRenamed("source", "_own_source")
    if count <= MOST_BROADCAST_SOURCES:
        return rows.join(F.broadcast(sources), F.col("source").eqNullSafe(F.col("_own_source"))).drop("_own_source")
    salted = sources.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    rows = rows.withColumn("_own_salt", F.pmod("h", F.lit(_SALTS)).cast("int"))
    return rows.join(salted, F.col("source").eqNullSafe(F.col("_own_source")) & (F.col("_own_salt") == F.col("_salt"))).drop("_own_source", "_salt", "_own_salt")


def mix(docs: DataFrame, *, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, block_words: int = 1 << 18, shards: int | None = None, seed: int = 7, carry: bool = False) -> DataFrame:
    """What a mix takes of each row of docs (doc_id, text, source; other columns are ignored).

    Returns one row for each input row: doc_id, source, size, source_size, target, taken (words, repeats counted)
    and draws, an array of struct(pass, shard, words) with an entry for each pass that takes words of the row.
    Within a pass a row gives all its words, except the one row at the end of its source's target. With carry,
    the input row comes too, as struct _row.
    """
    measured = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), *([F.struct("*").alias("_row")] if carry else []))
    measured = measured.withColumn("h", F.xxhash64(F.lit(seed), "source", "doc_id", "size"))
    rows = table(measured.drop("_row"))
    sources = table(source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, cap))
    count, words = sources.agg(F.count("*"), F.coalesce(F.sum("source_size"), F.lit(0))).head()
    shards = shards or max(LEAST_SHARDS, math.ceil(share * words / SHARD_WORDS))
    levels = math.ceil(math.log2(shards))
    sources = sources.withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("source_size") / block_words)).cast("long"))
    placed = lambda df: _with_sources(df, sources, count).withColumn("block", F.pmod(F.xxhash64(F.lit(seed + 1), "h"), F.col("blocks")))

    blocks = placed(rows).groupBy("sidx", "block", "source_size", "target").agg(F.sum("size").alias("words")).where("words > 0")
    passes = F.explode(F.sequence(F.lit(0), F.lit(math.ceil(cap) - 1)))
    blocks = blocks.withColumn("pass", passes).withColumn("need", F.least(F.round("target").cast("long") - F.col("pass") * F.col("source_size"), F.col("source_size"))).where("need > 0")
    blocks = blocks.withColumn("order", F.xxhash64(F.lit(seed + 2), "sidx", "block", "pass"))
    permuted = Window.partitionBy("sidx", "pass").orderBy("order", "block")
    blocks = blocks.withColumn("before", F.sum("words").over(permuted) - F.col("words")).withColumn("take", F.least("words", F.col("need") - F.col("before"))).where("take > 0")
    drawn = table(blocks.select("sidx", "block", "pass", "take", (F.row_number().over(Window.partitionBy("sidx").orderBy("pass", "order", "block")) - 1).alias("slot")))

    quotas = sources.select("sidx").join(drawn.groupBy("sidx").agg(F.count("*").alias("n")), "sidx", "left").select("sidx", F.coalesce("n", F.lit(0)).alias("n"))
    leaves = split_quotas(quotas, levels, seed).where("n > 0")
    leaves = leaves.withColumn("end", F.sum("n").over(Window.partitionBy("sidx").orderBy("shard")))
    leaves = leaves.select("sidx", "shard", F.explode(F.sequence(F.col("end") - F.col("n"), F.col("end") - 1)).alias("slot"))
    dealt = drawn.join(leaves, ["sidx", "slot"]).groupBy("sidx", "block").agg(F.sort_array(F.collect_list(F.struct("pass", "shard", "take"))).alias("draws"))

    inside = Window.partitionBy("sidx", "block").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    out = placed(measured if carry else rows).join(dealt, ["sidx", "block"], "left")
    out = out.withColumn("before", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    words = F.transform(F.coalesce("draws", F.array().cast("array<struct<pass:int,shard:int,take:bigint>>")), lambda d: F.struct(d["pass"].alias("pass"), d["shard"].alias("shard"), F.greatest(F.lit(0), F.least(F.col("size"), d["take"] - F.col("before"))).cast("long").alias("words")))
    out = out.withColumn("draws", F.filter(words, lambda d: d["words"] > 0))
    taken = F.aggregate("draws", F.lit(0).cast("long"), lambda a, d: a + d["words"])
    return out.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"), "draws", *(["_row"] if carry else []))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as whole documents, with the columns of docs: a row for each pass that takes half of its words or more, in shard order, shuffled within each shard."""
    plan = mix(docs, carry=True, **options)
    copies = plan.select("_row", "size", "doc_id", F.explode("draws").alias("d")).where("d.words * 2 >= size")
    spread = copies.withColumn("_order", F.xxhash64(F.lit(11), "doc_id", "size", "d.pass"))
    shards = (copies.agg(F.max("d.shard")).head()[0] or 0) + 1
    return spread.repartition(shards, F.col("d.shard")).sortWithinPartitions("d.shard", "_order").select("_row.*")
