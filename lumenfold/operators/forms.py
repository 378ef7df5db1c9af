"""Forms: adapters by page address, dependency depth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import url_pattern
from ..sources.stored import dropped, stored
from ..sources.tables import constants

# Adapters of which status win.
STATUS_RANK = {"active": 3, "testing": 2, "draft": 1}


def select_adapters(pages: DataFrame, patterns: DataFrame) -> DataFrame:
    """pages: (page_id, url); patterns: (slug, status, pattern), rows of constants. The adapter of each page that has one: page_id, slug, specificity.

    The better status wins, then the longer matching pattern (less ten for each wildcard), then the slug. The
    patterns become expressions of a projection, so pages are neither joined nor shuffled.
    """
    found = []
    for r in constants(patterns):
        if r["status"] in STATUS_RANK:
            length, wild = len(r["pattern"]), r["pattern"].count("*")
            hit = F.col("url").rlike(url_pattern(r["pattern"]))
            found.append(F.when(hit, F.struct(F.lit(-STATUS_RANK[r["status"]]).alias("s"), F.lit(r["slug"]).alias("slug"), F.lit(length).alias("length"), F.lit(length - 10 * wild).alias("specificity"))))
    hits = F.array_compact(F.array(*found))
    # an adapter counts with its longest matching pattern
    longest = F.filter(hits, lambda x: ~F.exists(hits, lambda y: (y["slug"] == x["slug"]) & (y["length"] > x["length"])))
    best = F.array_min(F.transform(longest, lambda x: F.struct(x["s"].alias("s"), (-x["specificity"]).alias("p"), x["slug"].alias("slug"))))
    return pages.select("page_id", "url", best.alias("b")).where("b is not null").select("page_id", F.col("b.slug").alias("slug"), (-F.col("b.p")).alias("specificity"))


def _jumped(chain: DataFrame) -> DataFrame:
    """chain: (slug, key, at, steps, root), at being the node that steps lead to, null beyond the root. One doubling: every pointer follows that of the node it points at."""
    ahead = chain.select("slug", F.col("key").alias("at"), F.col("at").alias("_at"), F.col("steps").alias("_steps"), F.col("root").alias("_root"))
    going = chain.where("at is not null").join(ahead.hint("shuffle_merge"), ["slug", "at"])
    going = going.select("slug", "key", F.col("_at").alias("at"), (F.col("steps") + F.col("_steps")).alias("steps"), F.col("_root").alias("root"))
    return chain.where("at is null").unionByName(going)


def _walked(parents: DataFrame, most: int) -> DataFrame:
    """parents: (slug, key, up: an existing key or null). (slug, key, at, steps, root): the steps to the root, or with at the node after at least `most` steps, where there is none.

    Pointers double their reach in each round, so a chain of n fields takes the logarithm of n rounds, each an
    equi-join of the fields with themselves; a field that many depend on is one row on one side.
    """
    one = F.when(F.col("up").isNull(), 0).otherwise(1).cast("long")
    chain, reach = stored(parents.select("slug", "key", F.col("up").alias("at"), one.alias("steps"), F.when(F.col("up").isNull(), F.col("key")).alias("root"))), 1
    while reach < most and not chain.where("at is not null").isEmpty():
        before, chain, reach = chain, stored(_jumped(chain)), 2 * reach
        dropped(before)
    return chain


def dependency_depths(fields: DataFrame) -> DataFrame:
    """fields: (slug, key, depends_on). (slug, key, depth): how many fields each one depends on, one after the other.

    A parent that is missing ends the chain. Fields that depend on each other in a cycle have all others of the cycle
    before them, and those that lead into a cycle come after all of it. Of several rows with one slug and key the greatest
    depends_on holds. Chains may be of any length; slugs may be null.
    """
    slug = F.coalesce("slug", F.lit(""))
    rows = fields.groupBy("slug", "key").agg(F.max("depends_on").alias("up")).where("key is not null")
    rows = rows.select(F.struct(F.isnull("slug").alias("none"), slug.alias("slug")).alias("slug"), "key", "up")
    known = rows.select("slug", F.col("key").alias("up"), F.lit(True).alias("known"))
    parents = stored(rows.join(known.hint("shuffle_merge"), ["slug", "up"], "left").select("slug", "key", F.when(F.col("known"), F.col("up")).alias("up")))
    most = parents.groupBy("slug").count().agg(F.max("count")).head()[0] or 1
    chain = _walked(parents, most)
    depths, made = chain.where("at is null").select("slug", "key", "steps"), [parents, chain]
    if not chain.where("at is not null").isEmpty():
        # after as many steps as there are fields every pointer stands on a cycle, and every field of one is pointed at
        rings = stored(chain.where("at is not null").select("slug", F.col("at").alias("key")).distinct())
        open_ = parents.join(chain.where("at is not null").select("slug", "key").hint("shuffle_merge"), ["slug", "key"])
        # a ring is cut before its least field: that field is as many steps from the root as the ring has others
        least = _ring_least(parents.join(rings.hint("shuffle_merge"), ["slug", "key"]), most)
        size = least.groupBy("slug", "least").agg(F.count("*").alias("size"))
        sizes = stored(least.join(size.hint("shuffle_merge"), ["slug", "least"]).select("slug", "key", "size"))
        # from outside, the chain leads to its first field on the ring
        cut = open_.join(sizes.hint("shuffle_merge"), ["slug", "key"], "left").select("slug", "key", F.when(F.col("size").isNull(), F.col("up")).alias("up"))
        outside = _walked(cut, most + 1)
        ended = outside.select("slug", "key", "root", F.col("steps").alias("s")).join(sizes.select("slug", F.col("key").alias("root"), "size").hint("shuffle_merge"), ["slug", "root"])
        depths = depths.unionByName(ended.select("slug", "key", (F.col("s") + F.col("size") - 1).alias("steps")))
        made += [rings, least, sizes, outside]
    found = stored(depths.select(F.when(~F.col("slug.none"), F.col("slug.slug")).alias("slug"), "key", F.col("steps").cast("int").alias("depth")))
    dropped(*made)
    return found


def _ring_least(ring: DataFrame, most: int) -> DataFrame:
    """ring: (slug, key, up) of fields on cycles. (slug, key, least): the least field of each one's cycle."""
    chain, reach = stored(ring.select("slug", "key", F.col("up").alias("at"), F.least("key", "up").alias("least"))), 1
    while reach < most:
        ahead = chain.select("slug", F.col("key").alias("at"), F.col("at").alias("_at"), F.col("least").alias("_least"))
        before, chain = chain, stored(chain.join(ahead.hint("shuffle_merge"), ["slug", "at"]).select("slug", "key", F.col("_at").alias("at"), F.least("least", "_least").alias("least")))
        done = chain.select("slug", "key", "least").exceptAll(before.select("slug", "key", "least")).isEmpty()
        dropped(before)
        reach *= 2
        if done:
            break
    return chain
