"""Links from buckets, and connected components by distributed union-find. DataFrame operations only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandspark.llm.common import drop_stored, stored

#: By how much the number of a bucket's leaders grows from round to round.
MORE_LEADERS = 16
#: Edges that a task of the union-find writes at least, so that a small graph makes few files.
EDGES_A_TASK = 1 << 16


def bucket_links(members: DataFrame, least: float, prepare: Callable[[DataFrame], Callable[[DataFrame], DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """(verified links, components): links (a, b), b the smaller id, between members (bucket, id, size) of the same
    bucket, enough of them to connect all members that are connected; and (id, component) of the ids that have links.

    In rounds: a bucket is dealt into 1, 16, 256, ... parts, and the most popular member of each part is a leader: that whose
    buckets hold most members in all, as does a text from which many others were made by small changes.
    Each leader is verified against all members of its bucket that are not known to be of its component, joined or not, so it is
    done and leaves the bucket; all others stay. After each round the components take in its links. It ends when
    no bucket holds members of two components: then each two members of a bucket were verified or are of one component. So
    a bucket of similar members, however large, takes one pass, and dissimilar ones take more, but none is cut short.

    least: pairs whose smaller size is less than this part of the larger can't hold, and aren't verified.
    prepare: takes the ids that share a bucket with another and returns a function from distinct pairs (a, b) to those that hold.
    If that has traits (id, columns ...) and may_hold, which takes two prefixes of such columns, pairs for which it is false are known
    not to hold. From the second round on, when dissimilar groups meet, they leave within the join and make no rows. traits may be a
    function of the ids that are left after the first round.
    If it has exact, that verifies pairs for which may_hold is true."""
    # dealt by bucket once; no member is twice in a bucket
    every = members.select("bucket", "id", "size", F.count("*").over(Window.partitionBy("bucket")).alias("n"))
    rest = stored(every.filter("n > 1"), "members")
    ids = stored(rest.groupBy("id").agg(F.sum("n").alias("popular")), "popular")
    verify = prepare(ids.select("id"))
    traits, may_hold, exact = getattr(verify, "traits", None), getattr(verify, "may_hold", None), getattr(verify, "exact", verify)
    before, rest = rest, stored(rest.join(ids, "id").select("bucket", "id", "size", "popular", F.col("id").alias("component")), "members")
    drop_stored(before)
    links = known = tested = None
    bound = F.least("size", "its") >= least * F.greatest("size", "its") - 1e-6
    parts = 1
    while parts == 1 or not rest.isEmpty():
        rank = F.xxhash64("id", F.lit(parts))
        first = F.min(F.struct((-F.col("popular")).alias("p"), rank.alias("r"), F.col("id").alias("leader"), F.col("component").alias("side"), F.col("size").alias("its"))).alias("m")
        leaders = stored(rest.groupBy("bucket", F.pmod(rank, F.lit(parts)).alias("part")).agg(first).select("bucket", "m.leader", "m.side", "m.its"), "leaders")
        apart = (F.col("component") != F.col("side")) & bound
        if callable(traits) and parts > 1:
            traits = traits(rest.select("id").distinct())
        if traits is None or parts == 1:
            met = rest.join(leaders, "bucket").filter(apart)
        else:
            with_traits = lambda df, c, to: df.join(traits.select(F.col("id").alias(c), *(F.coalesce(F.col(x), F.lit(0).cast("long")).alias(f"{to}_{x}") for x in traits.columns if x != "id")), c)
            met = with_traits(rest, "id", "own").join(with_traits(leaders, "leader", "led"), "bucket").filter(apart & may_hold("own_", "led_"))
        asked = met.select(F.greatest("id", "leader").alias("a"), F.least("id", "leader").alias("b")).distinct()
        asked = stored(asked if tested is None else asked.join(tested, ["a", "b"], "left_anti"), "asked")
        tested = asked if tested is None else tested.unionByName(asked)
        new = stored((verify if traits is None or parts == 1 else exact)(asked), "links")
        links = new if links is None else links.unionByName(new)
        if known is None:
            known = components(new)
        elif not new.isEmpty():
            known = merged(known, new)
        side = known.select("id", F.col("component").alias("now"))
        left = rest.join(leaders.select("bucket", F.col("leader").alias("id")), ["bucket", "id"], "left_anti").select("bucket", "id", "size", "popular")
        left = stored(left.join(side, "id", "left").select("bucket", "id", "size", "popular", F.coalesce("now", "id").alias("component")), "open")
        open_ = left.groupBy("bucket").agg(F.min("component").alias("c"), F.max("component").alias("d")).filter("c <> d").select("bucket")
        before, rest, parts = rest, stored(left.join(open_, "bucket").select("bucket", "id", "size", "popular", "component"), "members"), parts * MORE_LEADERS
        for x in (before, left, leaders):
            drop_stored(x)
    return links, known


def merged(known: DataFrame, links: DataFrame) -> DataFrame:
    """(id, component) with further links (a, b): the components themselves are joined, so that the large ones count as one."""
    of = lambda c, to: known.select(F.col("id").alias(c), F.col("component").alias(to))
    ends = stored(links.join(of("a", "ca"), "a", "left").join(of("b", "cb"), "b", "left").select("a", "b", F.coalesce("ca", "a").alias("ca"), F.coalesce("cb", "b").alias("cb")), "ends")
    up = components(ends.select(F.col("ca").alias("a"), F.col("cb").alias("b"))).select(F.col("id").alias("component"), F.col("component").alias("now"))
    fresh = ends.select(F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("ca").alias("component")), F.struct(F.col("b").alias("id"), F.col("cb").alias("component")))).alias("e")).select("e.*")
    every = known.unionByName(fresh).distinct()
    return stored(every.join(up, "component", "left").select("id", F.coalesce("now", "component").alias("component")), "components")


def components(links: DataFrame) -> DataFrame:
    """(id, component) for every id in links (a, b): the smallest id that it is connected to.

    Alternates large-star and small-star steps, each a minimum per node and a join, until nothing changes:
    a number of rounds that grows with the logarithm of a component's size. Lineage is cut by tables."""
    edges = stored(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    mark = lambda df: df.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0)).alias("x")).first()
    before = mark(edges)
    while before.n:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").filter("a <> b").distinct()
        drop, edges = edges, stored(small.coalesce(1 + before.n // EDGES_A_TASK), "edges")
        drop_stored(drop)
        after = mark(edges)
        if after == before:
            break
        before = after
    nodes = edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return stored(nodes.unionByName(edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()), "components")
