"""Links between members of shared buckets, without listing a large bucket's pairs.

Buckets of up to ``SMALL`` members test all their pairs, which are at most so many times their members.

Larger ones come to rounds of stars: each tests its members against one of them. Links found are contracted
to roots at once, so that a round works on the buckets that still hold two roots and on new edges between roots only.
Large groups become one component in this way. Rounds end when stars find few links. Nodes that then still share a
large bucket with another root are searched by finer keys. The caller deals each of them
under its rarest items, so that two linked nodes meet in some finer bucket, whatever the
size of the first one. Where finer buckets have many pairs, they too are contracted by stars; then their pairs of
two roots are listed in growing slices of the owners. Of many pairs in a slice, each node's with the most buckets in
common are tested first, and what they link is contracted before the others of two roots are tested and before the next
slice is listed. Where a slice has few pairs, all other owners make one slice. What several tests link is made one
map before the members are moved by it. Nothing caps the sizes of buckets or the number of pairs, and how many rounds of stars there are
doesn't change the result.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import together, written
from .components import components

#: Members up to which a bucket tests all pairs.
SMALL = 8
#: A round of stars is followed by another one if it finds a link for so many members.
FEW = 10
#: Pairs for each member up to which finer buckets are tested without stars, and a slice's pairs all at once.
PAIRS = 4
#: Where the slices of owners end, in sixteenths.
SLICES = (1, 4, 16)
#: Members of a finer bucket that one task lists as candidates of the others.
BLOCK = 500
#: Pairs of one node that one task tests.
SHARE = 2000
#: Links up to which the map of their roots is sent to all tasks.
SENT = 5_000
#: What a test returns of each linked pair.
LINK = "a binary, b binary, root_a binary, root_b binary"


def short_of(node: str) -> Column:
    """Eight bytes for a node of sixteen, while all buckets are shuffled: xxHash64 with seed 42. Two nodes may have one."""
    return F.xxhash64(node)


def crowded(listed: DataFrame) -> DataFrame:
    """band, short of the members of buckets with two of them or more; ``listed`` has band, short. Each row is shuffled once."""
    # said at once, so that Spark doesn't infer it for one use alone and shuffle the rows again for the other
    dealt = listed.where("band is not null and short is not null").repartition("band")
    sizes = dealt.groupBy("band").agg(F.min("short").alias("lo"), F.max("short").alias("hi"))
    # no semi-join, which Spark would push below the shuffle: then each use would have a shuffle of its own
    return dealt.join(sizes.where("lo != hi").select("band"), "band")


def _open(members: DataFrame) -> DataFrame:
    """The members of buckets that hold two roots."""
    apart = members.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo != hi")
    return members.join(apart.select("band"), "band", "left_semi")


def _star(members: DataFrame, k: int) -> DataFrame:
    """a, b and their roots: each bucket's members with the node of least hash, another one for another ``k``."""
    turn = F.struct(F.xxhash64("node", F.lit(k)).alias("turn"), "node", "root")
    pivots = members.groupBy("band").agg(F.min(turn).alias("p"), F.min("root").alias("lo"), F.max("root").alias("hi"))
    with_pivot = members.join(pivots.where("lo != hi").select("band", "p"), "band").where(F.col("root") != F.col("p.root"))
    return with_pivot.select(F.col("p.node").alias("a"), F.col("node").alias("b"), F.col("p.root").alias("root_a"), F.col("root").alias("root_b")).distinct()


def _all_pairs(members: DataFrame) -> DataFrame:
    """a, b and their roots: all pairs of each bucket."""
    pairs = members.alias("x").join(members.alias("y"), (F.col("x.band") == F.col("y.band")) & (F.col("x.node") < F.col("y.node")) & (F.col("x.root") != F.col("y.root")))
    return pairs.select(F.col("x.node").alias("a"), F.col("y.node").alias("b"), F.col("x.root").alias("root_a"), F.col("y.root").alias("root_b")).distinct()


def _cross(finer: DataFrame, condition: str, lo: int, hi: int) -> DataFrame:
    """a, b, their roots, n: pairs of a finer bucket's owners and seekers of two roots, n of the buckets that they share.

    Owners are those of the slice from ``lo`` to ``hi``; a bucket's are dealt into blocks.
    """
    slot = F.pmod(F.xxhash64("node", F.lit("slice")), F.lit(SLICES[-1]))
    owners, seekers = finer.where("owner").where((slot >= lo) & (slot < hi)), finer.where("seeker")
    sizes = owners.groupBy("band").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    dealt = owners.join(sizes, "band").withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    spread = seekers.join(sizes, "band").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    on = (F.col("x.band") == F.col("y.band")) & (F.col("x.block") == F.col("y.block")) & (F.col("x.root") != F.col("y.root")) & F.expr(condition)
    pair = lambda a, b: F.struct(F.col(f"{a}.node").alias("a"), F.col(f"{b}.node").alias("b"), F.col(f"{a}.root").alias("root_a"), F.col(f"{b}.root").alias("root_b"))
    pairs = dealt.alias("x").join(spread.alias("y"), on).select(F.when(F.col("x.node") < F.col("y.node"), pair("x", "y")).otherwise(pair("y", "x")).alias("p"))
    return pairs.groupBy("p").agg(F.count("*").alias("n")).select("p.*", "n")


def _best(listed: DataFrame) -> DataFrame:
    """For each node, its pair of most shared buckets."""
    order = F.struct((-F.col("n")).alias("n"), F.xxhash64("a", "b").alias("turn"), "a", "b", "root_a", "root_b")
    sides = listed.select(F.explode(F.array("a", "b")).alias("node"), order.alias("p"))
    return sides.groupBy("node").agg(F.min("p").alias("p")).select("p.a", "p.b", "p.root_a", "p.root_b").distinct()


def _tops(linked: DataFrame, found: int) -> DataFrame:
    """root, top: what becomes of the roots that have one of the ``found`` links."""
    tops = components(linked.select("root_a", "root_b"), found).select(F.col("node").alias("root"), F.col("root").alias("top"))
    return F.broadcast(tops) if found <= SENT else tops


def _chained(steps: list[tuple[DataFrame, int]]) -> DataFrame:
    """root, top: where all steps lead together, each a map of roots with its number of links. A later step's roots are tops of an earlier one, or had no link before."""
    if len(steps) == 1:
        return steps[0][0]
    links = sum(found for _, found in steps)
    out = together(reduce(DataFrame.union, [tops.select("root") for tops, _ in steps]), 2 * links).distinct().withColumn("top", F.col("root"))
    for tops, _ in steps:
        out = _moved(out, tops, "top")
    out = written(out.select("root", "top"), "tops", 2 * links)
    return F.broadcast(out) if links <= SENT else out


def _moved(rows: DataFrame, tops: DataFrame, root: str = "root") -> DataFrame:
    named = tops.select(F.col("root").alias(root), F.col("top").alias("_top"))
    return rows.join(named, root, "left").withColumn(root, F.coalesce("_top", root)).drop("_top")


def _searched(fine: DataFrame, condition: str, test: Callable[[DataFrame], DataFrame], size: int) -> list[tuple[DataFrame, int]]:
    """The steps (root, top) by which all links between the roots of finer buckets, of ``size`` members, are contracted."""
    steps, lo, ends = [], 0, list(SLICES)
    while ends:
        hi = ends.pop(0)
        listed, here, pays = written(_cross(fine, condition, lo, hi), "pairs", PAIRS * size), [], True
        left = listed.count()
        if left * SLICES[-1] <= 2 * PAIRS * size * (hi - lo):
            ends = ends[-1:]
        while left:
            some = pays and left > PAIRS * size
            asked = written(_best(listed), "asked", left) if some else listed.drop("n")
            linked = written(test(asked), "links", left)
            if found := linked.count():
                here.append((_tops(linked, found), found))
            if not some:
                break
            listed = listed.join(asked.select("a", "b"), ["a", "b"], "left_anti")
            if found:
                listed = _moved(_moved(listed, here[-1][0], "root_a"), here[-1][0], "root_b").where("root_a != root_b")
            listed = written(listed.select("a", "b", "root_a", "root_b", "n"), "pairs", left)
            pays, left = FEW * found >= asked.count(), listed.count()
        if ends and here:
            here = [(_chained(here), sum(found for _, found in here))]
            fine = written(_moved(fine, here[0][0]), "members", size)
        steps, lo = steps + here, hi
    return steps


def _contracted(members: DataFrame, linked: DataFrame, size: int, found: int) -> tuple[DataFrame, DataFrame]:
    """The members (``size``), with new roots; root, top: what became of the roots that have one of the ``found`` links.

    Where links are many, only buckets still open are kept. The others' members find nothing more, but do no harm.
    """
    tops = _tops(linked, found)
    moved = _moved(members, tops)
    return written(moved if FEW * found < size else _open(moved), "members", size), tops


def _crowd(finer: DataFrame) -> tuple[int, int]:
    """Members of finer buckets, and the most pairs that they can have."""
    by = finer.groupBy("band").agg(F.count("*").alias("n"), (F.count_if("owner") * F.count_if("seeker")).alias("pairs"))
    row = by.agg(F.sum("n"), F.sum("pairs")).first()
    return row[0] or 0, row[1] or 0


def linked_roots(members: DataFrame, test: Callable[[DataFrame], DataFrame], finer: Callable[[DataFrame], DataFrame], condition: str = "true") -> DataFrame:
    """node, root for each node of ``members`` (band, node) that is linked with another one.

    ``test`` takes pairs (a, b and further columns) and returns those that are linked. ``finer`` takes node, root and
    returns band, node,
    root, owner, seeker and columns of its own: some owner and some seeker of a bucket are the two nodes of each link
    that is still to be found, and ``condition`` holds between the two as x and y.
    """
    sizes = members.groupBy("band").agg((F.count("*") > SMALL).alias("large"))
    sized = written(members.join(sizes, "band").withColumn("root", F.col("node")), "members")
    now, steps, rounds = sized.where("large").drop("large"), [], 0
    while True:
        pairs, size = _star(now, rounds), now.count()
        # a star has a pair for each member at most
        most = size
        if rounds == 0:
            pairs, most = pairs.union(_all_pairs(sized.where("not large"))).distinct(), None
        linked = written(test(pairs), "links", most)
        rounds, found = rounds + 1, linked.count()
        if found:
            now, tops = _contracted(now, linked, size, found)
            steps.append((tops, found))
        if not found or FEW * found < size:
            break
    rest = written(now.select("node", "root").distinct(), "open", size)
    if not rest.isEmpty():
        fine = written(_open(finer(rest)), "finer")
        while True:
            size, pairs = _crowd(fine)
            if pairs <= PAIRS * size:
                break
            linked = written(test(_star(fine, rounds)), "links", size)
            rounds, found = rounds + 1, linked.count()
            if found:
                fine, tops = _contracted(fine, linked, size, found)
                steps.append((tops, found))
            if FEW * found < size:
                break
        if pairs:
            steps += _searched(fine, condition, test, size)
    if not steps:
        return members.select("node", F.col("node").alias("root")).limit(0)
    return _chained(steps).select(F.col("root").alias("node"), F.col("top").alias("root"))


def paired(pairs: DataFrame, values: DataFrame) -> DataFrame:
    """``pairs`` (a, b, root_a, root_b) with each other column of ``values`` (node, ...) as <name>_a and <name>_b, a node's pairs together.

    The pairs of a node that has many are dealt into shares, each of which gets its own copy of that node's values.
    """
    named = [c for c in values.columns if c != "node"]
    left, right = (values.select(F.col("node").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in named]) for x in "ab")
    shares = pairs.groupBy("a").agg(F.ceil(F.count("*") / SHARE).cast("int").alias("shares"))
    copies = left.join(shares, "a").withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))
    dealt = pairs.join(shares, "a").withColumn("share", F.pmod(F.xxhash64("b"), "shares").cast("int")).drop("shares")
    return dealt.join(right, "b").join(copies.drop("shares"), ["a", "share"])
