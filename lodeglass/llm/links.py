"""From shared buckets to verified links to connected groups, for near-duplicate operators.

Members of a bucket are never paired off all at once. In the first round every member meets one other, that which stands before it in most of its
buckets. Verified pairs are joined into connected groups; a bucket whose members are all in one group is done. In the others, members of different
groups meet over four times the distance in each further round, or all at once where that makes no more than ``AT_ONCE``
pairs for each row of all buckets, until every two members of a bucket have been compared or are connected anyway. So no link is lost,
while a bucket full of copies of one thing is done after its first round.
An operator that knows terms of which every linked pair must share one has the members of open buckets dealt anew by these terms after the first
round, in which again each meets one other first; so members that share a bucket but can hold no link do not meet at all. Of the links found there, those of no common bucket are dropped.
Buckets of more than ``SPLIT`` members are dealt by a hash that changes with the round, so that no task holds an unbounded
one. What is open when the rounds have met all within a part is finished by fixed parts: every part meets every part of its bucket.

State between rounds is written to the shared folder. The driver sees counts only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodeglass.session import materialise

SPLIT = 5000
AT_ONCE = 1


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component`` (its smallest node) for every node of ``edges`` (a, b), by alternating stars.

    Each turn hangs the larger neighbours of every node, then its smaller ones, on the smallest; turns grow with the
    logarithm of a group's size. Aggregates are combined before shuffles and only edges travel.
    """

    def directed(rows: DataFrame) -> DataFrame:
        low, high = F.least("a", "b"), F.greatest("a", "b")
        return rows.where("a <> b").select(high.alias("a"), low.alias("b")).distinct()

    def stars(rows: DataFrame) -> bool:
        """Every node hangs on one other, which hangs on none."""
        twice = rows.groupBy("a").agg(F.count("*").alias("n")).where("n > 1").select("a")
        onward = rows.join(rows.select(F.col("b").alias("a")).distinct(), "a", "left_semi").select("a")
        return twice.unionByName(onward).isEmpty()

    current = directed(edges)
    while True:
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # written, so that the join below sees two plain shuffles and can split a hub
        least = materialise(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), "stars")
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = materialise(directed(large), "large")
        # a node has few smaller neighbours left
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        current = materialise(directed(small.unionByName(least.select("a", F.col("m").alias("b")))), "edges")
        if stars(current):
            break
    roots = current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)


def _shared(rows: DataFrame) -> DataFrame:
    """Rows of buckets with two members or more."""
    # dealt out once: both sides of the join read the same shuffle, for which they need the same columns
    dealt = rows.repartition("bucket")
    counts = dealt.groupBy("bucket").agg(F.count("*").alias("n"), F.max(F.xxhash64("node")).alias("_some"))
    counts = counts.where("n > 1 and _some is not null").select("bucket", "n")
    return materialise(dealt.join(counts.hint("shuffle_hash"), "bucket"), "members")


def _open(members: DataFrame, groups: DataFrame) -> DataFrame:
    """Rows (bucket, node, group, n) of buckets that hold members of more than one group."""
    own = members.drop("group").join(groups, "node", "left").select("bucket", "node", "n", F.coalesce("component", "node").alias("group"))
    own = materialise(own, "own")
    ends = own.groupBy("bucket").agg(F.min("group").alias("_low"), F.max("group").alias("_high")).where("_low < _high")
    return materialise(own.join(materialise(ends.select("bucket"), "open"), "bucket"), "members")


def _foremost(members: DataFrame, turn: int) -> DataFrame:
    """Pairs (a, b): for every member the one of another group that stands before it in most of its buckets, which are in order of groups."""
    salt = F.pmod(F.xxhash64("node", F.lit(turn)), F.ceil(F.col("n") / SPLIT))
    before = Window.partitionBy("bucket", "_salt").orderBy("group", "node")
    ahead = members.withColumn("_salt", salt).select(
        "group", "node", F.lag("group").over(before).alias("_group"), F.lag("node").over(before).alias("_node")
    )
    ends = ahead.where(F.col("_group") != F.col("group"))
    often = ends.groupBy("_node", "node").agg(F.count("*").alias("n"))
    most = often.groupBy("node").agg(F.max(F.struct("n", "_node"))["_node"].alias("_node"))
    return most.select(F.least("_node", "node").alias("a"), F.greatest("_node", "node").alias("b")).distinct()


def _met(members: DataFrame, back: int, turn: int) -> DataFrame:
    """Distinct pairs (a, b) of members of different groups with up to ``back`` places between them in their bucket."""
    salt = F.pmod(F.xxhash64("node", F.lit(turn)), F.ceil(F.col("n") / SPLIT))
    before = Window.partitionBy("bucket", "_salt").orderBy("node").rowsBetween(-back, -1)
    ahead = members.withColumn("_salt", salt).withColumn("_ahead", F.collect_list(F.struct("node", "group")).over(before))
    others = F.transform(F.filter("_ahead", lambda x: x["group"] != F.col("group")), lambda x: x["node"])
    return ahead.select(F.explode(others).alias("a"), F.col("node").alias("b")).distinct()


def _apart(members: DataFrame) -> tuple[DataFrame, int]:
    """The largest group of each bucket, and how many pairs of members of different groups the buckets hold in all."""
    sizes = members.groupBy("bucket", "group").agg(F.count("*").alias("m"))
    wide = F.col("m").cast("decimal(19,0)")
    buckets = sizes.groupBy("bucket").agg(
        F.max(F.struct("m", "group"))["group"].alias("_top"), F.sum(wide).alias("_all"), F.sum(wide * wide).alias("_same")
    )
    buckets = materialise(buckets, "apart")
    pairs = buckets.agg(F.sum((F.col("_all") * F.col("_all") - F.col("_same")) / 2)).first()[0]
    return buckets.select("bucket", "_top"), int(pairs or 0)


def _met_at_once(members: DataFrame, largest: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) of all members of different groups: those outside a bucket's largest group meet the others.

    A bucket is dealt into parts of about ``SPLIT`` members; a cell of the join holds one part on either side.
    """
    parts = F.ceil(F.col("n") / SPLIT).cast("int")
    own, every = F.pmod(F.xxhash64("node"), parts).cast("int"), F.explode(F.sequence(F.lit(0), parts - 1))
    few = members.join(largest, "bucket").where(F.col("group") != F.col("_top"))
    few = few.select("bucket", F.col("node").alias("_node"), F.col("group").alias("_group"), own.alias("_i"), every.alias("_j"))
    others = members.select("bucket", "node", "group", own.alias("_j"), every.alias("_i"))
    both = few.join(others, ["bucket", "_i", "_j"]).where(F.col("group") != F.col("_group"))
    return both.select(F.least("node", "_node").alias("a"), F.greatest("node", "_node").alias("b")).distinct()


def _by_terms(members: DataFrame, bodies: DataFrame, terms_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Rows (bucket, node, group, n) of the members' terms that stand in more than one group."""
    nodes = materialise(members.select("node", "group").distinct(), "nodes")
    rows = terms_of(bodies.join(nodes, "node", "left_semi")).select("node", F.col("term").alias("bucket")).join(nodes, "node")
    rows = materialise(rows, "terms")
    sizes = rows.groupBy("bucket").agg(F.count("*").alias("n"), F.min("group").alias("_low"), F.max("group").alias("_high"))
    sizes = materialise(sizes.where("_low < _high").select("bucket", "n"), "open")
    return materialise(rows.join(sizes, "bucket"), "members")


def _sharing(links: DataFrame, members: DataFrame) -> DataFrame:
    """Links (a, b) whose nodes share a bucket."""
    first, second = members.select(F.col("node").alias("a"), "bucket"), members.select(F.col("node").alias("b"), "bucket")
    return links.join(first, "a").join(second, ["b", "bucket"], "left_semi").select("a", "b").distinct()


def connect(
    rows: DataFrame,
    bodies_of: Callable[[DataFrame], DataFrame],
    holds: Callable[[Column, Column], Column],
    terms_of: Callable[[DataFrame], DataFrame] | None = None,
    fits: Callable[[Column, Column], Column] | None = None,
) -> DataFrame:
    """``node`` and ``component`` of all nodes that are linked to another.

    ``rows`` (bucket, node) must be distinct. ``bodies_of`` gets the nodes that share a bucket with another and returns (node, body), one
    row per node; ``holds`` tests two bodies. ``terms_of`` gets such rows and returns distinct (node, term), term a long: any two of the nodes whose
    bodies hold must share a term. ``fits`` tests the lengths of two bodies, which must pass where the bodies hold; it spares others the joins of texts.
    """
    members = _shared(rows)
    bodies = materialise(bodies_of(materialise(members.select("node").distinct(), "nodes")), "bodies")

    sizes = materialise(bodies.select("node", F.length("body").alias("size")), "sizes") if fits else None

    def verify(pairs: DataFrame) -> DataFrame:
        if sizes is not None:
            pairs = pairs.join(sizes.select(F.col("node").alias("a"), F.col("size").alias("_x")), "a")
            pairs = pairs.join(sizes.select(F.col("node").alias("b"), F.col("size").alias("_y")), "b")
            pairs = pairs.where(fits(F.col("_x"), F.col("_y"))).select("a", "b")
        first = bodies.select(F.col("node").alias("a"), F.col("body").alias("_x"))
        second = bodies.select(F.col("node").alias("b"), F.col("body").alias("_y"))
        both = pairs.join(first, "a").join(second, "b")
        return both.where(holds(F.col("_x"), F.col("_y"))).select("a", "b")

    of_node = members.schema["node"].dataType.simpleString()
    groups = rows.sparkSession.createDataFrame([], f"node {of_node}, component {of_node}")
    left = members.withColumn("group", F.col("node"))
    compared: DataFrame | None = None
    back, turn, met = 1, 0, 0
    affordable = AT_ONCE * members.count()
    while widest := left.agg(F.max("n")).first()[0]:
        alone = turn <= bool(terms_of)  # once in the buckets, once in the terms
        largest, apart = (None, 0) if alone else _apart(left)
        last = not alone and (apart <= affordable or widest > SPLIT and met >= SPLIT - 1)
        pairs = _foremost(left, turn) if alone else _met_at_once(left, largest) if last else _met(left, back, turn)
        pairs = materialise(pairs if compared is None else pairs.join(compared, ["a", "b"], "left_anti"), "pairs")
        fresh = pairs.count()
        if fresh:
            found = verify(pairs)
            if turn and terms_of:
                found = _sharing(materialise(found, "held"), members)
            found = materialise(found, "links")
            compared = pairs if compared is None else compared.unionByName(pairs)
            if found.count():
                edges = groups.select(F.col("node").alias("a"), F.col("component").alias("b"))
                groups = materialise(components(edges.unionByName(found.select("a", "b"))), "groups")
        if last or not alone and widest <= SPLIT and back >= widest - 1:
            break  # every two members of every open bucket have met
        left = _open(left, groups)
        if terms_of and not turn:
            left = _by_terms(left, bodies, terms_of)
        back, turn, met = min(back * 4, widest), turn + 1, back
    return groups
