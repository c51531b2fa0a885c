"""Graph operators over edges (a, b), "a calls b": closures, propagation, cycles, centrality, communities.

Loops run on the driver over DataFrames; each step is written to the folder
that spark.checkpoint.dir names, so lineage stays short and a lost executor
costs one step. Loops end at a published bound or when nothing changes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.centrality import MOST_LINKS, MOST_NODES, pairs_by_matrix, pairs_by_sources
from tidemark.operators.components import components
from tidemark.operators.definitions import MOST_DEFINITIONS, definitions_by_bits
from tidemark.operators.definitions import MOST_LINKS as MOST_FLOW
from tidemark.operators.running import running
from tidemark.scratch import materialize

#: Hops along edges between two steps that are written.
HOPS = 3


def step(df: DataFrame) -> DataFrame:
    """Write one step of a loop to the shared folder and read it back."""
    return materialize(df, "graph")


def settle(values: DataFrame, links: DataFrame, passed: Callable[[Column], Column], best: Callable[[Column], Column]) -> DataFrame:
    """(id, v) at rest: along each of ``links`` (a, b), b gets ``passed`` of a's value, and each node keeps the ``best`` (F.min or F.max) of what it has had.

    ``values``: id, v; nodes that get a value later are added. Each hop is one
    join and one partially aggregated shuffle; the number of hops is that of
    the longest stretch along which values improve.
    """
    now = step(values.select("id", "v").groupBy("id").agg(best("v").alias("v")))
    while True:
        moving = now.select("id", "v", F.col("v").alias("old"))
        for _ in range(HOPS):
            sent = links.join(moving, F.col("a") == F.col("id")).select(F.col("b").alias("id"), passed(F.col("v")).alias("v"), F.lit(None).cast(moving.schema["v"].dataType).alias("old"))
            moving = moving.unionByName(sent).groupBy("id").agg(best("v").alias("v"), F.max("old").alias("old"))
        settled = step(moving.select("id", "v", (~F.col("v").eqNullSafe(F.col("old"))).alias("moved")))
        now = settled.select("id", "v")
        if not settled.agg(F.coalesce(F.bool_or("moved"), F.lit(False))).first()[0]:
            return now


def reachable(start: DataFrame, links: DataFrame) -> DataFrame:
    """(id) of ``start`` (id) and all that it reaches along ``links`` (a, b)."""
    return settle(start.select("id", F.lit(0).alias("v")), links, lambda v: v, F.min).select("id")


def closure(edges: DataFrame, depth: int | None, inclusive: bool = True) -> DataFrame:
    """(source, target, hops) of everything reached in up to ``depth`` hops (None: any number), at its least distance; a node reaches itself only through a cycle.

    With ``inclusive`` False, nodes at exactly ``depth`` hops are left out. The
    result has a row for each pair, so an unbounded depth is for small graphs.
    """
    last = depth if inclusive or depth is None else depth - 1
    links = edges.select("a", "b").distinct()
    reached = step(links.select(F.col("a").alias("source"), F.col("b").alias("target"), F.lit(1).alias("hops")).where(F.lit(last is None or last >= 1)))
    frontier, hops = reached, 1
    while last is None or hops < last:
        hops += 1
        following = frontier.join(links, F.col("target") == F.col("a")).select("source", F.col("b").alias("target")).distinct()
        frontier = step(following.join(reached.select("source", "target"), ["source", "target"], "left_anti").withColumn("hops", F.lit(hops)))
        if frontier.isEmpty():
            break
        reached = reached.unionByName(frontier)
    return reached


def reversed_edges(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("b").alias("a"), F.col("a").alias("b"))


def nodes_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("a").alias("id")).union(edges.select("b")).distinct()


def entry_points(edges: DataFrame) -> DataFrame:
    """(id) of nodes that nothing calls."""
    return nodes_of(edges).join(edges.select(F.col("b").alias("id")), "id", "left_anti")


def depth_from(entries: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, depth): least hops from any of ``entries`` (id), which have 0."""
    links = step(edges.select("a", "b").distinct())
    return settle(entries.select("id", F.lit(0).alias("v")), links, lambda v: v + 1, F.min).withColumnRenamed("v", "depth")


def strong_components(edges: DataFrame) -> DataFrame:
    """(id, component): nodes that reach each other share the smallest id among them; every node is in one.

    Forward colours and backward search (Orzan, 2004). Nodes that nothing calls
    or that call nothing are alone and go first. Of the rest, each takes the
    smallest id that reaches it as its colour; those of a colour that reach the
    node of that id are its component. Edges of settled nodes and between
    colours go, and so on until none is left. No pairs of nodes are made.
    """
    nodes = step(nodes_of(edges))
    links = step(edges.where("a <> b").select("a", "b").distinct())
    size, found = links.count(), None
    while size:
        inner = step(links.join(links.select(F.col("b").alias("a")), "a", "left_semi").join(links.select(F.col("a").alias("b")), "b", "left_semi").select("a", "b"))
        left = inner.count()
        links, size, shrunk = inner, left, left < 0.9 * size
        if shrunk or not size:
            continue
        colours = settle(nodes_of(links).select("id", F.col("id").alias("v")), links, lambda v: v, F.min)
        of = colours.withColumnRenamed("v", "colour")
        own = step(links.join(of.select(F.col("id").alias("a"), F.col("colour").alias("ca")), "a").join(of.select(F.col("id").alias("b"), F.col("colour").alias("cb")), "b").where("ca = cb").select("a", "b"))
        roots = of.where("id = colour").select("id", F.col("id").alias("v"))
        reach = settle(roots, reversed_edges(own), lambda v: v, F.min)
        settled = reach.select("id", F.col("v").alias("component"))
        found = settled if found is None else found.unionByName(settled)
        links = step(own.join(settled.select(F.col("id").alias("a")), "a", "left_anti").join(settled.select(F.col("id").alias("b")), "b", "left_anti"))
        size = links.count()
    if found is None:
        return nodes.select("id", F.col("id").alias("component"))
    return step(nodes.join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component")))


def condensed(edges: DataFrame, owner: DataFrame) -> DataFrame:
    """(ca, cb), the links between components ``owner`` (id, component)."""
    between = edges.select("a", "b").distinct().join(owner.select(F.col("id").alias("a"), F.col("component").alias("ca")), "a").join(owner.select(F.col("id").alias("b"), F.col("component").alias("cb")), "b")
    return step(between.where("ca <> cb").select("ca", "cb").distinct())


def _ancestors(links: DataFrame) -> DataFrame:
    """(c, above): all pairs along acyclic links (ca, cb); known stretches are joined end to end, so a chain of n takes log2(n) steps."""
    known = step(links.select(F.col("cb").alias("c"), F.col("ca").alias("above")).distinct())
    size = None
    while (now := known.count()) != size:
        size = now
        further = known.alias("x").join(known.alias("y"), F.col("x.above") == F.col("y.c")).select("x.c", "y.above")
        known = step(known.unionByName(further).distinct())
    return known


def blast_radius(edges: DataFrame) -> DataFrame:
    """(id, radius): how many nodes reach a node, itself included; exact.

    Components count as one node of their size. What the largest one reaches
    has that one and all that leads to it above it, and only what else is above
    is listed pair by pair; so are pairs among what it does not reach.
    """
    owner = step(strong_components(edges))
    sizes = step(owner.groupBy(F.col("component").alias("c")).agg(F.count(F.lit(1)).alias("size")))
    links = condensed(edges, owner)
    core = sizes.orderBy(F.col("size").desc(), "c").limit(1).select(F.col("c").alias("id"))
    flat = links.select(F.col("ca").alias("a"), F.col("cb").alias("b"))
    core = step(core)
    below = step(reachable(core, flat).select(F.col("id").alias("c")))
    above = step(reachable(core, reversed_edges(flat)).select(F.col("id").alias("c")))
    core_and_above = above.join(sizes, "c").agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    free = links.join(below.select(F.col("c").alias("cb")), "cb", "left_anti").select("ca", "cb")
    beside = links.join(above.select(F.col("c").alias("ca")), "ca", "left_anti").join(above.select(F.col("c").alias("cb")), "cb", "left_anti").select("ca", "cb")
    listed = _ancestors(free).unionByName(_ancestors(beside).join(below, "c", "left_semi"))
    more = listed.join(sizes.withColumnRenamed("c", "above"), "above").groupBy("c").agg(F.sum("size").alias("more"))
    marked = sizes.join(below.withColumn("under", F.lit(True)), "c", "left").join(core.select(F.col("id").alias("c"), F.lit(True).alias("is_core")), "c", "left").join(more, "c", "left")
    own = F.when(F.col("is_core"), F.lit(core_and_above)).when(F.col("under"), F.col("size") + core_and_above).otherwise(F.col("size"))
    radius = marked.select(F.col("c").alias("component"), (own + F.when(F.col("is_core"), F.lit(0)).otherwise(F.coalesce("more", F.lit(0)))).alias("radius"))
    return owner.join(radius, "component").select("id", "radius")


def cyclic(edges: DataFrame, owner: DataFrame | None = None) -> DataFrame:
    """(id, in_cycle, reaches_cycle): whether a node is on a cycle, and whether it is on or leads to one. ``owner``: strong_components(), if known."""
    owner = step(strong_components(edges)) if owner is None else owner
    several = owner.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("component")
    on = step(owner.join(several, "component", "left_semi").select("id").unionByName(edges.where("a = b").select(F.col("a").alias("id"))).distinct())
    leads = reachable(on, reversed_edges(step(edges.select("a", "b").distinct())))
    every = owner.join(on.withColumn("c", F.lit(True)), "id", "left").join(leads.withColumn("l", F.lit(True)), "id", "left")
    return every.select("id", F.coalesce("c", F.lit(False)).alias("in_cycle"), F.coalesce("l", F.lit(False)).alias("reaches_cycle"))


def levels(edges: DataFrame, owner: DataFrame | None = None) -> DataFrame:
    """(id, level): a topological order by layers of the component graph: 0 for what calls nothing outside its cycle, else one more than its highest callee. ``owner``: strong_components(), if known."""
    owner = step(strong_components(edges)) if owner is None else owner
    links = condensed(edges, owner)
    at = settle(owner.select(F.col("component").alias("id"), F.lit(0).alias("v")), links.select(F.col("cb").alias("a"), F.col("ca").alias("b")), lambda v: v + 1, F.max)
    return owner.join(at.select(F.col("id").alias("component"), F.col("v").alias("level")), "component").select("id", "level")


def layering_score(edges: DataFrame) -> DataFrame:
    """(score, forward, backward): share of calls that go down the layers; self calls don't count; 1 without calls."""
    at = step(levels(edges))
    placed = edges.where("a <> b").join(at.select(F.col("id").alias("a"), F.col("level").alias("la")), "a").join(at.select(F.col("id").alias("b"), F.col("level").alias("lb")), "b")
    counted = placed.agg(F.count_if(F.col("la") > F.col("lb")).alias("forward"), F.count_if(F.col("la") <= F.col("lb")).alias("backward"))
    total = F.col("forward") + F.col("backward")
    return counted.select(F.when(total == 0, 1.0).otherwise(F.col("forward") / F.when(total > 0, total)).alias("score"), "forward", "backward")


def test_only(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id) reached from tests (``nodes``: id, is_test) and from no entry point that is none, tests themselves left out."""
    tests = nodes.where("is_test").select("id")
    production = entry_points(edges).join(tests, "id", "left_anti")
    by_test, by_production = depth_from(tests, edges).select("id"), depth_from(production, edges).select("id")
    return by_test.join(by_production, "id", "left_anti").join(tests, "id", "left_anti")


def test_helpers(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id) with callers, all of them tests."""
    callers = edges.select(F.col("b").alias("id"), F.col("a").alias("caller")).join(nodes.select(F.col("id").alias("caller"), "is_test"), "caller")
    return callers.groupBy("id").agg(F.bool_and("is_test").alias("t")).where("t").select("id")


def delegators(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id) of simple nodes (complexity 3 at most) with two or more callees that are on average over 1.5 times as complex."""
    callees = edges.distinct().join(nodes.select(F.col("id").alias("b"), F.col("complexity").alias("callee")), "b").groupBy(F.col("a").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.avg("callee").alias("mean"))
    return nodes.join(callees, "id").where("complexity <= 3 and n >= 2 and mean > complexity * 1.5").select("id")


def transitive_coverage(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, transitive): a node's own coverage, or if that is 0 the share of its callees above 0.8."""
    callees = edges.distinct().join(nodes.select(F.col("id").alias("b"), F.col("coverage").alias("c")), "b").groupBy(F.col("a").alias("id")).agg(F.avg(F.when(F.col("c") > 0.8, 1.0).otherwise(0.0)).alias("share"))
    return nodes.join(callees, "id", "left").select("id", F.when(F.col("coverage") > 0, F.col("coverage")).otherwise(F.coalesce("share", F.lit(0.0))).alias("transitive"))


def indirect_coverage(nodes: DataFrame, edges: DataFrame, hops: int = 3, discount: float = 0.7, enough: float = 0.8) -> DataFrame:
    """(id, indirect): the best coverage of a caller of ``enough``, a nearer one of ``enough`` hiding what is behind it, times 0.7 for each hop after the first; 0 for nodes that are covered themselves or have no such caller."""
    cover = nodes.select("id", "coverage")
    up = edges.distinct().select(F.col("b").alias("at"), F.col("a").alias("caller"))
    front = cover.where(F.col("coverage") < enough).select("id", F.col("id").alias("at"))
    found = None
    for hop in range(hops):
        met = step(front.join(up, "at").join(cover.withColumnRenamed("id", "caller"), "caller").select("id", "caller", "coverage").distinct())
        part = met.where(F.col("coverage") >= enough).select("id", (F.col("coverage") * discount**hop).alias("gain"))
        found = part if found is None else found.unionByName(part)
        front = met.where(F.col("coverage") < enough).select("id", F.col("caller").alias("at"))
    best = found.groupBy("id").agg(F.max("gain").alias("gain"))
    return cover.join(best, "id", "left").select("id", F.coalesce("gain", F.lit(0.0)).alias("indirect"))


def propagated_risk(nodes: DataFrame, edges: DataFrame, rounds: int = 10, least: float = 0.01, share: float = 0.3) -> DataFrame:
    """(id, risk): each round, a node's own risk plus ``share`` of its callees' risks times the edge's coupling; a change of ``least`` or less is not taken.

    ``nodes``: id, risk; ``edges``: a, b, coupling. Ends after ``rounds`` or when nothing changes.
    """
    now = step(nodes.select("id", F.col("risk").alias("own"), "risk"))
    for _ in range(rounds):
        inflow = edges.join(now.select(F.col("id").alias("b"), F.col("risk").alias("theirs")), "b").groupBy(F.col("a").alias("id")).agg(F.sum(F.col("theirs") * F.col("coupling")).alias("inflow"))
        target = F.col("own") + share * F.coalesce("inflow", F.lit(0.0))
        moves = F.abs(target - F.col("risk")) > least
        following = step(now.join(inflow, "id", "left").select("id", "own", F.when(moves, target).otherwise(F.col("risk")).alias("risk"), moves.alias("moved")))
        now = following.drop("moved")
        if following.where("moved").isEmpty():
            break
    return now.select("id", "risk")


def betweenness(edges: DataFrame) -> DataFrame:
    """(id, betweenness): share of the ordered pairs of other nodes of which some shortest path passes the node.

    Where a worker can hold the distances of all pairs, it compares them; where
    it can hold the links, it walks from a few sources at a time. Both write
    nothing. In larger graphs shortest paths are walked back from their ends by
    joins, one hop a step, so only nodes that are on one are met: as many rows
    as there are such triples.
    """
    links = step(edges.select("a", "b").distinct())
    n = nodes_of(links).count()
    few = 0 < n and links.count() <= MOST_LINKS
    pairs = (pairs_by_matrix(links) if n <= MOST_NODES else pairs_by_sources(links)) if few else _pairs_by_walk(links)
    return nodes_of(links).join(pairs, "id", "left").select("id", (F.coalesce("pairs", F.lit(0)) / F.lit(float(max(1, (n - 1) * (n - 2))))).alias("betweenness"))


def _pairs_by_walk(links: DataFrame) -> DataFrame:
    """(id, pairs) of nodes that are on shortest paths of distinct ``links`` (a, b)."""
    d = step(closure(links, None).where("source <> target"))
    front, passed = d.select("source", "target", F.col("target").alias("id"), F.col("hops").alias("at")), None
    near = d.select("source", F.col("target").alias("a"), F.col("hops").alias("before"))
    while True:
        back = front.join(links.select("a", F.col("b").alias("id")), "id").join(near, ["source", "a"]).where("before = at - 1")
        front = step(back.select("source", "target", F.col("a").alias("id"), F.col("before").alias("at")).distinct())
        if front.isEmpty():
            break
        met = front.groupBy("id").agg(F.count(F.lit(1)).alias("pairs"))
        passed = met if passed is None else passed.unionByName(met)
    return passed.groupBy("id").agg(F.sum("pairs").alias("pairs")) if passed is not None else nodes_of(links).select("id", F.lit(0).cast("long").alias("pairs"))


def clustering(edges: DataFrame, mutual: bool = False) -> DataFrame:
    """(id, clustering): share of the ordered pairs of a node's callees that call each other (``mutual``: of the pairs, those that do both ways); 0 below two callees.

    Triangles are found from their node of least degree (ties by id), so no
    hub's pairs of neighbours are listed.
    """
    calls = step(edges.select("a", "b").distinct())
    links = calls.where("a <> b")
    sides = links.groupBy(F.least("a", "b").alias("p"), F.greatest("a", "b").alias("q")).agg(F.bool_or(F.col("a") < F.col("b")).alias("up"), F.bool_or(F.col("a") > F.col("b")).alias("down"))
    degree = sides.select(F.explode(F.array("p", "q")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
    placed = sides.join(degree.select(F.col("id").alias("p"), F.col("degree").alias("dp")), "p").join(degree.select(F.col("id").alias("q"), F.col("degree").alias("dq")), "q")
    first = (F.col("dp") < F.col("dq")) | ((F.col("dp") == F.col("dq")) & (F.col("p") < F.col("q")))
    # u is the lower end in (degree, id); out and back say which of u -> v and v -> u there are.
    ends = placed.select(F.when(first, F.col("p")).otherwise(F.col("q")).alias("u"), F.when(first, F.col("q")).otherwise(F.col("p")).alias("v"), F.when(first, F.col("dq")).otherwise(F.col("dp")).alias("dv"), F.when(first, F.col("up")).otherwise(F.col("down")).alias("out"), F.when(first, F.col("down")).otherwise(F.col("up")).alias("back"))
    ends = step(ends)
    x, y, z = ends.alias("x"), ends.alias("y"), ends.alias("z")
    later = (F.col("x.dv") < F.col("y.dv")) | ((F.col("x.dv") == F.col("y.dv")) & (F.col("x.v") < F.col("y.v")))
    closed = x.join(y, (F.col("x.u") == F.col("y.u")) & later).join(z, (F.col("z.u") == F.col("x.v")) & (F.col("z.v") == F.col("y.v")))
    # Of each corner: whether it calls both others, and how many of the calls between those there are.
    def corner(of: str, calls_one: Column, calls_other: Column, between: list[Column]) -> Column:
        both_ways = F.when(between[0] & between[1], 1).otherwise(0) if mutual else between[0].cast("int") + between[1].cast("int")
        return F.struct(F.col(of).alias("id"), F.when(calls_one & calls_other, both_ways).otherwise(0).alias("n"))

    c = F.col
    corners = F.array(
        corner("x.u", c("x.out"), c("y.out"), [c("z.out"), c("z.back")]), corner("x.v", c("x.back"), c("z.out"), [c("y.out"), c("y.back")]), corner("y.v", c("y.back"), c("z.back"), [c("x.out"), c("x.back")])
    )
    counted = closed.select(F.explode(corners).alias("k")).groupBy(F.col("k.id").alias("id")).agg(F.sum("k.n").alias("closed"))
    sizes = calls.groupBy(F.col("a").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    possible = F.col("n") * (F.col("n") - 1) / (2 if mutual else 1)
    return nodes_of(calls).join(sizes, "id", "left").join(counted, "id", "left").select("id", F.when(F.col("n") >= 2, F.coalesce("closed", F.lit(0)) / possible).otherwise(0.0).alias("clustering"))


def propagated_purity(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, is_pure, confidence): a node stays pure if all it calls is; its confidence falls by a tenth for each level to what it rests on, 0.5 at least; nodes that lead to a cycle keep 0.7 of it.

    ``nodes``: id, is_pure, confidence.
    """
    impure = nodes.where("not is_pure").select("id")
    spoiled = depth_from(impure, reversed_edges(edges)).select("id", F.lit(True).alias("spoiled"))
    owner = step(strong_components(edges))
    at, loops = levels(edges, owner), cyclic(edges, owner)
    joined = nodes.join(spoiled, "id", "left").join(at, "id", "left").join(loops.select("id", "reaches_cycle"), "id", "left")
    pure = F.col("is_pure") & F.col("spoiled").isNull()
    depth = F.coalesce("level", F.lit(0))
    rested = F.when(depth > 0, F.least(F.greatest(F.col("confidence") * F.pow(F.lit(0.9), depth), F.lit(0.5)), F.lit(1.0))).otherwise(F.col("confidence"))
    held = F.when(F.coalesce("reaches_cycle", F.lit(False)), F.col("confidence") * 0.7).otherwise(rested)
    return joined.select("id", pure.alias("is_pure"), F.when(pure, held).otherwise(F.col("confidence")).alias("confidence"))


def cascade_impact(nodes: DataFrame, edges: DataFrame, hops: int = 3, decay: float = 0.7) -> DataFrame:
    """(id, impact): the weights of all that depends on a node, times ``decay`` for each hop."""
    upstream = closure(reversed_edges(edges), hops).where("source <> target").join(nodes.select(F.col("id").alias("target"), "weight"), "target")
    sums = upstream.groupBy(F.col("source").alias("id")).agg(F.sum(F.col("weight") * F.pow(F.lit(decay), F.col("hops"))).alias("impact"))
    return nodes.join(sums, "id", "left").select("id", F.coalesce("impact", F.lit(0.0)).alias("impact"))


def modification_impact(edges: DataFrame) -> DataFrame:
    """(id, callers, callees): direct counts on both sides."""
    out = edges.distinct().groupBy(F.col("a").alias("id")).agg(F.count(F.lit(1)).alias("callees"))
    into = edges.distinct().groupBy(F.col("b").alias("id")).agg(F.count(F.lit(1)).alias("callers"))
    return nodes_of(edges).join(into, "id", "left").join(out, "id", "left").na.fill(0, ["callers", "callees"]).select("id", "callers", "callees")


def communities(edges: DataFrame, rounds: int = 20) -> DataFrame:
    """(id, community) by label propagation on the undirected graph: each round a node takes its neighbours' most frequent label, the smallest of equals; it ends when no label changes or after ``rounds``."""
    sides = edges.where("a <> b").select("a", "b").union(reversed_edges(edges.where("a <> b").select("a", "b"))).distinct()
    now = step(nodes_of(edges).withColumn("label", F.col("id")))
    for turn in range(rounds):
        votes = sides.join(now.select(F.col("id").alias("b"), "label"), "b").groupBy("a", "label").agg(F.count(F.lit(1)).alias("n"))
        best = votes.groupBy(F.col("a").alias("id")).agg(F.max_by("label", F.struct("n", -F.col("label"))).alias("vote"))
        # Half the nodes move in a round, so that two neighbours do not swap labels for ever.
        moves = F.col("vote").isNotNull() & (F.col("vote") < F.col("label")) | (F.col("vote").isNotNull() & (F.pmod(F.col("id") + turn, F.lit(2)) == 0) & (F.col("vote") != F.col("label")))
        following = step(now.join(best, "id", "left").select("id", F.when(moves, F.col("vote")).otherwise(F.col("label")).alias("label"), moves.alias("moved")))
        now = following.drop("moved")
        if following.where("moved").isEmpty():
            break
    return now.select("id", F.col("label").alias("community"))


def weighted_vote(signals: DataFrame, key: str, category: str = "category") -> DataFrame:
    """(key, category, score): the category with the largest sum of weight times confidence; the last in order wins a tie."""
    sums = signals.groupBy(key, category).agg(F.round(F.sum(F.col("weight") * F.col("confidence")), 9).alias("score"))
    return sums.groupBy(key).agg(F.max_by(category, F.struct("score", category)).alias(category), F.max("score").alias("score"))


def reaching_definitions(blocks: DataFrame, flow: DataFrame) -> DataFrame:
    """(block, variable, definition) that reach a block's start: what leaves a block before it, its own definitions in place of older ones.

    ``blocks``: block, variable, definition (its last one); ``flow``: a, b.
    Where a worker can hold the links, each passes some of the definitions
    along all of them. Larger graphs pass them by joins, a step every few hops.
    """
    links = step(flow.select("a", "b").distinct())
    own = step(blocks.select("block", "variable", "definition").distinct())
    return definitions_by_bits(own, links) if links.count() <= MOST_FLOW and own.count() <= MOST_DEFINITIONS else _definitions_by_joins(own, links)


def _definitions_by_joins(own: DataFrame, links: DataFrame) -> DataFrame:
    """(block, variable, definition) that reach a block's start, from distinct ``own`` (block, variable, definition) and ``links`` (a, b).

    Definitions are numbered, and those of one variable and 64 numbers travel
    as the bits of one row. Each hop passes on only the bits that are new to a
    block; rows for single definitions are made once, of the result.
    """
    numbered = step(running(own.select("variable", "definition").distinct(), [F.col("variable"), F.col("definition")], {}, "n").withColumn("slot", F.floor(F.col("n") / 64)).withColumn("bit", (F.col("n") % 64).cast("int")))
    kills = step(own.select("block", "variable").distinct().withColumn("kills", F.lit(True)))
    zero, key = F.lit(0).cast("long"), ["block", "variable", "slot"]
    # 1 shifted by a column.
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit"))
    leaving = step(own.join(numbered, ["variable", "definition"]).groupBy(*key).agg(F.bit_or(mask).alias("fresh")))
    now = None
    while True:
        for _ in range(HOPS):
            arrived = links.join(leaving, F.col("a") == F.col("block")).select(F.col("b").alias("block"), "variable", "slot", zero.alias("bits"), F.col("fresh").alias("came"))
            met = arrived if now is None else arrived.unionByName(now.select(*key, "bits", zero.alias("came")))
            sums = met.groupBy(*key).agg(F.bit_or("bits").alias("old"), F.bit_or("came").alias("came"))
            now = sums.select(*key, F.col("old").bitwiseOR(F.col("came")).alias("bits"), F.col("came").bitwiseAND(F.bitwise_not("old")).alias("fresh"))
            leaving = now.where("fresh <> 0").join(kills, ["block", "variable"], "left_anti").select(*key, "fresh")
        now = step(now)
        leaving = step(now.where("fresh <> 0").join(kills, ["block", "variable"], "left_anti").select(*key, "fresh"))
        if leaving.isEmpty():
            break
    told = numbered.groupBy("slot").agg(F.collect_list(F.struct("bit", "variable", "definition")).alias("told"))
    found = now.select("block", "slot", "bits").join(told, "slot")
    held = F.filter("told", lambda x: F.call_function("shiftrightunsigned", F.col("bits"), x["bit"]).bitwiseAND(F.lit(1)) == 1)
    return found.select("block", F.explode(held).alias("d")).select("block", "d.variable", "d.definition")


def similar_callers(edges: DataFrame, least: float) -> DataFrame:
    """(x, y, similarity), x < y: nodes whose sets of callees overlap by at least ``least`` (Jaccard).

    Nodes meet only at their rarest callees: of n callees, n - ceil(least * n)
    + 1 are enough to find every pair (the prefix filter).
    """
    calls = step(edges.select("a", "b").distinct())
    rarity = calls.groupBy("b").agg(F.count(F.lit(1)).alias("callers"))
    sizes = calls.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
    placed = calls.join(rarity, "b").join(sizes, "a").withColumn("at", F.row_number().over(Window.partitionBy("a").orderBy("callers", "b")))
    first = step(placed.where(F.col("at") <= F.col("n") - F.ceil(F.col("n") * F.lit(least) - 1e-9) + 1).select("a", "b", "n"))
    x, y = first.alias("x"), first.alias("y")
    near = (F.least("x.n", "y.n") >= F.greatest("x.n", "y.n") * F.lit(least) - 1e-9) & (F.col("x.a") < F.col("y.a"))
    met = x.join(y, (F.col("x.b") == F.col("y.b")) & near).select(F.col("x.a").alias("x"), F.col("y.a").alias("y"), F.col("x.n").alias("nx"), F.col("y.n").alias("ny")).distinct()
    common = met.join(calls.select(F.col("a").alias("x"), "b"), "x").join(calls.select(F.col("a").alias("y"), "b"), ["y", "b"]).groupBy("x", "y", "nx", "ny").agg(F.count(F.lit(1)).alias("k"))
    return common.withColumn("similarity", F.col("k") / (F.col("nx") + F.col("ny") - F.col("k"))).where(F.col("similarity") >= least).select("x", "y", "similarity")


def linked_clusters(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, cluster) by single linkage: nodes (id) joined by a chain of pairs (x, y) share the smallest id; others are alone."""
    found = components(pairs.select(F.col("x").alias("a"), F.col("y").alias("b"))).withColumnRenamed("component", "cluster")
    return nodes.join(found, "id", "left").select("id", F.coalesce("cluster", "id").alias("cluster"))
