"""Co-mention networks: edges, centrality, components and slices."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from missiva.operators.scale import BROADCAST_ROWS, bounded_broadcast, partitions, top_rows
from missiva.session import pin

HEAVY_DOCUMENT = 256


def pair_years(
    mentions: DataFrame, doc: str = "doc", entity: str = "id", date: str = "date", min_weight: int = 2,
    exclude: Sequence[tuple] = (), heavy: int = HEAVY_DOCUMENT,
) -> DataFrame:
    """(a, b, year, weight) of entity pairs that share at least `min_weight` documents.

    Entities in too few documents go first. Documents of up to `heavy` entities list
    their pairs. A larger document is cut into blocks that meet block against block, and lists
    the entities of several large documents only: pairs of any other entity in it must occur
    in a small document to count, so those are looked up in the few large ones of that entity.
    Partitions are as many as the measured rows and pairs ask for.
    """
    rows = mentions.groupBy(F.col(doc).alias("doc"), F.col(entity).alias("id")).agg(F.min(F.year(date)).alias("year"))
    # The distinct mentions serve the pairs and the counts: read them once.
    rows = pin(rows)
    if min_weight > 1:
        enough = rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_weight).select("id")
        rows = rows.join(bounded_broadcast(enough), "id", "left_semi")
    sizes = rows.groupBy("doc").agg(F.count(F.lit(1)).alias("_size"))
    size = F.col("_size").cast("double")
    listed, biggest = sizes.agg(F.sum(size * (size + 1) / 2), F.max("_size")).first()
    parts = partitions(rows, int(listed or 0))
    members = rows.withColumn("_size", F.lit(1).cast("long"))
    looked_up = None
    if (biggest or 0) > heavy:
        big = sizes.filter(F.col("_size") > heavy)
        in_big = pin(rows.join(big, "doc"))
        small = rows.join(big, "doc", "left_anti")
        often = in_big
        if min_weight > 1:
            counts = in_big.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
            often = in_big.join(counts.filter(F.col("n") >= min_weight), "id", "left_semi")
            rare = pin(counts.filter(F.col("n") < min_weight).select("id"))
            if rare.limit(1).count():
                looked_up = _looked_up(small, in_big, rare, heavy, parts)
        members = small.withColumn("_size", F.lit(1).cast("long")).unionByName(often.select("doc", "id", "year", "_size"))
    counted = _listed_pairs(members, heavy, parts)
    if looked_up is not None:
        counted = counted.unionByName(looked_up)
    for x, y in exclude:
        lo, hi = sorted((x, y))
        counted = counted.filter(~((F.col("a") == lo) & (F.col("b") == hi)))
    # Sums of one pair lie together, so the whole weight needs no further shuffle.
    counted = counted.repartition(parts, "a", "b").groupBy("a", "b", "year").agg(F.sum("weight").alias("weight"))
    whole = F.sum("weight").over(Window.partitionBy("a", "b"))
    return counted.withColumn("_w", whole).filter(F.col("_w") >= min_weight).drop("_w")


def _listed_pairs(members: DataFrame, heavy: int, parts: int) -> DataFrame:
    """Pairs of members(doc, id, year, _size) in their documents, summed up within every task."""
    blocks = F.ceil(F.col("_size") / heavy)
    x = F.pmod(F.xxhash64("id"), blocks)
    # A block meets itself, the later ones and the earlier ones.
    cells = F.concat(
        F.transform(F.sequence(x, blocks - 1), lambda j: F.struct(x.alias("i"), j.alias("j"))),
        F.when(x > 0, F.transform(F.sequence(F.lit(0).cast("long"), x - 1), lambda i: F.struct(i.alias("i"), x.alias("j")))).otherwise(F.array()),
    )
    dealt = members.dropna(subset=["doc", "id"]).select("doc", F.explode(cells).alias("_c"), F.struct(x.alias("x"), "id", "year").alias("_m"))
    task = F.pmod(F.xxhash64("doc", "_c"), F.lit(parts)).cast("int")
    cell = dealt.withColumn("_p", task).repartitionById(parts, F.col("_p")).groupBy("_p", "doc", "_c").agg(F.collect_list("_m").alias("_l"))
    both = cell.filter(F.size("_l") > 1).select("_p", "_c", F.explode("_l").alias("u"), "_l").select("_p", "_c", "u", F.explode("_l").alias("v"))
    own = F.col("_c.i") == F.col("_c.j")
    met = F.when(own, F.col("u.id") < F.col("v.id")).otherwise((F.col("u.x") == F.col("_c.i")) & (F.col("v.x") == F.col("_c.j")))
    # The year is that of the smaller entity's mention.
    year = F.when(F.col("u.id") < F.col("v.id"), F.col("u.year")).otherwise(F.col("v.year"))
    pairs = both.filter(met).select("_p", F.least("u.id", "v.id").alias("a"), F.greatest("u.id", "v.id").alias("b"), year.alias("year"))
    return pairs.groupBy("_p", "a", "b", "year").agg(F.count(F.lit(1)).alias("weight")).drop("_p")


def _looked_up(small: DataFrame, big: DataFrame, rare: DataFrame, heavy: int, parts: int) -> DataFrame:
    """Pairs of small documents counted in the large ones, where an end is rare there."""
    known = _listed_pairs(small.withColumn("_size", F.lit(1).cast("long")), heavy, parts).select("a", "b").distinct()
    seen = lambda c: rare.select(F.col("id").alias(c))
    side = lambda c, *more: big.select(F.col("id").alias(c), "doc", *more)
    by_a = known.join(seen("a"), "a", "left_semi").join(side("a", "year"), "a").join(side("b"), ["doc", "b"])
    only_b = known.join(seen("a"), "a", "left_anti").join(seen("b"), "b", "left_semi")
    by_b = only_b.join(side("b"), "b").join(side("a", "year"), ["doc", "a"])
    return by_a.select("a", "b", "year").unionByName(by_b.select("a", "b", "year")).groupBy("a", "b", "year").agg(
        F.count(F.lit(1)).alias("weight")
    )


def comention_edges(pairs: DataFrame) -> DataFrame:
    """Undirected edges with weight and sorted years, from `pair_years`."""
    return pairs.groupBy("a", "b").agg(
        F.sum("weight").alias("weight"), F.sort_array(F.collect_set("year")).alias("years")
    )


def excluded_weight(mentions: DataFrame, x, y, doc: str = "doc", entity: str = "id") -> DataFrame:
    """Number of documents that name both ends of an excluded pair."""
    both = mentions.filter(F.col(entity).isin(x, y)).groupBy(doc).agg(F.countDistinct(entity).alias("n"))
    return both.filter("n = 2").agg(F.count(F.lit(1)).alias("raw_weight"))


def directed(edges: DataFrame) -> DataFrame:
    """Both directions as (src, dst, weight); the edges are worked out once."""
    way = lambda x, y: F.struct(F.col(x).alias("src"), F.col(y).alias("dst"))
    return edges.select(F.explode(F.array(way("a", "b"), way("b", "a"))).alias("_d"), "weight").select("_d.src", "_d.dst", "weight")


def degree_centrality(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    deg = directed(edges).groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("degree"))
    n = nodes.agg(F.count(F.lit(1)).alias("_n"))
    out = nodes.select("id").join(deg, "id", "left").crossJoin(F.broadcast(n))
    d = F.coalesce("degree", F.lit(0))
    return out.select("id", d.alias("degree"), F.coalesce(d / F.nullif(F.col("_n") - 1, F.lit(0)), F.lit(0.0)).alias("centrality"))


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id each node can reach.

    Alternating star contraction: every round re-hangs neighbours on the smallest
    node they know, so the rounds grow with the logarithm of the size.
    """
    cur = pin(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())

    def star(pairs: DataFrame, large: bool) -> DataFrame:
        sym = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else pairs
        low = sym.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        near = sym.join(low, "u")
        if large:
            return near.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        moved = near.select(F.col("v").alias("u"), F.col("m").alias("v"))
        own = low.select("u", F.col("m").alias("v"))
        return moved.unionByName(own).filter("u <> v").distinct()

    mark = None
    while True:
        cur = pin(star(star(cur, True), False))
        now = cur.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    label = cur.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("_c"))
    return nodes.select("id").join(label, "id", "left").select("id", F.coalesce("_c", "id").alias("component"))


def graph_summary(nodes: DataFrame, edges: DataFrame, with_components: bool = True) -> DataFrame:
    n = nodes.agg(F.count(F.lit(1)).alias("nodes"))
    m = edges.agg(F.count(F.lit(1)).alias("edges"))
    out = n.crossJoin(m)
    if with_components:
        out = out.crossJoin(components(nodes, edges).agg(F.countDistinct("component").alias("components")))
    pairs = F.col("nodes") * (F.col("nodes") - 1)
    return out.withColumn("average_degree", 2 * F.col("edges") / F.nullif(F.col("nodes"), F.lit(0))).withColumn(
        "density", F.coalesce(2 * F.col("edges") / F.nullif(pairs, F.lit(0)), F.lit(0.0))
    )


def pagerank(
    nodes: DataFrame, edges: DataFrame, alpha: float = 0.85, tol: float = 1e-6, max_iter: int = 100
) -> DataFrame:
    """Weighted PageRank of the undirected graph; isolated nodes spread their rank evenly."""
    n = nodes.count()
    if n == 0:
        return nodes.select("id", F.lit(0.0).alias("pagerank"))
    # Strengths, steps and dead ends all read the arcs: work out the edges once.
    arcs = pin(directed(edges))
    strength = arcs.groupBy("src").agg(F.sum("weight").alias("_s"))
    steps = pin(arcs.join(strength, "src").select("src", "dst", (F.col("weight") / F.col("_s")).alias("p")))
    dead = strength.select(F.col("src").alias("id"), F.lit(True).alias("_out"))
    base = pin(nodes.select("id").join(dead, "id", "left").select("id", F.col("_out").isNull().alias("dangling")))
    small = n <= BROADCAST_ROWS
    hint = F.broadcast if small else (lambda d: d)
    ranks = base.select("id", "dangling", F.lit(1.0 / n).alias("r"))
    lost = float(ranks.filter("dangling").agg(F.sum("r")).first()[0] or 0.0)
    for _ in range(max_iter):
        got = steps.join(hint(ranks.select(F.col("id").alias("src"), "r")), "src").groupBy(F.col("dst").alias("id")).agg(
            F.sum(F.col("p") * F.col("r")).alias("_in")
        )
        # Ranks only change in value, so joining the previous ones gives the error as well.
        fresh = ranks.join(got, "id", "left").select(
            "id", "dangling", F.col("r").alias("_old"),
            (F.lit(alpha) * (F.coalesce("_in", F.lit(0.0)) + F.lit(lost / n)) + F.lit((1 - alpha) / n)).alias("r"),
        )
        fresh = pin(fresh)
        err, lost = fresh.agg(F.sum(F.abs(F.col("r") - F.col("_old"))), F.sum(F.when(F.col("dangling"), F.col("r")).otherwise(0.0))).first()
        ranks = fresh.select("id", "dangling", "r")
        if err < n * tol:
            break
    return ranks.select("id", F.col("r").alias("pagerank"))


#: Rows of state, sources times nodes, of one batch of the betweenness.
STATE_ROWS = 50_000_000
#: Arcs of a graph that every task holds whole, 20 bytes each.
GRAPH_ARCS = 5_000_000
#: Tasks a core gets where sources take different times.
TASKS_PER_CORE = 4


def betweenness(nodes: DataFrame, edges: DataFrame, cost: str = "1/weight", batches: int | None = None) -> DataFrame:
    """Normalised shortest-path betweenness of all sources.

    A graph of up to GRAPH_ARCS arcs is held by every task, which works out its share of the sources. A larger one, or
    a given number of `batches`, is worked in hash batches of sources, as many as keep the state, a row per source and
    node it reaches, near STATE_ROWS. `betweenness_sampled` needs far fewer sources.
    """
    price = 1.0 / F.col("weight") if cost == "1/weight" else F.col("weight").cast("double")
    arcs = pin(directed(edges).select("src", "dst", price.alias("c")))
    n = nodes.count()
    summed = _summed_dependencies(arcs, nodes.select(F.col("id").alias("s")), n * n, batches)
    scale = 1.0 / ((n - 1) * (n - 2)) if n > 2 else 0.0
    return nodes.select("id").join(summed, "id", "left").select(
        "id", (F.coalesce("_d", F.lit(0.0)) * scale).alias("betweenness")
    )


def sample_size(nodes: int, error: float, doubt: float) -> int:
    """Sources after which every node's sampled betweenness is within `error`, but for the probability `doubt`."""
    return math.ceil(math.log(2 * max(nodes, 1) / doubt) / (2 * error * error))


def betweenness_sampled(
    nodes: DataFrame, edges: DataFrame, error: float = 0.05, doubt: float = 0.05, cost: str = "1/weight", seed: int = 42,
) -> DataFrame:
    """Normalised betweenness estimated from a sample of sources: (id, betweenness, sources).

    A source's dependencies on a node, divided by n - 2, lie in 0 to 1 and their mean over all sources is the node's
    betweenness times (n - 1) / n. By Hoeffding's bound the mean over `sample_size` of them, drawn without
    replacement, is within `error` for all nodes together, with probability 1 - `doubt`. The number of sources grows
    with the logarithm of the nodes only; where it exceeds the nodes, all are used and the result is exact.
    """
    n = nodes.count()
    k = min(n, sample_size(n, error, doubt))
    price = 1.0 / F.col("weight") if cost == "1/weight" else F.col("weight").cast("double")
    arcs = pin(directed(edges).select("src", "dst", price.alias("c")))
    ids = nodes.select(F.col("id").alias("s"))
    drawn = pin(ids.orderBy(F.xxhash64("s", F.lit(seed)), "s").limit(k))
    summed = _summed_dependencies(arcs, drawn, k * n)
    scale = n / ((n - 1) * (n - 2) * k) if n > 2 else 0.0
    return nodes.select("id").join(summed, "id", "left").select(
        "id", (F.coalesce("_d", F.lit(0.0)) * scale).alias("betweenness"), F.lit(k).cast("long").alias("sources")
    )


def _summed_dependencies(arcs: DataFrame, sources: DataFrame, states: int, batches: int | None = None) -> DataFrame:
    """(id, _d): what all sources(s) depend on a node, from tasks that hold the graph or from batches of sources."""
    if batches is None and arcs.limit(GRAPH_ARCS + 1).count() <= GRAPH_ARCS:
        parts = [_held_dependencies(arcs, sources)]
    else:
        batches = batches or max(1, -(-states // STATE_ROWS))
        parts = [pin(_dependencies(arcs, sources.filter(F.pmod(F.xxhash64("s"), F.lit(batches)) == i))) for i in range(batches)]
    return reduce(DataFrame.unionByName, parts).groupBy("id").agg(F.sum("d").alias("_d"))


def _held_dependencies(arcs: DataFrame, sources: DataFrame) -> DataFrame:
    """(id, d): dependencies on a node, summed over the sources of a task."""
    spark, kind = arcs.sparkSession, sources.schema["s"].dataType
    rows = arcs.dropna().select(F.col("src").cast(kind), F.col("dst").cast(kind), "c").toArrow().combine_chunks()
    src, dst, cost = rows["src"].combine_chunks(), rows["dst"].combine_chunks(), rows["c"].to_numpy()
    ids = pc.unique(src)
    held = spark.sparkContext.broadcast((ids, *_ordered_arcs(len(ids), pc.index_in(src, ids).to_numpy(), pc.index_in(dst, ids).to_numpy(), cost)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, *graph = held.value
        total = np.zeros(len(ids))
        for batch in batches:
            for s in pc.index_in(batch.column("s"), ids).drop_null().to_numpy():
                total += _from_source(s, *graph)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(used)), pa.array(total[used])], names=["id", "d"])

    schema = StructType([StructField("id", kind), StructField("d", DoubleType())])
    # A node named twice is one source.
    dealt = sources.dropna().distinct().repartition(TASKS_PER_CORE * spark.sparkContext.defaultParallelism)
    return dealt.mapInArrow(run, schema)


def _ordered_arcs(n: int, src: np.ndarray, dst: np.ndarray, cost: np.ndarray) -> tuple:
    """Arcs by node and cost: first arc of each node, ends, costs, different costs, place of (node, cost), nodes each one reaches."""
    prices, rank = np.unique(cost, return_inverse=True)
    key = src.astype(np.int64) * len(prices) + rank
    order = np.argsort(key, kind="stable")
    group = np.arange(n)
    while True:
        low = group.copy()
        np.minimum.at(low, src, group[dst])
        np.minimum.at(low, dst, group[src])
        low = low[low]
        if (low == group).all():
            break
        group = low
    starts = np.concatenate([[0], np.cumsum(np.bincount(src, minlength=n))])
    return starts, dst[order], cost[order], prices, key[order], np.bincount(group, minlength=n)[group]


def _from_source(
    s: int, starts: np.ndarray, dst: np.ndarray, cost: np.ndarray, prices: np.ndarray, key: np.ndarray, within: np.ndarray, eps: float = 1e-9,
) -> np.ndarray:
    """Dependencies of one source on every node, by the steps of `_dependencies`.

    As soon as every node in reach has a distance, only arcs that end within the largest one are followed.
    """
    n = len(starts) - 1

    def arcs_of(front: np.ndarray) -> tuple:
        ends = starts[front + 1]
        if seen == within[s]:
            room = farthest - dist[front] + 2 * eps
            ends = np.searchsorted(key, front * len(prices) + np.searchsorted(prices, room, side="right"))
        many = ends - starts[front]
        return np.repeat(starts[front] - np.cumsum(many) + many, many) + np.arange(many.sum()), many

    dist = np.full(n, np.inf)
    dist[s] = 0.0
    front, seen, farthest = np.array([s]), 1, 0.0
    while len(front):
        at, many = arcs_of(front)
        to, far = dst[at], np.repeat(dist[front], many) + cost[at]
        less = np.flatnonzero(far < dist[to])
        to, far = to[less], far[less]
        before = dist.copy()
        np.minimum.at(dist, to, far)
        front = np.flatnonzero(dist < before - eps)
        known = dist[np.isfinite(dist)]
        seen, farthest = len(known), known.max()
    reached = np.flatnonzero(np.isfinite(dist))
    at, many = arcs_of(reached)
    short = np.flatnonzero(np.abs(np.repeat(dist[reached], many) + cost[at] - dist[dst[at]]) <= eps)
    # Nodes go by their place among the reached ones.
    place = np.zeros(n, dtype=np.int64)
    place[reached] = np.arange(len(reached))
    u, v = np.repeat(np.arange(len(reached)), many)[short], place[dst[at][short]]

    def waves(wave: np.ndarray, push: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        total = wave
        for _ in range(n + 1):
            wave = push(wave)
            if not wave.any():
                return total
            total = total + wave
        raise ValueError("arcs of no cost form a circle of shortest paths")

    size = len(reached)
    paths = waves((reached == s).astype(float), lambda x: np.bincount(v, x[u], size))
    share = paths[u] / paths[v]
    found = waves(np.bincount(u, share, size), lambda x: np.bincount(u, x[v] * share, size))
    out = np.zeros(n)
    out[reached] = found
    out[s] = 0.0
    return out


def _dependencies(arcs: DataFrame, sources: DataFrame, eps: float = 1e-9) -> DataFrame:
    """(id, d) of the sources: distances come from frontier relaxation, path counts and dependencies from pushing amounts
    along the shortest-path arcs of every source until nothing moves.
    """
    dist = pin(sources.select("s", F.col("s").alias("v"), F.lit(0.0).alias("d")))
    front = dist
    while True:
        step = front.join(arcs, front["v"] == arcs["src"]).groupBy("s", F.col("dst").alias("v")).agg(
            F.min(F.col("d") + F.col("c")).alias("nd")
        )
        both = pin(
            dist.join(step, ["s", "v"], "full").select(
                "s", "v", F.least("d", "nd").alias("d"),
                (F.col("nd").isNotNull() & (F.col("d").isNull() | (F.col("nd") < F.col("d") - eps))).alias("moved"),
            )
        )
        dist, front = both.select("s", "v", "d"), both.filter("moved").select("s", "v", "d")
        if front.limit(1).count() == 0:
            break
    tail = dist.select("s", F.col("v").alias("src"), F.col("d").alias("d0"))
    head = dist.select("s", F.col("v").alias("dst"), F.col("d").alias("d1"))
    dag = pin(
        tail.join(arcs, "src").join(head, ["s", "dst"]).filter(F.abs(F.col("d0") + F.col("c") - F.col("d1")) <= eps)
        .select("s", "src", "dst")
    )
    # Path counts.
    wave = sources.select("s", F.col("s").alias("v"), F.lit(1.0).alias("x"))
    sigma = pin(wave)
    while True:
        wave = pin(
            wave.withColumnRenamed("v", "src").join(dag, ["s", "src"]).groupBy("s", F.col("dst").alias("v")).agg(F.sum("x").alias("x"))
        )
        if wave.limit(1).count() == 0:
            break
        sigma = pin(sigma.unionByName(wave).groupBy("s", "v").agg(F.sum("x").alias("x")))
    share = pin(
        dag.join(sigma.select("s", F.col("v").alias("src"), F.col("x").alias("x0")), ["s", "src"])
        .join(sigma.select("s", F.col("v").alias("dst"), F.col("x").alias("x1")), ["s", "dst"])
        .select("s", "src", "dst", (F.col("x0") / F.col("x1")).alias("q"))
    )
    # Dependencies, from the far ends back to the source.
    wave = share.groupBy("s", F.col("src").alias("v")).agg(F.sum("q").alias("x"))
    total = pin(wave)
    wave = total
    while True:
        wave = pin(
            wave.withColumnRenamed("v", "dst").join(share, ["s", "dst"]).groupBy("s", F.col("src").alias("v")).agg(
                F.sum(F.col("x") * F.col("q")).alias("x")
            )
        )
        if wave.limit(1).count() == 0:
            break
        total = pin(total.unionByName(wave).groupBy("s", "v").agg(F.sum("x").alias("x")))
    return total.filter(F.col("s") != F.col("v")).groupBy(F.col("v").alias("id")).agg(F.sum("x").alias("d"))


def temporal_slices(mentions: DataFrame, pairs: DataFrame, entity: str = "id", date: str = "date") -> DataFrame:
    """Active nodes, edges of the global edge set, density and new nodes of each year."""
    seen = mentions.select(F.col(entity).alias("id"), F.year(date).alias("year")).filter("year IS NOT NULL").distinct()
    first = seen.groupBy("id").agg(F.min("year").alias("year"))
    nodes = seen.groupBy("year").agg(F.count(F.lit(1)).alias("num_nodes"))
    new = first.groupBy("year").agg(F.count(F.lit(1)).alias("new_nodes"))
    edges = pairs.filter("year IS NOT NULL").groupBy("year").agg(F.count(F.lit(1)).alias("num_edges"))
    out = nodes.join(new, "year", "left").join(edges, "year", "left").na.fill(0, ["new_nodes", "num_edges"])
    possible = F.col("num_nodes") * (F.col("num_nodes") - 1)
    return out.withColumn("density", F.when(F.col("num_nodes") > 1, 2 * F.col("num_edges") / F.nullif(possible, F.lit(0))).otherwise(0.0))


def ego_network(edges: DataFrame, node, year: int | None = None) -> DataFrame:
    """Edges at a node and among its neighbours."""
    rows = edges if year is None else edges.filter(F.array_contains("years", year))
    near = directed(rows.filter((F.col("a") == node) | (F.col("b") == node))).filter(F.col("src") == node)
    ids = near.select(F.col("dst").alias("id")).unionByName(near.select(F.col("src").alias("id"))).distinct()
    return induced(rows, ids)


def induced(edges: DataFrame, ids: DataFrame) -> DataFrame:
    return edges.join(ids.select(F.col("id").alias("a")), "a", "left_semi").join(
        ids.select(F.col("id").alias("b")), "b", "left_semi"
    ).select(*edges.columns)


def top_subgraph(ranks: DataFrame, edges: DataFrame, k: int = 20) -> DataFrame:
    """Edges among the k nodes of highest rank."""
    return induced(edges, top_rows(ranks, [], [F.col("pagerank").desc(), "id"], k).select("id"))


def entity_pages(
    entities: DataFrame, documents: DataFrame, edges: DataFrame, photos: DataFrame | None = None, connections: int = 10
) -> DataFrame:
    """Rows of each entity's page: attributes, dated documents, connections, photos.

    Long form (id, section, item, date, value): a page of any size is spread like all others.
    entities(id, canonical, letter_count), documents(id, doc_id, date, role), photos(id, photo).
    """
    from missiva.operators.series import top_connections

    none_d, none_v = F.lit(None).cast("date"), F.lit(None).cast("double")
    row = lambda s, i, d, v: ("id", F.lit(s).alias("section"), i.cast("string").alias("item"), d.alias("date"), v.cast("double").alias("value"))
    out = entities.select(*row("attributes", F.col("canonical"), none_d, F.col("letter_count")))
    docs = documents.groupBy("id", "doc_id").agg(F.min("date").alias("date"))
    out = out.unionByName(docs.select(*row("document", F.col("doc_id"), F.col("date"), none_v)))
    top = top_connections(edges, connections)
    out = out.unionByName(top.select(*row("connection", F.col("other"), none_d, F.col("weight"))))
    if photos is not None:
        out = out.unionByName(photos.select("id", "photo").distinct().select(*row("photo", F.col("photo"), none_d, none_v)))
    return out
