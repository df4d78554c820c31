"""Components, distances and routes."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadframe.model import StreetGraph
from roadframe.session import materialize

#: Edges that one task's routing index may hold (about 40 bytes each); larger graphs use the relaxation rounds.
MAX_INDEX_EDGES = 5_000_000
#: Edges of a weakly connected piece up to which one task finds its strong components, and edges of all pieces that share a task.
PIECE_EDGES = 100_000
TASK_EDGES = 200_000


def weak_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(osmid, component)``: the smallest id of each node's weakly connected component.

    By contraction: every node hooks to its smallest neighbour if that is smaller,
    the hooks are followed to their roots by pointer doubling, and the roots with
    the links between them are the next, much smaller graph. Labels are then
    handed back level by level. Each level is written to the shared folder.
    """
    links = materialize(edges.where("u IS NOT NULL AND v IS NOT NULL AND u <> v").select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct(), "links")
    levels: list[DataFrame] = []
    while not links.isEmpty():
        both = links.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("_e")).select("_e.a", "_e.b")
        hooks = materialize(both.groupBy(F.col("a").alias("x")).agg(F.least(F.min("b"), F.col("x")).alias("root")), "hooks")
        while True:
            up = hooks.select(F.col("x").alias("root"), F.col("root").alias("far"))
            nxt = materialize(hooks.join(up, "root").select("x", F.col("far").alias("root"), (F.col("far") < F.col("root")).alias("moved")), "hooks")
            hooks = nxt.select("x", "root")
            if nxt.where("moved").isEmpty():
                break
        levels.append(hooks)
        ra, rb = hooks.select(F.col("x").alias("a"), F.col("root").alias("ra")), hooks.select(F.col("x").alias("b"), F.col("root").alias("rb"))
        lifted = links.join(ra, "a").join(rb, "b").where("ra <> rb")
        links = materialize(lifted.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "links")
    named = None
    for hooks in reversed(levels):  # the label of a node is the label of its root one level up
        if named is None:
            named = hooks.select("x", F.col("root").alias("component"))
        else:
            top = named.select(F.col("x").alias("root"), "component")
            named = materialize(hooks.join(top, "root", "left").select("x", F.coalesce("component", "root").alias("component")), "named")
    ids = nodes.select("osmid").distinct()
    if named is None:
        return ids.withColumn("component", F.col("osmid"))
    return ids.join(named.withColumnRenamed("x", "osmid"), "osmid", "left").select("osmid", F.coalesce("component", "osmid").alias("component"))


def largest_component(graph: StreetGraph, strongly: bool = False) -> StreetGraph:
    """The subgraph of the largest component; equal sizes: the one with the smallest id."""
    from roadframe.operators.truncate import keep_nodes

    labels = (strong_components if strongly else weak_components)(graph.nodes, graph.edges)
    best = labels.groupBy("component").count().orderBy(F.desc("count"), "component").limit(1).select("component")
    return keep_nodes(graph, labels.join(F.broadcast(best), "component", "left_semi"))


def strong_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(osmid, component)``: the smallest id of each node's strongly connected component.

    A strong component lies within one weakly connected piece. Pieces of at most ``PIECE_EDGES`` edges are dealt to
    tasks of about ``TASK_EDGES``; larger ones go through rounds of forward colouring and backward confirmation.
    """
    ids = nodes.select("osmid").distinct()
    links = materialize(edges.where("u IS NOT NULL AND v IS NOT NULL AND u <> v").select("u", "v").distinct(), "links")
    pieces = weak_components(ids, links)
    tagged = materialize(links.join(pieces.withColumnRenamed("osmid", "u"), "u").select("u", "v", F.col("component").alias("piece")), "pieces")
    sizes = materialize(tagged.groupBy("piece").agg(F.count(F.lit(1)).alias("n")), "sizes")
    small = sizes.where(F.col("n") <= PIECE_EDGES)
    total = small.agg(F.sum("n")).first()[0] or 0
    dealt = tagged.join(small, "piece", "left_semi").withColumn("bucket", F.pmod(F.xxhash64("piece"), F.lit(total // TASK_EDGES + 1)))
    found = dealt.select("bucket", "u", "v").groupBy("bucket").applyInPandas(_strong_in_task, "osmid bigint, component bigint")
    large = tagged.join(small, "piece", "left_anti").select("u", "v")
    if not large.isEmpty():
        large = materialize(large, "links")
        found = found.unionByName(_strong_by_rounds(large.select(F.explode(F.array("u", "v")).alias("osmid")).distinct(), large))
    return ids.join(found, "osmid", "left").select("osmid", F.coalesce("component", "osmid").alias("component"))


def _strong_by_rounds(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Strong components by forward colouring and backward confirmation.

    A round gives each open node the smallest id that reaches it; the nodes of one
    colour that reach back to their root form a component and leave the graph.
    """
    open_nodes = materialize(nodes.select("osmid").distinct(), "open")
    done: list[DataFrame] = []
    while not open_nodes.isEmpty():
        # nodes without an edge in or out are components of their own; leave them out first
        ins, outs = links.select(F.col("v").alias("osmid")).distinct(), links.select(F.col("u").alias("osmid")).distinct()
        core = open_nodes.join(ins, "osmid", "left_semi").join(outs, "osmid", "left_semi")
        trimmed = open_nodes.join(core, "osmid", "left_anti")
        if not trimmed.isEmpty():
            done.append(materialize(trimmed.select("osmid", F.col("osmid").alias("component")), "scc"))
            open_nodes = materialize(core, "open")
            links = materialize(_inside(links, open_nodes), "links")
            continue
        colour = materialize(open_nodes.withColumn("c", F.col("osmid")), "colour")
        while True:  # forward: the smallest id that reaches each node
            heard = links.join(colour.withColumnRenamed("osmid", "u"), "u").groupBy(F.col("v").alias("osmid")).agg(F.min("c").alias("m"))
            nxt = materialize(colour.join(heard, "osmid", "left").select("osmid", F.col("c").alias("was"), F.least("c", F.coalesce("m", "c")).alias("c")), "colour")
            same = nxt.where("was <> c").isEmpty()
            colour = nxt.select("osmid", "c")
            if same:
                break
        inner = materialize(links.join(colour.select(F.col("osmid").alias("u"), F.col("c").alias("cu")), "u").join(colour.select(F.col("osmid").alias("v"), F.col("c").alias("cv")), "v").where("cu = cv").select("u", "v"), "inner")
        back = materialize(colour.where("osmid = c").select("osmid"), "back")
        front, found = back, back
        while True:  # backward from the roots, inside their colour
            step = inner.join(front.withColumnRenamed("osmid", "v"), "v", "left_semi").select(F.col("u").alias("osmid")).distinct()
            front = materialize(step.join(found, "osmid", "left_anti"), "front")
            if front.isEmpty():
                break
            found = materialize(found.unionByName(front), "found")
        part = materialize(colour.join(found, "osmid", "left_semi").select("osmid", F.col("c").alias("component")), "scc")
        done.append(part)
        open_nodes = materialize(open_nodes.join(part, "osmid", "left_anti"), "open")
        links = materialize(_inside(links, open_nodes), "links")
    out = nodes.select("osmid", F.col("osmid").alias("component")).limit(0)
    for part in done:
        out = out.unionByName(part)
    # a component's name is its smallest member
    least = out.groupBy("component").agg(F.min("osmid").alias("m"))
    return out.join(least, "component").select("osmid", F.col("m").alias("component"))


def _strong_in_task(frame: pd.DataFrame) -> pd.DataFrame:
    """Strong components of a bounded edge list by two depth-first passes without recursion."""
    pairs = frame[["u", "v"]].to_numpy()
    ids = np.unique(pairs)
    a, b = np.searchsorted(ids, pairs[:, 0]), np.searchsorted(ids, pairs[:, 1])

    def adjacency(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(x, kind="stable")
        return np.searchsorted(x[order], np.arange(len(ids) + 1)), y[order]

    start, head = adjacency(a, b)
    seen, finish = np.zeros(len(ids), bool), []
    for root in range(len(ids)):
        if seen[root]:
            continue
        seen[root] = True
        stack = [(root, int(start[root]))]
        while stack:
            x, k = stack[-1]
            if k < start[x + 1]:
                stack[-1] = (x, k + 1)
                y = int(head[k])
                if not seen[y]:
                    seen[y] = True
                    stack.append((y, int(start[y])))
            else:
                finish.append(x)
                stack.pop()
    start, head = adjacency(b, a)
    label = np.full(len(ids), -1)
    for root in reversed(finish):
        if label[root] >= 0:
            continue
        members, stack = [], [root]
        label[root] = root
        while stack:
            x = stack.pop()
            members.append(x)
            for y in head[start[x]: start[x + 1]].tolist():
                if label[y] < 0:
                    label[y] = root
                    stack.append(y)
        label[members] = min(members)
    return pd.DataFrame({"osmid": ids, "component": ids[label]})


def _inside(links: DataFrame, nodes: DataFrame) -> DataFrame:
    return links.join(nodes.withColumnRenamed("osmid", "u"), "u", "left_semi").join(nodes.withColumnRenamed("osmid", "v"), "v", "left_semi").select("u", "v")


def distances_from(edges: DataFrame, source: int, weight: str = "length", limit: float | None = None) -> DataFrame:
    """``(osmid, dist)`` of all nodes reachable from ``source``, within ``limit`` where given.

    Rounds of relaxation: only nodes whose distance fell in a round send on, and the limit cuts every round.
    A missing weight counts as 1.
    """
    cost = F.coalesce(F.col(weight).cast("double"), F.lit(1.0))
    links = materialize(edges.where("u <> v").groupBy("u", "v").agg(F.min(cost).alias("w")), "links")
    spark = edges.sparkSession
    known = spark.createDataFrame([(source, 0.0)], "osmid bigint, dist double")
    front = known
    while True:
        reach = links.join(front.withColumnRenamed("osmid", "u"), "u").select(F.col("v").alias("osmid"), (F.col("dist") + F.col("w")).alias("d"))
        if limit is not None:
            reach = reach.where(F.col("d") <= limit)
        best = reach.groupBy("osmid").agg(F.min("d").alias("d"))
        both = materialize(known.join(best, "osmid", "full").select("osmid", F.col("dist").alias("was"), F.least("dist", "d").alias("dist")), "dist")
        front = both.where("was IS NULL OR dist < was").select("osmid", "dist")
        known = both.select("osmid", "dist")
        if front.isEmpty():
            return known


class _Index:
    """Adjacency arrays of a graph with at most one edge per pair, for searches inside one task."""

    def __init__(self, u: np.ndarray, v: np.ndarray, w: np.ndarray) -> None:
        self.ids = np.unique(np.concatenate((u, v)))
        a, b = np.searchsorted(self.ids, u), np.searchsorted(self.ids, v)
        order = np.lexsort((b, a))
        self.head, self.cost = b[order], w[order]
        self.start = np.searchsorted(a[order], np.arange(len(self.ids) + 1))

    def find(self, node: int) -> int:
        i = int(np.searchsorted(self.ids, node))
        return i if i < len(self.ids) and self.ids[i] == node else -1

    def search(self, source: int, target: int, banned_nodes: frozenset = frozenset(), banned_edges: frozenset = frozenset()) -> tuple[float, list[int]] | None:
        """Least cost and node path; among equal costs the first found in node order."""
        best, before, queue, closed = {source: 0.0}, {}, [(0.0, source)], set()
        while queue:
            d, x = heapq.heappop(queue)
            if x in closed:
                continue
            if x == target:
                path = [x]
                while x != source:
                    x = before[x]
                    path.append(x)
                return d, path[::-1]
            closed.add(x)
            for k in range(self.start[x], self.start[x + 1]):
                y = int(self.head[k])
                if y in closed or y in banned_nodes or (x, y) in banned_edges:
                    continue
                nd = d + float(self.cost[k])
                if nd < best.get(y, float("inf")):
                    best[y], before[y] = nd, x
                    heapq.heappush(queue, (nd, y))
        return None

    def tree(self, source: int) -> tuple[np.ndarray, np.ndarray]:
        """Least cost and node before, for every node; the same paths as ``search``. Unreached: infinity and -1."""
        best, before = np.full(len(self.ids), np.inf), np.full(len(self.ids), -1)
        best[source] = 0.0
        queue, closed = [(0.0, source)], bytearray(len(self.ids))
        while queue:
            d, x = heapq.heappop(queue)
            if closed[x]:
                continue
            closed[x] = 1
            a, b = self.start[x], self.start[x + 1]
            for y, w in zip(self.head[a:b].tolist(), self.cost[a:b].tolist()):
                if not closed[y] and d + w < best[y]:
                    best[y], before[y] = d + w, x
                    heapq.heappush(queue, (d + w, y))
        return best, before

    def turn(self) -> None:
        """Adjacency of the turned edges, for searches towards a source."""
        if not hasattr(self, "tails"):
            a = np.repeat(np.arange(len(self.ids)), np.diff(self.start))
            order = np.lexsort((a, self.head))
            self.tails, self.back_cost = a[order], self.cost[order]
            self.back = np.searchsorted(self.head[order], np.arange(len(self.ids) + 1))

    def _detour(self, node: int, source: int, best: np.ndarray, banned_nodes: set, cut: set, limit: float) -> list[int] | None:
        """Cheapest way back from ``node`` to ``source`` at most ``limit`` long; the tree's distances guide it, so it seldom strays."""
        known, after, queue, closed = {node: 0.0}, {}, [(float(best[node]), node)], set()
        while queue:
            f, x = heapq.heappop(queue)
            if f > limit:
                return None
            if x in closed:
                continue
            if x == source:
                path = [x]
                while x != node:
                    x = after[x]
                    path.append(x)
                return path[::-1]
            closed.add(x)
            g, a, b = known[x], self.back[x], self.back[x + 1]
            for y, w in zip(self.tails[a:b].tolist(), self.back_cost[a:b].tolist()):
                if y in closed or y in banned_nodes or (x == node and y in cut):
                    continue
                if g + w < known.get(y, float("inf")) and best[y] < float("inf"):
                    known[y], after[y] = g + w, x
                    heapq.heappush(queue, (g + w + float(best[y]), y))
        return None

    def from_tree(self, source: int, target: int, k: int, best: np.ndarray, before: np.ndarray) -> Iterator[tuple[float, list[int]]]:
        """What ``k_best`` gives, from the tree of the source: paths are taken from the target back, so one tree guides all detours."""
        if best[target] == np.inf:
            return
        path = [target]
        while path[-1] != source:
            path.append(int(before[path[-1]]))
        yield float(best[target]), path[::-1]
        if k == 1:
            return
        self.turn()
        found, waiting, last, at = [path], [], path, 0
        while len(found) < k:
            costs = sorted(c for c, *_ in waiting)
            for i in range(at, len(last) - 1):  # earlier places were tried when the path that this one left was found
                root = last[: i + 1]
                cut = {p[i + 1] for p in found if p[: i + 1] == root and len(p) > i + 1}
                need = k - len(found)
                limit = costs[need - 1] * (1 + 1e-9) + 1e-9 if len(costs) >= need else float("inf")
                spur = self._detour(root[-1], source, best, set(root[:-1]), cut, limit - self.path_cost(root[::-1]))
                if spur is not None:
                    whole = root[:-1] + spur
                    cost = self.path_cost(whole[::-1])
                    heapq.heappush(waiting, (cost, whole[::-1], i))
                    costs = sorted([*costs, cost])
            if not waiting:
                return
            cost, forward, at = heapq.heappop(waiting)
            last = forward[::-1]
            found.append(last)
            yield cost, forward

    def path_cost(self, path: list[int]) -> float:
        total = 0.0
        for x, y in zip(path[:-1], path[1:]):
            k = self.start[x] + int(np.searchsorted(self.head[self.start[x]: self.start[x + 1]], y))
            total += float(self.cost[k])
        return total

    def k_best(self, source: int, target: int, k: int) -> Iterator[tuple[float, list[int]]]:
        """Loopless paths in order of cost: each next one leaves a known one at its cheapest detour."""
        first = self.search(source, target)
        if first is None:
            return
        found, waiting, seen = [first], [], {tuple(first[1])}
        yield first
        while len(found) < k:
            _, last = found[-1]
            for i in range(len(last) - 1):
                root = last[: i + 1]
                cut = frozenset((p[i], p[i + 1]) for _, p in found if p[: i + 1] == root and len(p) > i + 1)
                spur = self.search(root[-1], target, frozenset(root[:-1]), cut)
                if spur is not None:
                    path = root[:-1] + spur[1]
                    if tuple(path) not in seen:
                        seen.add(tuple(path))
                        heapq.heappush(waiting, (self.path_cost(path), path))
            if not waiting:
                return
            found.append(heapq.heappop(waiting))
            yield found[-1]


def shortest_paths(pairs: DataFrame, edges: DataFrame, weight: str = "length", k: int = 1) -> DataFrame:
    """``(route_id, orig, dest, rank, cost, nodes)`` for rows ``(route_id, orig, dest)``; no route: one row with null nodes.

    The graph, one edge per pair of nodes, is sent to the tasks only after its
    size was checked. Beyond ``MAX_INDEX_EDGES`` the routes come from relaxation
    rounds over all origins at once (``routes_by_rounds``), which give the best
    route only: more than one per pair then raises.
    """
    cost = F.coalesce(F.col(weight).cast("double"), F.lit(1.0))
    least = materialize(edges.where("u <> v").groupBy("u", "v").agg(F.min(cost).alias("w")), "links")
    if least.count() > MAX_INDEX_EDGES:
        if k > 1:
            raise ValueError("the graph is too large for searches inside tasks: only the best route can be found")
        return routes_by_rounds(pairs, least)
    table = least.toArrow()
    shared = edges.sparkSession.sparkContext.broadcast([table[c].to_numpy() for c in ("u", "v", "w")])

    columns = ["route_id", "orig", "dest", "rank", "cost", "nodes"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index, root, tree = _Index(*shared.value), None, None
        for batch in batches:
            rows = []
            often = batch["orig"].value_counts()
            for route, a, b in batch[["route_id", "orig", "dest"]].sort_values("orig").itertuples(index=False):
                s, t = (index.find(int(x)) if pd.notna(x) else -1 for x in (a, b))
                if s < 0 or t < 0:
                    got = []
                elif s != root and often[a] == 1:
                    got = list(index.k_best(s, t, k))
                else:  # an origin of several routes: one search tree serves them all
                    if s != root:
                        root, tree = s, index.tree(s)
                    got = list(index.from_tree(s, t, k, *tree))
                rows += [(route, a, b, i, c, [int(index.ids[x]) for x in p]) for i, (c, p) in enumerate(got, 1)] or [(route, a, b, 1, None, None)]
                if len(rows) >= 2000:
                    yield pd.DataFrame(rows, columns=columns)
                    rows = []
            yield pd.DataFrame(rows, columns=columns)

    spread = pairs.select("route_id", "orig", "dest").repartition(2 * edges.sparkSession.sparkContext.defaultParallelism)
    return spread.mapInPandas(run, "route_id bigint, orig bigint, dest bigint, rank int, cost double, nodes array<bigint>")


def routes_by_rounds(pairs: DataFrame, links: DataFrame) -> DataFrame:
    """What ``shortest_paths`` gives for k = 1, on links ``(u, v, w)`` of any size.

    All origins relax together, only nodes whose distance fell send on, and each keeps the node before it (among equal
    costs the smallest). Routes are then walked back from their destinations, one step of all routes a round.
    """
    asked = materialize(pairs.select("route_id", "orig", "dest"), "asked")
    known_ids = links.select(F.explode(F.array("u", "v")).alias("osmid")).distinct()
    origins = asked.select(F.col("orig").alias("osmid")).where("osmid IS NOT NULL").distinct().join(known_ids, "osmid", "left_semi")
    known = materialize(origins.select(F.col("osmid").alias("orig"), "osmid", F.lit(0.0).alias("dist"), F.lit(None).cast("bigint").alias("before")), "tree")
    front = known
    while not front.isEmpty():
        reach = links.join(front.select("orig", F.col("osmid").alias("u"), "dist"), "u").select("orig", F.col("v").alias("osmid"), (F.col("dist") + F.col("w")).alias("d"), F.col("u").alias("b"))
        best = reach.groupBy("orig", "osmid").agg(F.min(F.struct("d", "b")).alias("r")).select("orig", "osmid", "r.d", "r.b")
        fell = F.col("dist").isNull() | (F.col("d") < F.col("dist"))
        both = known.join(best, ["orig", "osmid"], "full")
        both = materialize(both.select("orig", "osmid", F.when(F.col("d").isNotNull() & fell, F.col("d")).otherwise(F.col("dist")).alias("dist"),
                                       F.when(F.col("d").isNotNull() & fell, F.col("b")).otherwise(F.col("before")).alias("before"), (F.col("d").isNotNull() & fell).alias("fell")), "tree")
        known, front = both.drop("fell"), both.where("fell").select("orig", "osmid", "dist")
    done = asked.join(known.select("orig", F.col("osmid").alias("dest"), "dist", "before"), ["orig", "dest"], "left")
    done = materialize(done.select("route_id", "orig", "dest", F.col("dist").alias("cost"), "before"), "routes")
    walk = done.where("cost IS NOT NULL").select("route_id", "orig", F.col("dest").alias("node"), F.lit(0).alias("back"), "before")
    steps = [walk.select("route_id", "orig", "node", "back")]
    at = walk.where("before IS NOT NULL")
    tree = known.select("orig", F.col("osmid").alias("node"), F.col("before").alias("next"))
    while not at.isEmpty():
        at = materialize(at.select("route_id", "orig", F.col("before").alias("node"), (F.col("back") + 1).alias("back")).join(tree, ["orig", "node"]).select(
            "route_id", "orig", "node", "back", F.col("next").alias("before")), "walk")
        steps.append(at.select("route_id", "orig", "node", "back"))
        at = at.where("before IS NOT NULL")
    every = steps[0]
    for part in steps[1:]:
        every = every.unionByName(part)
    lists = every.groupBy("route_id", "orig").agg(F.sort_array(F.collect_list(F.struct("back", "node")), asc=False).alias("p"))  # one route's nodes
    out = done.join(lists, ["route_id", "orig"], "left")
    return out.select("route_id", "orig", "dest", F.lit(1).alias("rank"), "cost", F.transform("p", lambda s: s["node"]).alias("nodes"))
