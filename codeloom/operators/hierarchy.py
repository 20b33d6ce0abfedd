"""Parent-child links to full hierarchies.

Method: connected components of the links, each component in one place, an iterative
depth-first traversal with node colouring there; back edges tell what hangs below a cycle.

A component of more than ``max_links`` links never goes to one task. Its nodes are handled
by joins instead: chains of single-parent nodes shrink to their nearest root or junction
(a node with several parents) by pointer doubling, which takes logarithmically many rounds;
junctions are then settled in topological rounds, and strongly connected parts by colouring.
Both ways give the same rows.

Defined results: links with a null end are ignored, repeated links count once, a self link
is a cycle, the links that close cycles are those inside a strongly connected part with
source >= target (every cycle has one), an empty input gives empty results. A node on a cycle or reachable from one has
the single row (node_id, '', -1) and no paths or descendants. Ties between shortest paths go
to the path that is least as an array of ids.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.operators.components import connected_components
from codeloom.plans.scratch import Scratch

MAX_LINKS = 250_000
OUT_ROWS = 20_000
#: Levels after which a growing union is written, so that plans stay small however deep a graph is.
PLAN_LEVELS = 8
SCHEMAS = {
    "roots": "node_id string, root_id string, tree_depth int",
    "paths": "node_id string, root_id string, tree_depth int, path array<string>",
    "descendants": "node_id string, descendant_id string, distance int",
    "cycles": "source string, target string",
}
ARROW = {
    "roots": pa.schema([("node_id", pa.string()), ("root_id", pa.string()), ("tree_depth", pa.int32())]),
    "paths": pa.schema([("node_id", pa.string()), ("root_id", pa.string()), ("tree_depth", pa.int32()), ("path", pa.list_(pa.string()))]),
    "descendants": pa.schema([("node_id", pa.string()), ("descendant_id", pa.string()), ("distance", pa.int32())]),
    "cycles": pa.schema([("source", pa.string()), ("target", pa.string())]),
}
WHITE, GREY, BLACK = 0, 1, 2


def colour(children: dict[str, list[str]], nodes: list[str], roots: list[str]) -> tuple[list[str], list[tuple[str, str]]]:
    """Post-order of all nodes and the back edges, by an iterative depth-first traversal."""
    state = dict.fromkeys(nodes, WHITE)
    post, back = [], []
    for start in [*roots, *nodes]:
        if state[start] != WHITE:
            continue
        state[start] = GREY
        stack = [(start, iter(children.get(start, ())))]
        while stack:
            node, rest = stack[-1]
            for child in rest:
                if state[child] == WHITE:
                    state[child] = GREY
                    stack.append((child, iter(children.get(child, ()))))
                    break
                if state[child] == GREY:
                    back.append((node, child))
            else:
                state[node] = BLACK
                post.append(node)
                stack.pop()
    return post, back


def strong_parts(post: list[str], parents: dict[str, list[str]]) -> dict[str, str]:
    """A node of its strongly connected part for every node, by walks against the links in falling post-order."""
    part: dict[str, str] = {}
    for start in reversed(post):
        todo = [start]
        while todo:
            x = todo.pop()
            if x not in part:
                part[x] = start
                todo += (p for p in parents.get(x, ()) if p not in part)
    return part


def traverse(links: list[tuple[str, str]], what: str) -> Iterator[tuple]:
    """The rows of one or several whole components."""
    links = sorted(set(links))
    children: dict[str, list[str]] = {}
    parents: dict[str, list[str]] = {}
    for s, t in links:
        children.setdefault(s, []).append(t)
        parents.setdefault(t, []).append(s)
    nodes = list(dict.fromkeys(x for link in links for x in link))
    roots = [x for x in nodes if x not in parents]
    post, back = colour(children, nodes, roots)
    if what == "cycles":
        part = strong_parts(post, parents)
        yield from ((s, t) for s, t in links if s >= t and part[s] == part[t])
        return
    tainted, todo = set(), [t for _, t in back]
    while todo:
        x = todo.pop()
        if x not in tainted:
            tainted.add(x)
            todo += children.get(x, ())
    order = [x for x in reversed(post) if x not in tainted]
    if what == "descendants":
        for start in order:
            seen, level, distance = {start}, [start], 0
            while level:
                distance += 1
                level = [c for x in level for c in children.get(x, ()) if c not in tainted and not (c in seen or seen.add(c))]
                for c in level:
                    yield start, c, distance
        return
    best: dict[str, dict[str, tuple]] = {}
    with_path = what == "paths"
    for x in order:
        own = best[x] = {}
        if x not in parents:
            own[x] = (0, (x,)) if with_path else 0
        elif with_path:
            for p in parents[x]:
                for root, (depth, path) in best[p].items():
                    if root not in own or (depth + 1, path) < (own[root][0], own[root][1][:-1]):
                        own[root] = (depth + 1, (*path, x))
        else:
            for p in parents[x]:
                for root, depth in best[p].items():
                    if own.get(root, depth + 2) > depth + 1:
                        own[root] = depth + 1
    for x in order:
        for root, value in best[x].items():
            yield (x, root, value[0], list(value[1])) if with_path else (x, root, value)
    for x in sorted(tainted):
        yield (x, "", -1, None) if with_path else (x, "", -1)


def _traversal(what: str):
    schema = ARROW[what]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []

        def flush(least: int) -> Iterator[pa.RecordBatch]:
            while out and len(out) >= least:
                part, out[:OUT_ROWS] = out[:OUT_ROWS], []
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part), schema)], schema=schema)

        at, links = None, []
        for batch in batches:
            for comp, s, t in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if comp != at:
                    if links:
                        for row in traverse(links, what):
                            out.append(row)
                            if len(out) >= OUT_ROWS:
                                yield from flush(OUT_ROWS)
                    at, links = comp, []
                links.append((s, t))
        for row in traverse(links, what):
            out.append(row)
            if len(out) >= OUT_ROWS:
                yield from flush(OUT_ROWS)
        yield from flush(1)

    return run


def hierarchy(links: DataFrame, scratch: Scratch, what: str = "roots", max_links: int = MAX_LINKS) -> DataFrame:
    """Rows ``what`` (see SCHEMAS) of the hierarchies that ``links`` (source, target) form."""
    links = scratch.spool(links.select("source", "target").where("source is not null and target is not null").distinct())
    hashed = links.select(F.xxhash64("source").alias("a"), F.xxhash64("target").alias("b"))
    comps = connected_components(hashed, scratch)
    placed = scratch.spool(links.withColumn("v", F.xxhash64("source")).join(comps, "v").select("comp", "source", "target"))
    giant = scratch.spool(placed.groupBy("comp").count().where(F.col("count") > max_links).select("comp"))
    has_giant = not giant.isEmpty()
    small = placed.join(giant, "comp", "left_anti") if has_giant else placed
    rows = small.repartition("comp").sortWithinPartitions("comp").mapInArrow(_traversal(what), SCHEMAS[what])
    if has_giant:
        rows = rows.unionByName(_by_joins(placed.join(giant, "comp", "left_semi").select("source", "target"), scratch, what))
    return rows


def _by_joins(links: DataFrame, scratch: Scratch, what: str) -> DataFrame:
    """The rows of components of any size, without gathering a component.

    Ways are carried only where paths are asked for: other rows need lengths alone.
    """
    with_path = what == "paths"
    way = lambda name, column: [column.alias(name)] if with_path else []
    nothing = F.array().cast("array<string>")
    ends = links.select(F.col("source").alias("v"), F.lit(0).alias("n")).unionByName(links.select(F.col("target").alias("v"), F.lit(1).alias("n")))
    nodes = scratch.spool(ends.groupBy("v").agg(F.sum("n").alias("parents")))
    only = links.groupBy("target").agg(F.min("source").alias("parent")).withColumnRenamed("target", "v")
    pointers = nodes.join(only, "v", "left")
    kind = nodes.select(F.col("v").alias("parent"), (F.col("parents") != 1).alias("done"))
    fixed = F.col("parents") != 1
    pointers = pointers.join(kind, "parent", "left").select(
        "v", F.when(fixed, F.col("v")).otherwise(F.col("parent")).alias("anchor"), F.when(fixed, 0).otherwise(1).alias("dist"),
        F.when(fixed, F.lit(True)).otherwise(F.coalesce("done", F.lit(False))).alias("done"), *way("tail", F.when(fixed, nothing).otherwise(F.array("v"))),
    )
    pointers = scratch.spool(pointers)
    settled, open_now, last = pointers.where("done"), scratch.spool(pointers.where("not done")), None
    # Only what is open moves; what has met its anchor is written once. Chains halve in every round.
    known = pointers
    while (left := open_now.count()) and left != last:
        last = left
        q = known.select(F.col("v").alias("anchor"), F.col("anchor").alias("a2"), F.col("dist").alias("d2"), F.col("done").alias("done2"), *way("t2", F.col("tail") if with_path else None))
        moved = open_now.join(q, "anchor").select("v", F.col("a2").alias("anchor"), (F.col("dist") + F.col("d2")).alias("dist"), F.col("done2").alias("done"), *way("tail", F.concat("t2", "tail") if with_path else None))
        moved = scratch.spool(moved)
        settled, open_now = settled.unionByName(moved.where("done")), moved.where("not done")
        known = settled.unionByName(open_now)
    # Pointers still open run round a cycle of single-parent nodes.
    settled = scratch.spool(settled)
    to_junction = links.join(nodes.where("parents > 1").select(F.col("v").alias("target")), "target", "left_semi")
    p = settled.select(F.col("v").alias("source"), "anchor", "dist", *way("tail", F.col("tail") if with_path else None)).withColumn("done", F.lit(True))
    inner = scratch.spool(to_junction.join(p, "source", "left").select(F.col("target").alias("j"), "anchor", (F.col("dist") + 1).alias("dist"), F.coalesce("done", F.lit(False)).alias("done"), *way("tail", F.col("tail") if with_path else None)))
    need = scratch.spool(inner.groupBy("j").agg(F.count(F.lit(1)).alias("need")))
    roots = nodes.where("parents = 0").select("v", F.col("v").alias("root"), F.lit(0).alias("depth"), *way("path", F.array("v")))
    reach = scratch.spool(roots)
    ready, rounds = reach.select("v"), 0
    while not ready.isEmpty():
        met = inner.where("done").join(ready.select(F.col("v").alias("anchor")), "anchor", "left_semi").groupBy("j").agg(F.count(F.lit(1)).alias("met"))
        rest = scratch.spool(need.join(met, "j", "left").select("j", (F.col("need") - F.coalesce("met", F.lit(0))).alias("need")))
        ready = scratch.spool(rest.where("need = 0").select(F.col("j").alias("v")))
        later = scratch.spool(rest.where("need > 0"))
        scratch.drop(need, rest)
        need, rounds = later, rounds + 1
        at = inner.join(ready.select(F.col("v").alias("j")), "j", "left_semi").join(reach.withColumnRenamed("v", "anchor"), "anchor")
        depth = (F.col("dist") + F.col("depth")).alias("depth")
        if with_path:
            best = at.groupBy(F.col("j").alias("v"), "root").agg(F.min(F.struct(depth, F.concat("path", "tail").alias("path"))).alias("best"))
            fresh = best.select("v", "root", "best.depth", F.concat("best.path", F.array("v")).alias("path"))
        else:
            fresh = at.groupBy(F.col("j").alias("v"), "root").agg(F.min(depth).alias("depth"))
        # A round's rows are written once; the union of rounds is written anew only now and then, to keep plans small.
        reach = reach.unionByName(scratch.spool(fresh))
        reach = scratch.spool(reach) if rounds % PLAN_LEVELS == 0 else reach
    good = settled.join(need.select(F.col("j").alias("anchor")), "anchor", "left_anti")
    if what in ("roots", "paths"):
        found = good.join(reach.withColumnRenamed("v", "anchor"), "anchor").select(F.col("v").alias("node_id"), F.col("root").alias("root_id"), (F.col("dist") + F.col("depth")).cast("int").alias("tree_depth"), *way("path", F.concat("path", "tail") if with_path else None))
        bad = nodes.join(good.select("v"), "v", "left_anti").select(F.col("v").alias("node_id"), F.lit("").alias("root_id"), F.lit(-1).alias("tree_depth"), *way("path", F.lit(None).cast("array<string>")))
        return found.unionByName(bad)
    clean = links.join(good.select(F.col("v").alias("source")), "source", "left_semi").join(good.select(F.col("v").alias("target")), "target", "left_semi")
    if what == "descendants":
        steps = scratch.spool(clean)
        level, distance = steps.select(F.col("source").alias("node_id"), F.col("target").alias("descendant_id"), F.lit(1).alias("distance")), 1
        known = level
        while not level.isEmpty():
            distance += 1
            wider = level.select("node_id", F.col("descendant_id").alias("source")).join(steps, "source").select("node_id", F.col("target").alias("descendant_id")).distinct()
            level = scratch.spool(wider.join(known, ["node_id", "descendant_id"], "left_anti").withColumn("distance", F.lit(distance)))
            known = known.unionByName(level)
            known = scratch.spool(known) if distance % PLAN_LEVELS == 0 else known
        return known
    tainted = nodes.join(good.select("v"), "v", "left_anti").select("v")
    return _cycle_links(links, tainted, scratch)


def _cycle_links(links: DataFrame, tainted: DataFrame, scratch: Scratch) -> DataFrame:
    """Links inside a strongly connected part with source >= target.

    What has no way in or out is peeled; the rest is coloured forwards by the least node that reaches
    it and backwards within a colour, until every node is settled. No pairs beyond links are made.
    """
    inside = links.join(tainted.select(F.col("v").alias("source")), "source", "left_semi").join(tainted.select(F.col("v").alias("target")), "target", "left_semi")
    live, found = scratch.spool(inside), links.where("false")
    while True:
        size = None
        while (now := live.count()) != size:
            size, old = now, live
            kept = live.join(live.select(F.col("source").alias("target")).distinct(), "target", "left_semi").join(live.select(F.col("target").alias("source")).distinct(), "source", "left_semi")
            live = scratch.spool(kept.select("source", "target"))
            scratch.drop(old)
        if not size:
            return found
        nodes = live.select(F.col("source").alias("v")).union(live.select("target")).distinct()
        colours = fresh = scratch.spool(nodes.select("v", F.col("v").alias("colour")))
        while not fresh.isEmpty():
            offers = live.join(fresh.withColumnRenamed("v", "source"), "source").groupBy(F.col("target").alias("v")).agg(F.min("colour").alias("offer"))
            both = scratch.spool(colours.join(offers, "v", "left").select("v", F.least("colour", "offer").alias("colour"), F.coalesce(F.col("offer") < F.col("colour"), F.lit(False)).alias("new")))
            scratch.drop(colours)
            colours, fresh = both.select("v", "colour"), both.where("new").select("v", "colour")
        s, t = colours.select(F.col("v").alias("source"), F.col("colour").alias("cs")), colours.select(F.col("v").alias("target"), F.col("colour").alias("ct"))
        same = scratch.spool(live.join(s, "source").join(t, "target").where("cs = ct").select("source", "target", F.col("cs").alias("colour")))
        done = level = scratch.spool(colours.where("v = colour"))
        step = 0
        while not level.isEmpty():
            step += 1
            wider = same.join(level.select(F.col("v").alias("target")), "target").select(F.col("source").alias("v"), "colour").distinct()
            level = scratch.spool(wider.join(done, ["v", "colour"], "left_anti"))
            done = done.unionByName(level)
            done = scratch.spool(done) if step % PLAN_LEVELS == 0 else done
        ids = scratch.spool(done.select("v"))
        ends = [ids.withColumnRenamed("v", c) for c in ("source", "target")]
        found = found.unionByName(scratch.spool(same.where("source >= target").join(ends[0], "source", "left_semi").join(ends[1], "target", "left_semi").select("source", "target")))
        live = scratch.spool(live.join(ends[0], "source", "left_anti").join(ends[1], "target", "left_anti"))
