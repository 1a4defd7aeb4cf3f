"""Parent-child rows to full hierarchies: path, depth, root, descendants and cycles.

Frontier joins start at the roots and extend paths and depths by bands of 1, 2, 4, ... levels: a node whose way of
that many steps ends on a node with a known path gets its own, the ways of all others are doubled. The same joins
give ancestor pairs at distances 1, 2, 4, ..., whose sums, taken map-side first, count the descendants without
listing them. Rows leave the joins as soon as neither they nor anything below them is open, so all joins together
stay in proportion to the rows, and numbers stand for ids in all keys. Ways that never leave the table, however
often they are doubled, belong to nodes on cycles or below them; there the cycles are cut and serve as roots.
Each join is written to the shared folder, so a lost executor costs one join and plans stay short.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forgeline.session import materialize, materialize_counted

TREE, ON_CYCLE, BELOW_CYCLE = "tree", "on_cycle", "below_cycle"
SEPARATOR = " > "


def _links(df: DataFrame, node: str, parent: str, name: str) -> DataFrame:
    """One row a node: ``num``, ``id``, ``name``, and ``up``, the number of the parent where that is a node too."""
    nodes = (
        df.filter(F.col(node).isNotNull())
        .groupBy(F.col(node).cast("string").alias("id"))
        .agg(F.min(F.col(parent).cast("string")).alias("named"), F.min(F.coalesce(F.col(name), F.lit(""))).alias("name"))
        .withColumn("num", F.monotonically_increasing_id())
    )
    nodes = materialize(nodes, "nodes")  # numbers are fixed once they are written
    known = nodes.select(F.col("id").alias("named"), F.col("num").alias("up"))
    return materialize(nodes.join(known, "named", "left").select("num", "id", "name", "up"), "links")


def _doubled(ways: DataFrame) -> DataFrame:
    """Ways of twice the steps; those that end above a root are gone."""
    return ways.join(ways.select(F.col("num").alias("up"), F.col("up").alias("then")), "up").select("num", F.col("then").alias("up"))


def _unrooted(links: DataFrame) -> tuple[DataFrame, int] | None:
    """The nodes that no root reaches, with the end of a long way up; None where there are none."""
    ways, n = materialize_counted(links.filter(F.col("up").isNotNull()).select("num", "up"), "ways")
    while n:
        ways, left = materialize_counted(_doubled(ways), "ways")
        if left == n:  # no node hangs at this height, so none hangs higher
            return ways, n
        n = left
    return None


def _on_cycles(ways: DataFrame, n: int) -> DataFrame:
    """``num`` of the nodes on cycles. The ends of all ways shrink to them; once their number stays, a step permutes
    them, which nodes below a cycle do not take part in."""
    while True:
        ends, n_ends = materialize_counted(ways.select(F.col("up").alias("num")).distinct(), "ends")
        if n_ends == n:
            return ends
        n, ways = n_ends, materialize(_doubled(ways), "ways")


def _cycle_labels(cycle: DataFrame) -> DataFrame:
    """``num, label`` of the nodes ``num, up`` of cycles; the label is the least number of the cycle."""
    walk, changed = materialize_counted(cycle.select("num", "up", F.least("num", "up").alias("label"), F.lit(True).alias("new")), "walk")
    while changed:
        ahead = walk.select(F.col("num").alias("up"), F.col("up").alias("then"), F.col("label").alias("least"))
        step = walk.drop("new").join(ahead, "up").select("num", F.col("then").alias("up"), F.least("label", "least").alias("label"), (F.col("least") < F.col("label")).alias("new"))
        walk, changed = materialize_counted(step, "walk", F.col("new"))
    return walk.select("num", "label")


def _climb(start: DataFrame, joined: Callable[[Column, Column], Column]) -> DataFrame:
    """All rows of a forest with ``top, depth, way, below``, from ``num, id, up, way, in_tree``.

    ``way`` holds what is told of the nodes on the way down to a row, put together by ``joined``; ``below`` is the
    number of nodes under the row.
    """
    root = F.col("up").isNull()
    rows, n_open = materialize_counted(
        start.select("num", "id", "up", "way", "in_tree", F.when(root, F.col("id")).alias("top"), F.when(root, F.lit(0).cast("long")).alias("depth"), F.lit(0).cast("long").alias("below"), F.lit(True).alias("live")), "band", ~root
    )
    finished, steps = [], 1
    while n_open:
        finished.append(rows.filter(~F.col("live")))
        now = rows.filter("live")
        # pairs of ancestors and nodes that many steps under them, summed before they are shuffled
        deeper = now.filter(F.col("up").isNotNull()).groupBy(F.col("up").alias("num")).agg(F.sum(F.col("below") + 1).alias("more"))
        grown = now.join(deeper, "num", "left").withColumn("live", F.col("more").isNotNull()).withColumn("below", F.col("below") + F.coalesce("more", F.lit(0))).drop("more")
        heads = grown.filter("live").select(F.col("num").alias("up"), F.col("up").alias("then"), F.col("top").alias("head_top"), F.col("depth").alias("head_depth"), F.col("way").alias("head"))
        moved = (
            grown.filter(F.col("up").isNotNull())
            .join(heads, "up")
            .select(
                "num", "id", F.col("then").alias("up"), joined(F.col("head"), F.col("way")).alias("way"), "in_tree", F.col("head_top").alias("top"), (F.col("head_depth") + steps).alias("depth"), "below",
                (F.col("live") | F.col("then").isNotNull()).alias("live"),
            )
        )
        rows, n_open = materialize_counted(moved.unionByName(grown.filter(root)), "band", F.col("up").isNotNull())
        steps *= 2
    for done in finished:
        rows = rows.unionByName(done)
    return rows


def _resolve(df: DataFrame, node: str, parent: str, name: str, way: Callable[[Column], Column], joined: Callable[[Column, Column], Column]) -> tuple[DataFrame, DataFrame | None]:
    """All nodes as rows of a forest, in which nodes on cycles are roots; and ``num, label`` of the latter, if any.
    ``way`` gives what a node adds to its way, from whether it is in a tree."""
    links = _links(df, node, parent, name)
    lost = _unrooted(links)
    if lost is None:
        return _climb(links.select("num", "id", "up", way(F.lit(True)).alias("way"), F.lit(True).alias("in_tree")), joined), None
    ends = _on_cycles(*lost)
    marked = links.join(lost[0].select("num", F.lit(False).alias("in_tree")), "num", "left").join(ends.withColumn("ring", F.lit(True)), "num", "left")
    marked = materialize(marked.select("num", "id", "name", "up", F.coalesce("in_tree", F.lit(True)).alias("in_tree"), F.coalesce("ring", F.lit(False)).alias("ring")), "marked")
    cut = marked.select("num", "id", F.when(~F.col("ring"), F.col("up")).alias("up"), way(F.col("in_tree")).alias("way"), "in_tree")
    return _climb(cut, joined), _cycle_labels(marked.filter("ring").select("num", "up"))


def _state(in_tree: Column, depth: Column) -> Column:
    return F.when(in_tree, TREE).when(depth == 0, ON_CYCLE).otherwise(BELOW_CYCLE)


def resolve_hierarchy(df: DataFrame, node: str = "node_id", parent: str = "parent_node_id", name: str = "name") -> DataFrame:
    """One row a node: ``node_id, root_node_id, depth, node_path, n_descendants, state``.

    A parent that is null, empty or not a node makes a root. Repeated ids count once (the least parent and name
    hold where repeats disagree); rows without an id are left out; a null name is an empty one. Nodes that no root
    reaches have state ``on_cycle`` or ``below_cycle``, empty root and path and depth -1. An empty table gives an
    empty result. Other columns of ``df`` are not read, so their names do not matter.
    """
    rows, labels = _resolve(df, node, parent, name, lambda tree: F.when(tree, F.col("name")), lambda head, tail: F.concat(head, F.lit(SEPARATOR), tail))
    rows = rows.withColumn("state", _state(F.col("in_tree"), F.col("depth")))
    if labels is not None:
        ring = rows.filter(F.col("state") == ON_CYCLE).join(labels, "num")
        sizes = ring.groupBy("label").agg((F.sum(F.col("below") + 1) - 1).alias("size"))
        rows = rows.filter(F.col("state") != ON_CYCLE).unionByName(ring.join(sizes, "label").withColumn("below", F.col("size")).select(rows.columns))
    tree = F.col("state") == TREE
    return rows.select(
        F.col("id").alias("node_id"), F.when(tree, F.col("top")).otherwise("").alias("root_node_id"), F.when(tree, F.col("depth")).otherwise(F.lit(-1).cast("long")).alias("depth"),
        F.when(tree, F.col("way")).otherwise("").alias("node_path"), F.col("below").alias("n_descendants"), "state",
    )


def descendants(df: DataFrame, node: str = "node_id", parent: str = "parent_node_id", name: str = "name") -> DataFrame:
    """All pairs ``ancestor_id, node_id`` of different nodes where parents lead from the node to the ancestor.

    The cases of :func:`resolve_hierarchy` hold. Every node of a cycle is above all others of its component; as
    those pairs grow with the square of a cycle, :func:`cycle_members` gives the same as one row a node.
    """
    rows, labels = _resolve(df, node, parent, name, lambda tree: F.array("id"), lambda head, tail: F.concat(head, tail))
    above = F.slice("way", F.when(F.col("in_tree"), 1).otherwise(2), F.greatest(F.size("way") - F.when(F.col("in_tree"), 1).otherwise(2), F.lit(0)))
    pairs = rows.select(F.explode(above).alias("ancestor_id"), F.col("id").alias("node_id"))
    if labels is None:
        return pairs
    members = _members(rows, labels)
    ring = members.filter(F.col("state") == ON_CYCLE).select(F.col("node_id").alias("ancestor_id"), "cycle_id")
    return pairs.unionByName(ring.join(members, "cycle_id").filter("ancestor_id <> node_id").select("ancestor_id", "node_id"))


def _members(rows: DataFrame, labels: DataFrame) -> DataFrame:
    ring = rows.filter(~F.col("in_tree") & (F.col("depth") == 0)).join(labels, "num").select(F.col("id").alias("top"), "label")
    named = ring.join(ring.groupBy("label").agg(F.min("top").alias("cycle_id")), "label").select("top", "cycle_id")
    return rows.filter(~F.col("in_tree")).join(named, "top").select(F.col("id").alias("node_id"), "cycle_id", _state(F.col("in_tree"), F.col("depth")).alias("state"), F.col("depth").alias("distance"))


def cycle_members(df: DataFrame, node: str = "node_id", parent: str = "parent_node_id", name: str = "name") -> DataFrame:
    """``node_id, cycle_id, state, distance`` of each node on a cycle or below one.

    ``cycle_id`` is the least id on the cycle and ``distance`` the number of steps to it, 0 on the cycle. The cases of
    :func:`resolve_hierarchy` hold.
    """
    rows, labels = _resolve(df, node, parent, name, lambda tree: F.lit(""), lambda head, tail: tail)
    if labels is None:
        return rows.limit(0).select(F.col("id").alias("node_id"), F.col("id").alias("cycle_id"), F.lit(BELOW_CYCLE).alias("state"), F.col("depth").alias("distance"))
    return _members(rows, labels)
