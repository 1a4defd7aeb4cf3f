"""Queries of problem 3: hierarchies from graph_nodes."""

from forgeline.operators.hierarchy import cycle_members, descendants, resolve_hierarchy
from forgeline.session import table


def p3_found(spark, sf_dir):
    return resolve_hierarchy(table(spark, sf_dir, "graph_nodes"))


def p3_descendants(spark, sf_dir):
    return descendants(table(spark, sf_dir, "graph_nodes"))


def p3_cycles(spark, sf_dir):
    return cycle_members(table(spark, sf_dir, "graph_nodes"))


QUERIES = {"p3_found": p3_found, "p3_descendants": p3_descendants, "p3_cycles": p3_cycles}

_BASE = """
WITH RECURSIVE n AS (
  SELECT node_id AS id, min(parent_node_id) AS named, min(coalesce(name, '')) AS name FROM graph_nodes WHERE node_id IS NOT NULL GROUP BY node_id
), e AS (
  SELECT n.id, n.name, p.id AS parent FROM n LEFT JOIN n p ON n.named = p.id
), tree AS (
  SELECT id, id AS root, CAST(0 AS BIGINT) AS depth, name AS path FROM e WHERE parent IS NULL
  UNION ALL
  SELECT e.id, tree.root, tree.depth + 1, tree.path || ' > ' || e.name FROM tree JOIN e ON e.parent = tree.id
), reach AS (
  SELECT id AS node, parent AS ancestor FROM e WHERE parent IS NOT NULL
  UNION
  SELECT reach.node, e.parent FROM reach JOIN e ON e.id = reach.ancestor WHERE e.parent IS NOT NULL
)
"""

SQL = {
    "p3_found": _BASE
    + """, counts AS (
  SELECT ancestor AS id, count(*) AS n FROM reach WHERE ancestor <> node GROUP BY ancestor
), loops AS (
  SELECT node AS id FROM reach WHERE node = ancestor
)
SELECT e.id AS node_id, coalesce(tree.root, '') AS root_node_id, coalesce(tree.depth, -1) AS depth, coalesce(tree.path, '') AS node_path,
       CAST(coalesce(counts.n, 0) AS BIGINT) AS n_descendants,
       CASE WHEN tree.id IS NOT NULL THEN 'tree' WHEN loops.id IS NOT NULL THEN 'on_cycle' ELSE 'below_cycle' END AS state
FROM e LEFT JOIN tree ON tree.id = e.id LEFT JOIN counts ON counts.id = e.id LEFT JOIN loops ON loops.id = e.id
""",
    "p3_cycles": _BASE
    + """, ring AS (
  SELECT node AS id FROM reach WHERE node = ancestor
), named AS (
  SELECT ring.id, least(ring.id, min(coalesce(reach.ancestor, ring.id))) AS cycle_id FROM ring LEFT JOIN reach ON reach.node = ring.id GROUP BY ring.id
), down AS (
  SELECT id, cycle_id, CAST(0 AS BIGINT) AS distance FROM named
  UNION ALL
  SELECT e.id, down.cycle_id, down.distance + 1 FROM down JOIN e ON e.parent = down.id WHERE e.id NOT IN (SELECT id FROM ring)
)
SELECT id AS node_id, cycle_id, CASE WHEN distance = 0 THEN 'on_cycle' ELSE 'below_cycle' END AS state, distance FROM down
""",
    "p3_descendants": _BASE + "SELECT ancestor AS ancestor_id, node AS node_id FROM reach WHERE ancestor <> node",
}
