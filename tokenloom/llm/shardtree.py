"""Sharding by a hierarchical weighted hash tree.

A key descends region, rack and shard. At each node every child draws ln(u) / weight, u in (0, 1) hashed
from the key and the child's path; the largest draw wins. An inner node's weight is the sum of its leaves.
Draws of one child do not depend on its siblings, so a changed weight moves keys only to or from the
subtrees whose weight changed, and inside an untouched subtree nothing moves.

Defined cases: a null key gets null region, rack and shard; equal keys get equal places, so repeated rows stay
together; draws that tie go to the path that sorts first; an empty table gives an empty result; children of
weight 0 get nothing, and a tree with no positive weight or with more than three levels is refused; a rack or region may
be a leaf, then the levels below it are null. Only the key column is read, so extra
columns, also ones named region, rack or shard, cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEVELS = ("region", "rack", "shard")

#: Production tree: {region: {rack: {shard: weight}}}; weights are relative capacities.
TREE = {
    "east": {"e1": {"s0": 4, "s1": 4, "s2": 2}, "e2": {"s0": 4, "s1": 4}, "e3": {"s0": 6, "s1": 2, "s2": 2, "s3": 2}},
    "north": {"n1": {"s0": 3, "s1": 3, "s2": 3}, "n2": {"s0": 8}},
    "west": {"w1": {"s0": 2, "s1": 2, "s2": 2, "s3": 2}, "w2": {"s0": 5, "s1": 5}, "w3": {"s0": 1, "s1": 1}, "w4": {"s0": 4}},
}


def weight(node: dict | float) -> float:
    if isinstance(node, dict):
        return float(sum(map(weight, node.values())))
    if node < 0:
        raise ValueError("weights can't be negative")
    return float(node)


def _draw(key: Column, path: str, w: float) -> Column:
    digits = F.substring(F.md5(F.concat(F.lit(path + "#"), key).cast("binary")), 1, 13)
    u = (F.conv(digits, 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(2**52))
    return F.ln(u) / F.lit(w)


def _choice(key: Column, node: dict, path: str) -> Column:
    """Path of the child that wins below path."""
    live = sorted((path + name, weight(child)) for name, child in node.items() if weight(child) > 0)
    if not live:
        raise ValueError(f"no child of {path or 'the root'} has a positive weight")
    if len(live) == 1:
        return F.lit(live[0][0])
    # greatest of (draw, -rank): the first path wins a tie
    best = F.greatest(*(F.struct(_draw(key, p, w).alias("d"), F.lit(-k).alias("k"), F.lit(p).alias("p")) for k, (p, w) in enumerate(live)))
    return best["p"]


def assign(df: DataFrame, key: str = "doc_id", tree: dict = TREE) -> DataFrame:
    """Rows (key, region, rack, shard), one for each row of df; no shuffle."""
    out = df.select(F.col(key).alias("id"), F.col(key).cast("string").alias("k"))
    k = F.col("k")
    out = out.withColumn("l0", F.when(k.isNotNull(), _choice(k, tree, "")))
    parents: dict[str, dict | float] = dict(tree)
    for depth in (1, 2):
        pick = F.lit(None).cast("string")
        for path, node in sorted(parents.items()):
            if weight(node) <= 0 or not isinstance(node, dict):
                continue
            chosen = _choice(k, node, path + "/")
            at = F.col(f"l{depth - 1}") == F.lit(path)
            pick = F.when(at, chosen).otherwise(pick)
        out = out.withColumn(f"l{depth}", pick)
        parents = {f"{path}/{name}": child for path, node in parents.items() if isinstance(node, dict) for name, child in node.items()}
    if any(isinstance(node, dict) for node in parents.values()):
        raise ValueError(f"a tree has the levels {', '.join(LEVELS)} only")
    last = lambda c: F.substring_index(c, "/", -1)
    return out.select(F.col("id").alias(key), F.col("l0").alias("region"), last("l1").alias("rack"), last("l2").alias("shard"))


def oracle(table: str = "documents", key: str = "doc_id", tree: dict = TREE) -> str:
    """The same assignment, written as joins of keys with the nodes' weights."""
    nodes: list[tuple[int, str, str, float]] = []

    def walk(node: dict, path: str, depth: int) -> None:
        for name, child in node.items():
            if weight(child) > 0:
                nodes.append((depth, path, path + name, weight(child)))
                if isinstance(child, dict):
                    walk(child, path + name + "/", depth + 1)

    walk(tree, "", 0)
    values = ", ".join(f"({d}, '{parent}', '{p}', CAST({w} AS DOUBLE))" for d, parent, p, w in nodes)
    draw = "ln((CAST(('0x' || substr(md5(n.path || '#' || CAST(k.id AS VARCHAR)), 1, 13)) AS UBIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE) / n.w"
    level = lambda d, source, parent: (
        f"l{d} AS (SELECT id, rn, path FROM (SELECT k.id, k.rn, n.path, row_number() OVER (PARTITION BY k.rn ORDER BY {draw} DESC, n.path) AS place "
        f"FROM {source} k JOIN n ON n.depth = {d} AND n.parent = {parent}) WHERE place = 1)"
    )
    return (
        f"WITH n(depth, parent, path, w) AS (VALUES {values}), keys AS (SELECT {key} AS id, row_number() OVER () AS rn FROM {table}), "
        + level(0, "(SELECT * FROM keys WHERE id IS NOT NULL)", "''")
        + ", "
        + level(1, "l0", "k.path || '/'")
        + ", "
        + level(2, "l1", "k.path || '/'")
        + f" SELECT keys.id AS {key}, l0.path AS region, split_part(l1.path, '/', 2) AS rack, split_part(l2.path, '/', 3) AS shard "
        "FROM keys LEFT JOIN l0 ON keys.rn = l0.rn LEFT JOIN l1 ON keys.rn = l1.rn LEFT JOIN l2 ON keys.rn = l2.rn"
    )
