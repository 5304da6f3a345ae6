"""Connected components of a link table, without gathering any component in one task."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """``node long, component long``: the smallest node that each node of ``links`` reaches.

    Each round hooks every node to its smallest neighbour (a partial minimum, so a hub is
    reduced before the shuffle), shortens the chains by pointer jumping until all are
    stars, and contracts the links to those stars.  A node that stays is smaller than all
    its neighbours, so each round at least halves the nodes that still have links.  The
    only joins are of long rows with a table of unique keys; AQE splits those of a hub.
    Every round is written to the shared folder.  Null ends and self links are ignored.
    """
    ends = links.select(F.col(a).cast("long").alias("x"), F.col(b).cast("long").alias("y")).where("x <> y")
    edges = materialize(ends.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct(), "links")
    first, stars = edges, []
    while not edges.isEmpty():
        star = materialize(edges.groupBy("u").agg(F.min("v").alias("p")), "hooks")
        while True:
            above = star.select(F.col("u").alias("q"), F.col("p").alias("pp"))
            jumped = materialize(star.join(above, F.col("p") == F.col("q"), "left").select("u", F.coalesce("pp", "p").alias("p"), F.col("pp").isNotNull().alias("moved")), "stars")
            star = jumped.select("u", "p")
            if jumped.where("moved").isEmpty():
                break
        stars.append(star)
        edges = materialize(_follow(_follow(edges, "u", star), "v", star).where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    nodes = first.select(F.explode(F.array("u", "v")).alias("node")).distinct().withColumn("component", F.col("node"))
    for star in stars:
        nodes = _follow(nodes, "component", star)
    return nodes.select("node", "component")


def extended(group: DataFrame, links: DataFrame, a: str, b: str) -> DataFrame:
    """``group`` (``node, component``) with further ``links``: only links between its components are worked on."""
    ends = links.select(F.col(a).cast("long").alias("x"), F.col(b).cast("long").alias("y"))
    met = [group.select(F.col("node").alias(f"of_{c}"), F.col("component").alias(f"to_{c}")) for c in ("x", "y")]
    for c, of in zip(("x", "y"), met, strict=True):
        ends = ends.join(of, F.col(c) == F.col(f"of_{c}"), "left").withColumn(c, F.coalesce(f"to_{c}", c)).drop(f"of_{c}", f"to_{c}")
    joined = materialize(components(ends, "x", "y"), "joined-components")
    top = joined.select(F.col("node").alias("from"), F.col("component").alias("top"))
    moved = group.join(top, F.col("component") == F.col("from"), "left").select("node", F.coalesce("top", "component").alias("component"))
    return materialize(moved.unionByName(joined.join(group.select("node"), "node", "left_anti").select("node", "component")), "components")


def spanning_links(hit: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> list[tuple[int, int]]:
    """At most a link a row and a column that connect what the matrix of links connects.

    Rows and columns pass the smallest node that they have seen to each other until nothing
    changes; the same node may stand for a row and a column.
    """
    top = np.iinfo(np.int64).max
    to_row, to_col = rows.astype(np.int64), cols.astype(np.int64)
    while True:
        new_row = np.minimum(to_row, np.where(hit, to_col[None, :], top).min(axis=1, initial=top))
        new_col = np.minimum(to_col, np.where(hit, new_row[:, None], top).min(axis=0, initial=top))
        if (new_row == to_row).all() and (new_col == to_col).all():
            break
        to_row, to_col = new_row, new_col
    pairs = [*zip(rows.tolist(), to_row.tolist(), strict=True), *zip(cols.tolist(), to_col.tolist(), strict=True)]
    return [(min(x, y), max(x, y)) for x, y in dict.fromkeys(pairs) if x != y]


def _follow(df: DataFrame, column: str, star: DataFrame) -> DataFrame:
    to = star.select(F.col("u").alias("__from"), F.col("p").alias("__to"))
    return df.join(to, F.col(column) == F.col("__from"), "left").withColumn(column, F.coalesce("__to", column)).drop("__from", "__to")
