"""Polygons of many edges as cells, so that a point meets only the edges of its own cell.

A ring is cut into strips of equal height. Within a strip its edges fall into intervals whose
x ranges do not touch. Every chain of edges lies in one interval and leaves the strip at its
ends, so a ray that passes a whole interval crosses it equally often, odd or even, from every
height of the strip. Between two intervals no ray is needed (inner and outer cells); inside one
(border cell) the ray is followed through the edges of this interval only, and what lies to the
right is one bit. Border cells that still hold many edges are cut again in the same way.

The ray meets exactly the edges that it would meet in the whole ring, so results are the same
to the last bit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from viario.storage import materialise

CELL_EDGES = 64      # border cells with more edges are cut again
STRIP_EDGES = 2      # edges per strip and crossing that are aimed at
LEVELS = 6           # at most so many times; cells that are still large after it cost longer rays, nothing else
_ROUNDING = 1e-12    # of the coordinates; far above what a crossing can be off by


def _where(y: Column, out: Column) -> Column:
    """The strip of a height; heights that a chain has left the node at are -1 below and `m` above."""
    at = F.least(F.greatest(F.floor((y - F.col("low")) / F.col("h")), F.lit(0)), F.col("m") - 1)
    return F.when(out < 0, F.lit(-1).cast("bigint")).when(out > 0, F.col("m")).otherwise(at)


def _cut(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (node, base, low, h, m) and their cells from edges (node, base, e), where e holds the
    ends of an edge and whether each lies below, in or above the node (-1, 0, 1).

    A node is one ring or a part of one, which was one value of one row, so a window over it is
    bounded by that row.
    """
    whole = Window.partitionBy("node")
    ends = [F.when(F.col(f"e.{p}_out") == 0, F.col(f"e.{p}y")) for p in ("a", "b")]
    spread = edges.select(
        "*", F.count(F.lit(1)).over(whole).alias("n"), F.min(F.least(*ends)).over(whole).alias("low"),
        F.max(F.greatest(*ends)).over(whole).alias("high"))

    def clipped(p: str) -> Column:
        out = F.col(f"e.{p}_out")
        return F.when(out < 0, F.col("low")).when(out > 0, F.col("high")).otherwise(F.col(f"e.{p}y"))

    climbed = F.sum(F.abs(clipped("b") - clipped("a"))).over(whole)
    least = (F.col("high") - F.col("low")) / F.col("n")
    cut = F.coalesce((F.col("n") > CELL_EDGES) & (least > 0), F.lit(False))
    sized = (
        spread.withColumn("h", F.when(cut, F.greatest(climbed * STRIP_EDGES / F.col("n"), least)).otherwise(1.0))
        .withColumn("m", F.when(cut, F.ceil((F.col("high") - F.col("low")) / F.col("h"))).otherwise(F.lit(1)).cast("bigint"))
        .withColumn("low", F.coalesce("low", F.lit(0.0)))
    )
    nodes = sized.groupBy("node", "base", "low", "h", "m").agg(F.first("n").alias("n"))

    margin = F.lit(_ROUNDING) * (F.abs("e.ax") + F.abs("e.bx") + 1)
    first, last = F.least("sa", "sb"), F.greatest("sa", "sb")
    filed = (
        sized.withColumns({"sa": _where(F.col("e.ay"), F.col("e.a_out")), "sb": _where(F.col("e.by"), F.col("e.b_out"))})
        .withColumn("strip", F.explode(F.sequence(F.greatest(first, F.lit(0)), F.least(last, F.col("m") - 1))))
        .withColumns({"x0": F.least("e.ax", "e.bx") - margin, "x1": F.greatest("e.ax", "e.bx") + margin})
        .withColumn("e", F.struct("e.ax", "e.ay", "e.bx", "e.by",
                                  F.signum(F.col("sa") - F.col("strip")).cast("int").alias("a_out"),
                                  F.signum(F.col("sb") - F.col("strip")).cast("int").alias("b_out")))
        .select("node", "base", "n", "strip", "x0", "x1", "e")
    )
    order = Window.partitionBy("node", "strip").orderBy("x0", "x1", "e").rowsBetween(Window.unboundedPreceding, -1)
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    apart = F.coalesce(F.col("x0") > F.max("x1").over(order), F.lit(True)).cast("int")
    crossed = F.sum(((F.col("e.a_out") > 0) != (F.col("e.b_out") > 0)).cast("int")) % 2
    intervals = filed.withColumn("new", apart).withColumn("k", F.sum("new").over(upto)).groupBy(
        "node", "base", "n", "strip", "k").agg(
        F.min("x0").alias("x0"), F.max("x1").alias("x1"), crossed.alias("own"), F.collect_list("e").alias("edges"),
        F.count_if((F.col("e.a_out") != 0) & (F.col("e.b_out") != 0)).alias("through"))
    strip = Window.partitionBy("node", "strip").orderBy("k")
    right = F.coalesce(F.sum("own").over(strip.rowsBetween(1, Window.unboundedFollowing)), F.lit(0))
    nothing = F.lit(float("-inf")), F.lit(float("inf"))
    cells = intervals.select(
        "node", "strip", "k", "x0", "x1", "edges",
        F.when(F.col("k") == 1, nothing[0]).otherwise(F.col("x0")).alias("x_from"),
        F.coalesce(F.lead("x0").over(strip), nothing[1]).alias("x_to"),
        ((F.col("base") + right) % 2).cast("int").alias("right"), ((F.col("base") + right + F.col("own")) % 2).cast("int").alias("left"),
        # edges that go through the whole strip stay together however thin it is cut
        ((F.size("edges") > CELL_EDGES) & (F.size("edges") < F.col("n")) & (F.col("through") * 2 < F.size("edges"))).alias("again"))
    return nodes, cells


def cover(rings: DataFrame) -> list[tuple[DataFrame, DataFrame]]:
    """Levels of (nodes, cells) of rings (node, edges), a written table; mostly one or two. Levels are written too."""
    place = F.struct("e.ax", "e.ay", "e.bx", "e.by", F.lit(0).alias("a_out"), F.lit(0).alias("b_out"))
    edges = rings.select("node", F.explode("edges").alias("e")).select(
        "node", F.lit(0).alias("base"), place.alias("e"))
    levels = []
    while True:
        nodes, cells = _cut(edges)
        levels.append((materialise(nodes, "cover-nodes"), materialise(cells, "cover-cells")))
        heavy = levels[-1][1].where("again")
        if heavy.isEmpty():
            return levels
        if len(levels) == LEVELS:
            levels[-1] = levels[-1][0], levels[-1][1].withColumn("again", F.lit(False))
            return levels
        edges = heavy.select(_part().alias("node"), F.col("right").alias("base"), F.explode("edges").alias("e"))


def _part() -> Column:
    return F.concat_ws("/", "node", "strip", "k")


def in_cover(asked: DataFrame, levels: list[tuple[DataFrame, DataFrame]], crosses) -> DataFrame:
    """The rows of `asked` (node, x, y, each row with the ring it may lie in) whose point lies in their ring.

    `crosses(x, y, edges)` tells whether the ray from a point crosses the edges an odd number of times.
    """
    found = None
    for i, (nodes, cells) in enumerate(levels):
        table = asked.join(nodes, "node").withColumn("strip", _where(F.col("y"), F.lit(0)))
        own = table.alias("p").join(cells.alias("c"), (
            (F.col("p.node") == F.col("c.node")) & (F.col("p.strip") == F.col("c.strip"))
            & (F.col("p.x") >= F.col("c.x_from")) & (F.col("p.x") < F.col("c.x_to"))), "left")
        bit = (
            F.when(F.col("x_from").isNull(), F.col("base") == 1)  # no edge of the node in this strip
            .when(F.col("p.x") < F.col("x0"), F.col("left") == 1).when(F.col("p.x") > F.col("x1"), F.col("right") == 1)
            .otherwise(crosses(F.col("p.x"), F.col("p.y"), F.col("edges")) != (F.col("right") == 1)))
        deeper = F.coalesce("again", F.lit(False)) & F.col("p.x").between(F.col("x0"), F.col("x1"))
        part = F.concat_ws("/", "c.node", "c.strip", "c.k")
        hits = own.where(~deeper & bit).select("p.x", "p.y")
        found = hits if found is None else found.union(hits)
        if i + 1 < len(levels):
            asked = materialise(own.where(deeper).select(part.alias("node"), "p.x", "p.y"), "cover-points")
    return found
