"""Connected components of an edge table, by label spreading with pointer jumping.

Every round takes the least label among a vertex and its neighbours, then follows
the label one step further, so long chains halve. Each round is written to the
shared folder; nothing is collected but one count of changed rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm.common import materialise


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``v, c`` for every vertex of ``edges`` (``a``, ``b``): ``c`` is the least vertex reachable.

    Loops and repeated edges do no harm; edges with a null end are ignored; no edges give no rows.
    """
    good = edges.where(F.col("a").isNotNull() & F.col("b").isNotNull())
    both = materialise(good.select(F.col("a").alias("s"), F.col("b").alias("t")).union(good.select("b", "a")).distinct())
    labels = materialise(both.groupBy(F.col("s").alias("v")).agg(F.least(F.col("s"), F.min("t")).alias("c")))
    for _ in range(max_rounds):
        reach = both.join(labels, both.t == labels.v).groupBy(F.col("s").alias("v")).agg(F.min("c").alias("m"))
        spread = labels.join(reach, "v").select("v", F.col("c").alias("old"), F.least("c", "m").alias("c"))
        jump = spread.select(F.col("v").alias("at"), F.col("c").alias("further"))
        after = materialise(spread.join(jump, spread.c == jump["at"], "left").select("v", F.least("c", "further").alias("c"), "old"))
        labels = after.select("v", "c")
        if after.where("c <> old").isEmpty():
            return labels
    raise RuntimeError("components did not settle; raise max_rounds")


def extend(found: DataFrame, more: DataFrame) -> DataFrame:
    """The labels ``v, c`` after adding the edges ``more`` (``a``, ``b``) to a graph whose labels are ``found``.

    Only the graph of the old components is spread, in which chains are short, not the whole one again.
    """
    at_a, at_b = (found.select(F.col("v").alias(x), F.col("c").alias(f"c{x}")) for x in "ab")
    between = more.join(at_a, "a", "left").join(at_b, "b", "left")
    merged = components(between.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")))
    renamed = merged.select(F.col("v").alias("old"), F.col("c").alias("new"))
    known = found.join(renamed, F.col("c") == F.col("old"), "left").select("v", F.coalesce("new", "c").alias("c"))
    return materialise(known.union(merged.join(found.select("v"), "v", "left_anti").select("v", "c")))
