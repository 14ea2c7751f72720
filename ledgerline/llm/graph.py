"""Connected components of a table of links, by hooking, pointer jumping and contraction.

Each round lets every node point to its smallest neighbour if that is smaller, shortens the
pointers until they reach roots, and replaces links by links between roots. Rows per round
are at most nodes plus links; a link between distinct roots joins at least two, so the
number of rounds grows with the logarithm of the nodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import stored


def _flat(pointers: DataFrame) -> DataFrame:
    """(node, root) from (node, parent), where parents are smaller or the node itself."""
    pointers = stored(pointers, "pointers")
    while True:
        above = pointers.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
        longer = stored(
            pointers.join(above, "parent", "left").select(
                "node",
                F.coalesce("above", "parent").alias("parent"),
                (F.coalesce("above", "parent") != F.col("parent")).alias("moved"),
            ),
            "pointers",
        )
        moved = longer.where("moved").limit(1).count()
        pointers = longer.drop("moved")
        if not moved:
            return pointers.select("node", F.col("parent").alias("root"))


def components(links: DataFrame, first: str = "a", second: str = "b") -> DataFrame:
    """(node, root) for every node that a link touches; root is the component's smallest."""
    links = stored(
        links.select(F.least(first, second).alias("a"), F.greatest(first, second).alias("b")).where("a < b").distinct(),
        "links",
    )
    whole = None
    while True:
        both = links.select("a", "b").union(links.select("b", "a"))
        hooks = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low"))
        level = _flat(hooks.select("node", F.least("node", "low").alias("parent")))
        if whole is None:
            whole = level
        else:
            up = level.select(F.col("node").alias("root"), F.col("root").alias("above"))
            whole = stored(
                whole.join(up, "root", "left").select("node", F.coalesce("above", "root").alias("root")), "roots"
            )
        top_a = level.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        top_b = level.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        links = stored(
            links.join(top_a, "a").join(top_b, "b")
            .select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))
            .where("a < b").distinct(),
            "links",
        )
        if not links.limit(1).count():
            return whole
