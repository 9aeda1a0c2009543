"""Connected components of a table of links, by hooking and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise


def components(links: DataFrame) -> DataFrame:
    """(node, root): of every node of links (a, b), the smallest node that it reaches.

    Each round hooks every node to its least neighbour (a partial aggregation),
    replaces the ends of the links by what they hooked to and drops loops and
    repeats; the number of nodes that still have links falls at least by half
    a round or so. The rounds' hooks are then followed by joins. All tables of
    a round are written to the shared folder, so nothing goes to the driver
    and a lost executor costs one round at most. Loops give no node; an empty
    table gives an empty one.
    """
    kind = links.schema["a"].dataType
    left = materialise(links.select(F.col("a").cast(kind), F.col("b").cast(kind)).where("a <> b").distinct(), "links")
    hooks: list[DataFrame] = []
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = materialise(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")).select("node", F.least("node", "root").alias("root")), "hooks")
        hooks.append(hook)
        on_a, on_b = hook.toDF("a", "a_root"), hook.toDF("b", "b_root")
        moved = left.join(on_a, "a").join(on_b, "b").where("a_root <> b_root")
        ends = moved.select(F.greatest("a_root", "b_root").alias("a"), F.least("a_root", "b_root").alias("b")).distinct()
        before, left = left, materialise(ends, "links")
        discard(before)
    if not hooks:
        return left.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = hooks[0]
    for hook in hooks[1:]:
        further = hook.toDF("root", "next")
        out = out.join(further, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    # a hook goes to a smaller node that may itself have hooked in the same round
    while True:
        jump, last = out.toDF("root", "next"), out
        out = materialise(out.join(jump, "root", "left").select("node", F.coalesce("next", "root").alias("root"), (F.coalesce("next", "root") != F.col("root")).alias("moved")), "roots")
        for used in hooks or [last]:
            discard(used)
        hooks = []
        if out.where("moved").isEmpty():
            return out.drop("moved")
        out = out.drop("moved")
