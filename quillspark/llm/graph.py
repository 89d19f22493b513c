"""Connected components of a link table by randomised contraction.

Each round every vertex joins the neighbour of least random priority (itself
included), the links are rewritten between the chosen vertices and loops
fall away. The expected number of vertices with links shrinks by a constant
factor a round, whatever the ids look like. Maps and links are written tables:
a lost executor costs a task, not the rounds before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.sinks.snapshots import materialize


def components(links: DataFrame) -> DataFrame:
    """``links(a, b)`` of long ids -> ``(id, root)`` for every linked vertex.

    Vertices of one component share ``root``, one of its vertices. Links to
    itself and repeated links are allowed; null ends are left out. An empty
    table gives an empty result.
    """
    edges = materialize(links.select(F.col("a").cast("long"), F.col("b").cast("long"))
                        .where("a <> b").distinct(), "cc_links")
    maps: list[DataFrame] = []
    while not edges.isEmpty():
        seed = len(maps)

        def priority(c):
            return F.struct(F.xxhash64(F.lit(seed), F.col(c)).alias("p"), F.col(c).alias("v"))

        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        chosen = (both.groupBy(F.col("a").alias("id")).agg(F.min(priority("b")).alias("n"))
                  .select("id", F.least(priority("id"), F.col("n")).getField("v").alias("root")))
        step = materialize(chosen, "cc_map")
        edges = materialize(
            edges.join(step.select(F.col("id").alias("a"), F.col("root").alias("ra")), "a")
            .join(step.select(F.col("id").alias("b"), F.col("root").alias("rb")), "b").where("ra <> rb")
            .select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "cc_links")
        maps.append(step)
    if not maps:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("root"))
    out = maps[0]
    for m in maps[1:]:
        out = (out.join(m.select(F.col("id").alias("root"), F.col("root").alias("_next")), "root", "left")
               .select("id", F.coalesce("_next", "root").alias("root")))
    return materialize(out, "cc_roots")
