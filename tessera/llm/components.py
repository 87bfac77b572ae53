"""Connected components over an edge table, by neighbour minimum and pointer jumping; nothing reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import discard, materialise

ROWS_PER_FILE = 250_000


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable, for every id that an edge (a, b) names.

    Each round takes the least label among neighbours, pre-aggregated before the shuffle, hands it to the vertex that
    the old label names too, so whole trees are hooked, and then follows labels to their own new labels. Labels only
    fall, and where none does, both ends of every edge have one label; so rounds end by themselves, on paths after
    about log2 of the length. Rounds are written to the shared folder, in files of about ROWS_PER_FILE rows, so that
    rounds over few links cost little.
    """
    both = materialise(
        edges.where("a is not null and b is not null and a <> b").select("a", "b").unionByName(edges.where("a is not null and b is not null and a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(),
        "edges",
    )
    files = max(1, -(-both.count() // ROWS_PER_FILE))

    def write(df: DataFrame, name: str) -> DataFrame:
        return materialise(df.coalesce(files), name)

    label = write(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("l")).withColumnRenamed("a", "v"), "labels")
    while True:
        near = both.join(label.select(F.col("v").alias("b"), "l"), "b").groupBy("a").agg(F.min("l").alias("m"))
        own = write(label.join(near, label["v"] == near["a"]).select("v", F.col("l").alias("old"), F.least("l", "m").alias("l")), "near")
        given = own.where("l < old").groupBy(F.col("old").alias("_root")).agg(F.min("l").alias("_given"))
        hooked = write(own.join(given, own["v"] == given["_root"], "left").select("v", "old", F.least("l", "_given").alias("l")), "hooked")
        up = hooked.select(F.col("v").alias("_up"), F.col("l").alias("_l2"))
        jumped = hooked.join(up, hooked["l"] == up["_up"]).select("v", "old", F.least("l", "_l2").alias("l"))
        new = write(jumped, "labels")
        changed = new.where("l <> old").limit(1).count()
        for done in (label, own, hooked):
            discard(done)
        label = new
        if not changed:
            discard(both)
            return label.select(F.col("v").alias("id"), F.col("l").alias("component"))
