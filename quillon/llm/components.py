"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written

#: Edges (16 bytes each) that are held in one partition: rounds over a small table then need no shuffle. Any more are dealt out.
FEW = 100_000


def _rows(df: DataFrame, *pairs: tuple[str, str]) -> DataFrame:
    """For each row of df, a row (u, v) of each of the pairs of columns."""
    return df.select(F.explode(F.array(*[F.struct(F.col(a).alias("u"), F.col(b).alias("v")) for a, b in pairs])).alias("e")).select("e.*")


def components(edges: DataFrame, most_rounds: int | None = None, few: int = FEW) -> DataFrame:
    """(node, root): each node of edges (u, v, long) with the least node of its component.

    Every round moves edges towards the least neighbour, by joins on aggregated minima; a hub's
    edges are an ordinary skewed join, and nothing is gathered on the driver but two sums. Rounds
    end when the table of edges is stable; if that takes more than most_rounds, an error is raised.
    """
    state = None
    table = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    small_table = table.count() <= few  # rounds never add edges beyond one for each node and one for each edge
    for done in count():
        if done == most_rounds:
            raise RecursionError(f"the components were not stable in {most_rounds} rounds")
        table = table.coalesce(1) if small_table else table
        both = _rows(table, ("u", "v"), ("v", "u"))
        least = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        least = least.coalesce(1) if small_table else least
        large = both.join(least.hint("shuffle_merge"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        root = large.groupBy("u").agg(F.min("v").alias("m"))
        small = _rows(large.join(root.hint("shuffle_merge"), "u"), ("v", "m"), ("u", "m"))
        table = written(small.where("u <> v").distinct(), "stars")
        now = table.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == state:
            break
        state = tuple(now)
    return _rows(table, ("u", "v"), ("v", "v")).groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
