"""Connected components of a table of links."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: Links up to this number are joined by one task's union-find: some 60 MB; more of them by rounds of shuffles.
ONE_TASK_LINKS = 250_000


def components(links: DataFrame) -> DataFrame:
    """(v, c): for each id in links (a, b), the smallest id that it reaches; no links give an empty table."""
    return _by_union_find(links) if links.count() <= ONE_TASK_LINKS else _by_labels(links)


def _by_union_find(links: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        above: dict[int, int] = {}

        def root(x: int) -> int:
            while above.setdefault(x, x) != x:
                above[x] = above[above[x]]
                x = above[x]
            return x

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a, b = root(a), root(b)
                if a != b:
                    above[max(a, b)] = min(a, b)
        ids = list(above)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([root(x) for x in ids], pa.int64())], ["v", "c"])

    return written(links.select("a", "b").coalesce(1).mapInArrow(run, "v long, c long"), "labels")


def _by_labels(links: DataFrame) -> DataFrame:
    """Smallest labels and pointer jumping.

    Every round gives each id the smallest label among its neighbours and then that label's
    own label, so chains shorten by half and stars end after one round. Labels only fall, so
    an unchanged sum means that none changed. A hub's links are summed up before they move,
    and hub joins have one row on the hub's side.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = written(both.union(links.select("a", F.col("a").alias("b"))).union(links.select(F.col("b").alias("a"), "b")).distinct(), "links")
    labels = written(both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("c")), "labels")
    total = None
    while True:
        now = labels.agg(F.sum(F.col("c").cast("decimal(38,0)"))).first()[0]
        if now == total:
            return labels
        total = now
        near = both.join(labels.withColumnRenamed("v", "b"), "b").groupBy(F.col("a").alias("v")).agg(F.min("c").alias("c"))
        jump = labels.select(F.col("v").alias("c"), F.col("c").alias("further"))
        labels = written(near.join(jump, "c", "left").select("v", F.least("c", "further").alias("c")), "labels")
