"""Route and hour clustering by daily speed profiles.

Features, filling and distances are DataFrame work in long form, for many days at once. The
linkage of one day is a small sequential problem (a day's routes or hours), so each
(day, metric) group is one call of a numpy helper.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.speed import MODES
from ..runtime import written

HOURS = 24
LEAST_ROUTES = 3
#: Metric -> linkage.
LINKAGE = {"euclidean": "ward", "correlation": "average"}


def features(cells: DataFrame, item: str = "route") -> DataFrame:
    """(day, item, feature, v) over every item and feature of a day; a missing one is the feature's mean, or 0.

    cells: (day, mode, route, hour, value). Items are routes with (mode, hour) features, or
    hours with (mode, route) features. Days with fewer than three routes (two for hours) have none.
    """
    other = "hour" if item == "route" else "route"
    named = cells.select("day", F.col(item).cast("string").alias("item"), F.concat_ws("|", "mode", F.lpad(F.col(other).cast("string"), 8, "0")).alias("feature"), F.col("value").alias("v"))
    routes = cells.groupBy("day").agg(F.count_distinct("route").alias("n")).filter(F.col("n") >= (LEAST_ROUTES if item == "route" else 2)).select("day")
    named = named.join(routes, "day", "left_semi")
    all_modes = F.explode(F.array(*[F.lit(m) for m in MODES])).alias("mode")
    hours = F.explode(F.array(*[F.lit(str(h)) for h in range(HOURS)])).alias("h")
    if item == "route":
        spine = cells.select("day", "route").distinct().select("day", F.col("route").alias("item"), all_modes).select("*", hours).select("day", "item", F.concat_ws("|", "mode", F.lpad("h", 8, "0")).alias("feature"))
    else:
        spine = cells.select("day", "route").distinct().select("day", "route", all_modes).select("*", hours).select("day", F.col("h").alias("item"), F.concat_ws("|", "mode", F.lpad("route", 8, "0")).alias("feature"))
    full = spine.join(routes, "day", "left_semi").join(named, ["day", "item", "feature"], "left")
    mean = F.avg("v").over(Window.partitionBy("day", "feature"))
    return full.withColumn("v", F.coalesce("v", mean, F.lit(0.0)))


def pairwise_distance(rows: DataFrame, metric: str = "euclidean") -> DataFrame:
    """(day, a, b, d) for a < b: Euclidean, or one minus Pearson's correlation (0 where one is constant).

    An item is one row with its features in order, written once, so that both sides of the join
    read it. Items of a day are its routes or hours, so a day's pairs are few.
    """
    vectors = rows.groupBy("day", "item").agg(F.transform(F.array_sort(F.collect_list(F.struct("feature", "v"))), lambda x: x["v"]).alias("v"))
    vectors = written(vectors, "profiles")
    left, right = (vectors.select("day", F.col("item").alias(x), F.col("v").alias(f"v_{x}")) for x in ("a", "b"))
    both = left.join(right, "day").filter("a < b")
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda t, v: t + v)
    if metric == "euclidean":
        return both.select("day", "a", "b", F.sqrt(total(F.zip_with("v_a", "v_b", lambda x, y: (x - y) * (x - y)))).alias("d"))
    for x in ("a", "b"):
        both = both.withColumn(f"m_{x}", total(F.col(f"v_{x}")) / F.size(f"v_{x}"))
    both = both.withColumn("c", total(F.zip_with("v_a", "v_b", lambda x, y: (x - F.col("m_a")) * (y - F.col("m_b")))))
    spread = F.sqrt(total(F.transform("v_a", lambda x: F.pow(x - F.col("m_a"), 2))) * total(F.transform("v_b", lambda x: F.pow(x - F.col("m_b"), 2))))
    both = both.withColumn("s", spread)
    return both.select("day", "a", "b", (1 - F.when(F.col("s") > 0, F.col("c") / F.when(F.col("s") > 0, F.col("s"))).otherwise(0.0)).alias("d"))


def settled(distances: np.ndarray) -> np.ndarray:
    """Distances at nine decimals, so that which of two equal ones is less never hangs on the order of a sum."""
    return np.floor(distances * 1e9 + 0.5) / 1e9


def link(distances: np.ndarray, method: str) -> list[tuple[int, int, float, int]]:
    """Merges (left, right, distance, size) of a symmetric matrix by Lance-Williams updates.

    Of equal distances the first pair in order wins, merged clusters coming last. Each cluster
    keeps its nearest among those after it; a merge looks again only for those that lose
    theirs, so work is about quadratic. A merged cluster takes the place of its right part.
    """
    n = len(distances)
    work, size = settled(distances.astype(float)), np.ones(n)
    ids, open_ = np.arange(n), np.ones(n, bool)  # ids are also the order
    near, gap = np.full(n, -1), np.full(n, np.inf)

    def first(places: np.ndarray) -> int:
        return int(places[ids[places].argmin()])

    def look(k: int) -> None:
        later = np.flatnonzero(open_ & (ids > ids[k]))
        if len(later):
            gap[k] = work[k, later].min()
            near[k] = first(later[work[k, later] == gap[k]])
        else:
            gap[k], near[k] = np.inf, -1

    for k in range(n):
        look(k)
    merges = []
    for number in range(n, 2 * n - 1):
        waiting = np.flatnonzero(open_ & (near >= 0))
        i = first(waiting[gap[waiting] == gap[waiting].min()])
        j = int(near[i])
        d, a, b = work[i, j], size[i], size[j]
        merges.append((int(ids[i]), int(ids[j]), float(d), int(a + b)))
        open_[[i, j]] = False
        rest = np.flatnonzero(open_)
        to_a, to_b, c = work[i, rest], work[j, rest], size[rest]
        if method == "ward":
            row = np.sqrt(np.maximum(0, ((a + c) * to_a**2 + (b + c) * to_b**2 - c * d * d) / (a + b + c)))
        else:
            row = (a * to_a + b * to_b) / (a + b)
        row = settled(row)
        work[j, rest] = work[rest, j] = row
        ids[j], size[j], open_[j], near[j], gap[j] = number, a + b, True, -1, np.inf
        lost = (near[rest] == i) | (near[rest] == j)
        nearer = rest[~lost & (row < gap[rest])]
        near[nearer], gap[nearer] = j, work[nearer, j]
        for k in rest[lost]:
            look(int(k))
    return merges


def _leaves(merges: list[tuple[int, int, float, int]], n: int, root: int) -> list[int]:
    out, waiting = [], [root]
    while waiting:
        node = waiting.pop()
        if node < n:
            out.append(node)
        else:
            waiting += [merges[node - n][1], merges[node - n][0]]
    return out


def cut(merges: list[tuple[int, int, float, int]], n: int, k: int) -> list[tuple[int, int]]:
    """(leaf, cluster) in leaf order: the widest open merge is split until k are open; clusters are numbered in leaf order from 1."""
    roots = [n + len(merges) - 1] if merges else list(range(n))
    while len(roots) < k:
        width = [merges[r - n][2] if r >= n else -np.inf for r in roots]
        at = int(np.argmax(width)) if width else 0
        if not width or width[at] == -np.inf:
            break
        roots[at : at + 1] = merges[roots[at] - n][:2]
    return [(leaf, number + 1) for number, root in enumerate(roots) for leaf in _leaves(merges, n, root)]


def cluster(distances: DataFrame, metric: str = "euclidean", k: int = 6) -> DataFrame:
    """(day, item, place, cluster, merges): leaf order and cluster of each item, and its day's merges as left:right:size."""
    method = LINKAGE[metric]

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        items = sorted({*pdf.a, *pdf.b}, key=lambda x: (len(x), x) if x.isdigit() else (0, x))
        at = {x: i for i, x in enumerate(items)}
        matrix = np.zeros((len(items), len(items)))
        for a, b, d in zip(pdf.a, pdf.b, pdf.d, strict=True):
            matrix[at[a], at[b]] = matrix[at[b], at[a]] = d
        merges = link(matrix, method)
        told = ";".join(f"{x}:{y}:{size}" for x, y, _, size in merges)
        rows = [(pdf.day.iloc[0], items[leaf], place, number, told) for place, (leaf, number) in enumerate(cut(merges, len(items), max(2, min(10, k))))]
        return pd.DataFrame(rows, columns=["day", "item", "place", "cluster", "merges"])

    return distances.groupBy("day").applyInPandas(one, "day long, item string, place int, cluster int, merges string")


def route_clusters(cells: DataFrame, metric: str = "euclidean", k: int = 6) -> DataFrame:
    return cluster(pairwise_distance(features(cells), metric), metric, k)


def hour_order(cells: DataFrame, metric: str = "euclidean") -> DataFrame:
    """(day, hour, place): hours in leaf order, or as they come on days with fewer than two routes."""
    placed = cluster(pairwise_distance(features(cells, "hour"), metric), metric).select("day", F.col("item").cast("int").alias("hour"), "place")
    plain = cells.select("day").distinct().join(placed.select("day").distinct(), "day", "left_anti")
    return placed.unionByName(plain.select("day", F.explode(F.sequence(F.lit(0), F.lit(HOURS - 1))).alias("hour")).withColumn("place", F.col("hour")))


def cluster_sizes(clusters: DataFrame) -> DataFrame:
    return clusters.groupBy("day", "cluster").agg(F.count("*").alias("routes"))


def active_axis(cells: DataFrame, order: DataFrame) -> DataFrame:
    """(day, route, place): routes that have cells, in cluster order, others after these by name."""
    routes = cells.select("day", "route").distinct().join(order.select("day", F.col("item").alias("route"), F.col("place").alias("_p")), ["day", "route"], "left")
    by = Window.partitionBy("day").orderBy(F.col("_p").asc_nulls_last(), "route")
    return routes.select("day", "route", (F.row_number().over(by) - 1).alias("place"))
