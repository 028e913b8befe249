"""Road tables: edges, nearest nodes, congestion and reachability."""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import EARTH_M, haversine, round_half_up
from ..runtime import if_small, shared_dir, written

#: Free-flow speeds by road class, km/h.
FREE_FLOW = {
    "motorway": 110, "motorway_link": 70, "trunk": 90, "trunk_link": 60, "primary": 60, "primary_link": 50,
    "secondary": 50, "secondary_link": 40, "tertiary": 40, "tertiary_link": 35, "residential": 30, "unclassified": 30, "living_street": 15,
}
OTHER_KMH, LEAST_EDGE_M, NODE_CELL, NODE_REACH, JAM_CELL, LEAST_KMH = 30, 0.5, 0.002, 4, 0.001, 5.0
#: Nodes whose edges are walked in one row.
BLOCK_NODES = 50_000
#: The place that the main component is found from. (Fixed values.)
SEED = (3.148, 101.694)


def free_flow(highway: Column) -> Column:
    found = F.lit(OTHER_KMH)
    for name, kmh in FREE_FLOW.items():
        found = F.when(highway == name, kmh).otherwise(found)
    return found


def road_edges(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """(from_node, to_node, dist_m, kmh) of each way's neighbouring nodes that are known, in the directions it allows."""
    steps = ways.select("way_id", "highway", "oneway", "junction", F.posexplode("nodes").alias("place", "node_id")).join(nodes, "node_id")
    chain = steps.groupBy("way_id", "highway", "oneway", "junction").agg(F.array_sort(F.collect_list(F.struct("place", "node_id", "lat", "lon"))).alias("c")).filter(F.size("c") > 1)
    hops = chain.select("highway", "oneway", "junction", F.explode(F.arrays_zip(F.slice("c", 1, F.size("c") - 1).alias("a"), F.slice("c", 2, F.size("c") - 1).alias("b"))).alias("h"))
    rows = hops.select("*", haversine(F.col("h.a.lat"), F.col("h.a.lon"), F.col("h.b.lat"), F.col("h.b.lon"), EARTH_M).alias("m")).filter(F.col("m") >= LEAST_EDGE_M)
    one = F.coalesce(F.col("oneway").isin("yes", "1"), F.lit(False)) | F.coalesce(F.col("junction") == "roundabout", F.lit(False))
    back = F.coalesce(F.col("oneway") == "-1", F.lit(False))
    edge = lambda a, b: F.struct(F.col(f"h.{a}.node_id").alias("from_node"), F.col(f"h.{b}.node_id").alias("to_node"))
    both = F.filter(F.array(F.when(~back, edge("a", "b")), F.when(~one, edge("b", "a"))), lambda e: e.isNotNull())
    return rows.select(F.explode(both).alias("e"), round_half_up(F.col("m")).cast("long").alias("dist_m"), free_flow(F.coalesce("highway", F.lit("unclassified"))).alias("kmh")).select("e.*", "dist_m", "kmh")


def node_candidates(cells: DataFrame, nodes: DataFrame, main: DataFrame) -> DataFrame:
    """(row, col, near): for each cell the nodes within four cells that can be nearest to some point in it.

    Where there are nodes of the main component they alone can. A node whose distance from the
    cell's centre is beyond the nearest one's by the cell's diagonal is nearest to none of its
    points, so few are left, and a point needs no other row than its cell's.
    """
    near = F.sequence(F.lit(-NODE_REACH), F.lit(NODE_REACH))
    place = lambda c: F.floor(F.col(c) / NODE_CELL)
    known = nodes.join(main.select("node_id").distinct().withColumn("main", F.lit(True)), "node_id", "left")
    spread = known.filter("lat is not null and lon is not null").select("node_id", "lat", "lon", F.coalesce("main", F.lit(False)).alias("main"), F.explode(F.transform(near, lambda s: place("lat") + s)).alias("row"), place("lon").alias("own_col"))
    spread = spread.withColumn("col", F.explode(F.transform(near, lambda s: F.col("own_col") + s))).drop("own_col")
    lat, lon = ((F.col(c) + 0.5) * NODE_CELL for c in ("row", "col"))
    met = spread.join(cells, ["row", "col"], "left_semi").withColumn("away", haversine(lat, lon, F.col("lat"), F.col("lon"), EARTH_M))
    corner = lambda s: haversine(lat, lon, lat + s * NODE_CELL / 2, lon + NODE_CELL / 2, EARTH_M)
    least = met.groupBy("row", "col").agg(F.min(F.struct((~F.col("main")).alias("other"), "away")).alias("least"), F.min("away").alias("nearest"))
    least = least.select("row", "col", (~F.col("least.other")).alias("has_main"), F.when(~F.col("least.other"), F.col("least.away")).otherwise(F.col("nearest")).alias("nearest"))
    reach = F.col("nearest") + 2.02 * F.greatest(corner(1), corner(-1)) + 1
    kept = met.join(least, ["row", "col"]).filter((F.col("away") <= reach) & (F.col("main") | ~F.col("has_main")))
    return kept.groupBy("row", "col").agg(F.collect_list(F.struct("node_id", "lat", "lon")).alias("near"))


def nearest_node(points: DataFrame, nodes: DataFrame, main: DataFrame) -> DataFrame:
    """(point_id, node_id, dist_m): the nearest node within four cells, one of the main component if there is any.

    Points meet the candidates of their cell in one row; they are not copied, and not shuffled
    where the counted cells can be broadcast.
    """
    rows = points.select("point_id", "lat", "lon", F.floor(F.col("lat") / NODE_CELL).alias("row"), F.floor(F.col("lon") / NODE_CELL).alias("col"))
    near = written(node_candidates(rows.select("row", "col").distinct(), nodes, main), "node-candidates")
    listed = near.agg(F.sum(F.size("near"))).first()[0] or 0
    met = rows.join(if_small(near, 64 + 48 * listed // max(1, near.count())), ["row", "col"])
    away = F.transform("near", lambda n: F.struct(haversine(F.col("lat"), F.col("lon"), n["lat"], n["lon"], EARTH_M).alias("dist_m"), n["node_id"].alias("node_id")))
    return met.select("point_id", F.array_min(away).alias("m")).select("point_id", "m.node_id", "m.dist_m")


def edge_congestion(edges: DataFrame, nodes: DataFrame, speeds: DataFrame) -> DataFrame:
    """Edges with congestion_kmh and travel_s.

    Speeds in the nine cells around an edge's middle count; their upper median is held between
    5 and the free flow, which also stands where there are none. Negative and null speeds do
    not count. Speeds are first counted by cell and value, so a busy cell is a few rows.
    """
    a, b = (nodes.select(F.col("node_id").alias(f"{n}_node"), F.col("lat").alias(f"{n}_lat"), F.col("lon").alias(f"{n}_lon")) for n in ("from", "to"))
    rows = edges.join(a, "from_node").join(b, "to_node")
    rows = rows.withColumn("mid_row", F.floor((F.col("from_lat") + F.col("to_lat")) / 2 / JAM_CELL)).withColumn("mid_col", F.floor((F.col("from_lon") + F.col("to_lon")) / 2 / JAM_CELL))
    seen = speeds.filter("speed >= 0 and lat is not null and lon is not null").groupBy(F.floor(F.col("lat") / JAM_CELL).alias("row"), F.floor(F.col("lon") / JAM_CELL).alias("col"), "speed").agg(F.count("*").alias("n"))
    near = F.sequence(F.lit(-1), F.lit(1))
    middles = rows.select("mid_row", "mid_col").distinct()
    around = middles.withColumn("row", F.explode(F.transform(near, lambda s: F.col("mid_row") + s))).withColumn("col", F.explode(F.transform(near, lambda s: F.col("mid_col") + s)))
    counted = around.join(seen, ["row", "col"]).groupBy("mid_row", "mid_col", "speed").agg(F.sum("n").alias("n"))
    own = Window.partitionBy("mid_row", "mid_col")
    upto = F.sum("n").over(own.orderBy("speed"))
    ranked = counted.withColumn("upto", upto).withColumn("all", F.sum("n").over(own))
    # the upper median is the value at place all div 2, counted from 0
    median = ranked.filter(F.col("upto") > F.floor(F.col("all") / 2)).groupBy("mid_row", "mid_col").agg(F.min("speed").alias("median"))
    found = rows.join(median, ["mid_row", "mid_col"], "left")
    jam = F.when(F.col("median").isNull(), F.col("kmh").cast("double")).otherwise(F.greatest(F.lit(LEAST_KMH), F.least(F.col("kmh").cast("double"), "median")))
    return found.withColumn("congestion_kmh", jam).withColumn("travel_s", F.col("dist_m") / (F.col("congestion_kmh") / 3.6)).select(*edges.columns, "congestion_kmh", "travel_s")


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each block what its start nodes reach inside it, and the nodes of other blocks that edges lead to from there."""
    for batch in batches:
        nodes, blocks, inside = [], [], []
        for block, starts, steps, old in zip(*(batch.column(c).to_pylist() for c in ("block", "starts", "steps", "old")), strict=True):
            follow: dict = {}
            for step in steps or ():
                follow.setdefault(step["a"], []).append((step["b"], step["block"]))
            seen, waiting, out = set(old or ()), [n for n in starts], set()
            while waiting:
                node = waiting.pop()
                if node in seen:
                    continue
                seen.add(node)
                nodes.append(node)
                blocks.append(block)
                inside.append(True)
                for to, home in follow.get(node, ()):
                    waiting.append(to) if home == block else out.add((to, home))
            for to, home in out:
                nodes.append(to)
                blocks.append(home)
                inside.append(False)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, batch.schema.field("starts").type.value_type), pa.array(blocks, pa.int32()), pa.array(inside, pa.bool_())], ["node_id", "block", "inside"])


def reachable(edges: DataFrame, seeds: DataFrame, block_nodes: int = BLOCK_NODES) -> DataFrame:
    """(node_id): nodes that directed edges reach from the seeds, these included (G1).

    Nodes are blocks by ranges of their numbers, and a block's edges one row of about
    ``block_nodes`` times their degree. A round walks from the new nodes of each block as far as
    its own edges lead, with what it has seen there before, and hands on only what edges to
    other blocks lead to. So rounds are as many as a way changes blocks, not as it has hops.
    Edges with a null end lead nowhere.
    """
    spark, folder = edges.sparkSession, f"{shared_dir(edges.sparkSession)}/reached-{uuid.uuid4().hex}"
    steps = written(edges.select(F.col("from_node").alias("a"), F.col("to_node").alias("b")).filter("a is not null and b is not null").distinct(), "road-steps")
    begin = seeds.select("node_id").filter("node_id is not null").distinct()
    nodes = steps.select(F.col("a").alias("node_id")).union(steps.select("b")).union(begin).distinct()
    count = max(1, -(-nodes.count() // block_nodes))
    placed = written(nodes.repartitionByRange(count, "node_id").withColumn("block", F.spark_partition_id()), "road-blocks")
    few = if_small(placed, 32)
    home = few.select(F.col("node_id").alias("b"), F.col("block").alias("of_b"))
    own = few.select(F.col("node_id").alias("a"), "block")
    packed = steps.join(own, "a").join(home, "b").groupBy("block").agg(F.collect_list(F.struct("a", "b", F.col("of_b").alias("block"))).alias("steps"))
    packed = written(packed, "road-adjacency")
    kind = begin.schema["node_id"].dataType.simpleString()
    shape = f"node_id {kind}, block int, inside boolean"
    frontier = begin.join(few, "node_id").select("node_id", "block")
    for rounds in itertools.count():
        seen = spark.read.schema(shape).option("recursiveFileLookup", "true").parquet(folder).filter("inside") if rounds else spark.createDataFrame([], shape)
        starts = frontier.groupBy("block").agg(F.collect_list("node_id").alias("starts"))
        old = seen.join(F.broadcast(starts.select("block")) if count < 1 << 20 else starts.select("block"), "block", "left_semi").groupBy("block").agg(F.collect_list("node_id").alias("old"))
        work = starts.join(packed, "block", "left").join(old, "block", "left").select("block", "starts", "steps", "old")
        work.mapInArrow(_walk, shape).write.parquet(f"{folder}/round={rounds}")
        made = spark.read.schema(shape).parquet(f"{folder}/round={rounds}")
        known = spark.read.schema(shape).option("recursiveFileLookup", "true").parquet(folder).filter("inside")
        frontier = written(made.filter("not inside").select("node_id", "block").distinct().join(known.select("node_id"), "node_id", "left_anti").select("node_id", "block"), "road-frontier")
        if frontier.isEmpty():
            return known.select("node_id")


def main_component(edges: DataFrame, nodes: DataFrame, lat: float = SEED[0], lon: float = SEED[1]) -> DataFrame:
    """(node_id): what directed edges reach from the node nearest to a place, of those that edges leave; none without edges."""
    starts = nodes.filter("lat is not null and lon is not null").join(edges.select(F.col("from_node").alias("node_id")).distinct(), "node_id", "left_semi")
    away = haversine(F.col("lat"), F.col("lon"), F.lit(lat), F.lit(lon), EARTH_M)
    seed = starts.agg(F.min(F.struct(away.alias("m"), "node_id")).alias("s")).select("s.node_id").filter("node_id is not null")
    return reachable(edges, seed)
