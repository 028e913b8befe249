"""SQL twins of linkage, leaf order and cut: agglomeration as a recursive query."""

from __future__ import annotations

from .base import ORACLES
from .matching import _CELLS


def linkage_sql(method: str, hours: bool = False) -> str:
    """CTEs up to ``pl``: (day, item, place, cluster, merges) of a day's routes, or of its hours.

    Each step keeps the distances of the clusters that are open, finds the least of each day,
    and puts the merged cluster's in place of its parts'. Leaves go by their way from the root,
    left before right; distances are at nine decimals; the five widest merges are split into six clusters.
    """
    d = "sqrt(sum(pow(x.v - y.v, 2)))" if method == "ward" else "1 - coalesce(corr(x.v, y.v), 0)"
    nine = "floor(({}) * 1000000000::DOUBLE + 0.5::DOUBLE) / 1000000000::DOUBLE".format
    new = "sqrt(greatest(0, ((na + nc) * ac * ac + (nb + nc) * bc * bc - nc * ab * ab) / (na + nb + nc)))" if method == "ward" else "(na * ac + nb * bc) / (na + nb)"
    if hours:
        fx = "fi AS MATERIALIZED (SELECT sp.day, sp.mode || '|' || sp.route AS f, sp.h AS item, coalesce(x, avg(x) OVER (PARTITION BY sp.day, sp.mode, sp.route), 0) AS v FROM sp LEFT JOIN cl USING (day, mode, route, h) WHERE sp.day IN (SELECT day FROM cl GROUP BY day HAVING count(DISTINCT route) > 1))"
    else:
        fx = "fi AS MATERIALIZED (SELECT day, mode || '|' || h AS f, route AS item, v FROM ft WHERE day IN (SELECT day FROM cl GROUP BY day HAVING count(DISTINCT route) > 2))"
    return f"""WITH RECURSIVE {_CELLS}, {fx},
it AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY day ORDER BY item) - 1 AS id, count(*) OVER (PARTITION BY day) AS n FROM (SELECT DISTINCT day, item FROM fi)),
d0 AS MATERIALIZED (SELECT x.day, i.id AS a, j.id AS b, any_value(i.n) AS n, {nine(d)} AS d FROM fi x JOIN fi y ON x.day = y.day AND x.f = y.f AND x.item < y.item JOIN it i ON i.day = x.day AND i.item = x.item JOIN it j ON j.day = y.day AND j.item = y.item GROUP BY x.day, i.id, j.id),
st AS (SELECT day, 0 AS step, 'pair' AS kind, a, b, d, 1 AS sa, 1 AS sb, n FROM d0
 UNION ALL
 SELECT * FROM (
  WITH cur AS (SELECT * FROM st WHERE kind = 'pair'),
  best AS (SELECT day, a AS l, b AS r, d AS ab, sa AS na, sb AS nb, n, step FROM (SELECT *, row_number() OVER (PARTITION BY day ORDER BY d, a, b) AS k FROM cur) WHERE k = 1),
  far AS (SELECT cur.day, CASE WHEN a IN (l, r) THEN b ELSE a END AS c, CASE WHEN a IN (l, r) THEN sb ELSE sa END AS nc, CASE WHEN a = l OR b = l THEN 'l' ELSE 'r' END AS side, d, l, r, ab, na, nb, best.n, best.step FROM cur JOIN best USING (day) WHERE (a IN (l, r)) <> (b IN (l, r))),
  wide AS (SELECT day, c, nc, n, step, ab, na, nb, max(CASE WHEN side = 'l' THEN d END) AS ac, max(CASE WHEN side = 'r' THEN d END) AS bc FROM far GROUP BY ALL)
  SELECT cur.day, cur.step + 1 AS step, 'pair' AS kind, a, b, d, sa, sb, cur.n FROM cur JOIN best USING (day) WHERE a NOT IN (l, r) AND b NOT IN (l, r)
  UNION ALL SELECT day, step + 1, 'pair', c, n + step, {nine(new)}, nc, na + nb, n FROM wide
  UNION ALL SELECT day, step + 1, 'merge', l, r, ab, na, nb, n FROM best)),
mg AS MATERIALIZED (SELECT day, step, a AS l, b AS r, d, sa + sb AS size, n, n + step - 1 AS number, row_number() OVER (PARTITION BY day ORDER BY d DESC, step DESC) AS wide FROM st WHERE kind = 'merge'),
tl AS (SELECT day, string_agg(l || ':' || r || ':' || size, ';' ORDER BY step) AS merges FROM mg GROUP BY day),
wk AS (SELECT day, max(number) AS node, '' AS path, '' AS open FROM mg GROUP BY day
 UNION ALL SELECT wk.day, CASE WHEN s.x = 0 THEN l ELSE r END, path || s.x, CASE WHEN wide < 6 THEN path || s.x ELSE open END FROM wk JOIN mg ON mg.day = wk.day AND mg.number = wk.node CROSS JOIN (VALUES (0), (1)) AS s(x)),
pl AS MATERIALIZED (SELECT wk.day, it.item, row_number() OVER (PARTITION BY wk.day ORDER BY path) - 1 AS place, dense_rank() OVER (PARTITION BY wk.day ORDER BY open) AS cluster, merges FROM wk JOIN it ON it.day = wk.day AND it.id = wk.node JOIN tl ON tl.day = wk.day)"""


ORACLES["c3_c4_route_clusters"] = linkage_sql("ward") + " SELECT day, item, CAST(place AS INT) AS place, CAST(cluster AS INT) AS cluster, merges FROM pl"
ORACLES["a22_cluster_sizes"] = linkage_sql("average") + " SELECT day, CAST(cluster AS INT) AS cluster, count(*) AS routes FROM pl GROUP BY day, cluster"
ORACLES["t3_active_axis"] = linkage_sql("ward") + " SELECT day, route, CAST(row_number() OVER (PARTITION BY day ORDER BY place NULLS LAST, route) - 1 AS INT) AS place FROM (SELECT DISTINCT day, route FROM cl) LEFT JOIN (SELECT day, item AS route, place FROM pl) USING (day, route)"
ORACLES["c5_hour_order"] = linkage_sql("ward", hours=True) + " SELECT day, CAST(item AS INT) AS hour, CAST(place AS INT) AS place FROM pl UNION ALL SELECT day, CAST(h AS INT), CAST(h AS INT) FROM (SELECT DISTINCT day FROM cl WHERE day NOT IN (SELECT day FROM pl)), range(24) AS g(h)"
