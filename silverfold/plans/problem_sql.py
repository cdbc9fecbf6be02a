"""The general problems' queries in SQL, for the comparison on the same tables."""

from __future__ import annotations

_CLIMB = """
WITH RECURSIVE n AS (
  SELECT DISTINCT id, parent_id, name FROM folders
), k AS (
  SELECT n.id, n.name, q.id AS p FROM n LEFT JOIN n q ON q.id = n.parent_id
)"""

P3 = _CLIMB + """, down AS (
  SELECT id, id AS root_id, CAST(0 AS BIGINT) AS depth, name AS full_path FROM k WHERE p IS NULL
  UNION ALL
  SELECT k.id, d.root_id, d.depth + 1, d.full_path || '/' || k.name FROM down d JOIN k ON k.p = d.id
), pairs AS (
  SELECT k.p AS above, k.id FROM k JOIN down d ON d.id = k.id WHERE k.p IS NOT NULL
  UNION ALL
  SELECT k.p, x.id FROM pairs x JOIN k ON k.id = x.above WHERE k.p IS NOT NULL
), below AS (
  SELECT above AS id, count(*) AS n FROM pairs GROUP BY above
), lost AS (
  SELECT k.id, k.p FROM k WHERE k.id NOT IN (SELECT id FROM down)
), walk AS (
  SELECT id, p AS pos, 1 AS steps FROM lost
  UNION
  SELECT w.id, l.p, w.steps + 1 FROM walk w JOIN lost l ON l.id = w.pos WHERE w.steps < 400
), ring AS (
  SELECT id, min(pos) AS root_id FROM walk WHERE id IN (SELECT id FROM walk WHERE pos = id) GROUP BY id
), tail AS (
  SELECT w.id, min(w.steps) AS depth, arg_min(r.root_id, w.steps) AS root_id
  FROM walk w JOIN ring r ON r.id = w.pos WHERE w.id NOT IN (SELECT id FROM ring) GROUP BY w.id
)
SELECT d.id AS folder_id, 'tree' AS link_kind, root_id, depth, full_path, coalesce(b.n, 0) AS n_desc
FROM down d LEFT JOIN below b ON b.id = d.id
UNION ALL SELECT id, 'cycle', root_id, 0, '', -1 FROM ring
UNION ALL SELECT id, 'tail', root_id, depth, '', -1 FROM tail
"""

P4 = """
WITH e AS (
  SELECT DISTINCT f.id, o.library_id, f.taken_at AS t, f.taken_at // 86400 AS day
  FROM files f JOIN folders o ON o.id = f.folder_id
  WHERE o.library_id IS NOT NULL AND f.trashed_at IS NULL AND f.taken_at BETWEEN 946684800 AND 1798761599
), m AS (
  SELECT *, CASE WHEN t - lag(t) OVER w <= 1800 THEN 0 ELSE 1 END AS new FROM e WINDOW w AS (PARTITION BY library_id, day ORDER BY t, id)
), s AS (
  SELECT *, sum(new) OVER (PARTITION BY library_id, day ORDER BY t, id ROWS UNBOUNDED PRECEDING) AS no FROM m
)
SELECT library_id, min(t) AS start_at, max(t) AS end_at, count(*) AS n_files FROM s GROUP BY library_id, day, no
"""

P6 = """
WITH r AS (
  SELECT DISTINCT side, pair_id, nfc_normalize(CASE WHEN coalesce(sub, '') = '' THEN name ELSE sub || '/' || name END) AS path,
    size, full_hash, modified_at, rating FROM tree_files
), a AS (SELECT * FROM r WHERE side = 'a'), b AS (SELECT * FROM r WHERE side = 'b'),
both_sides AS (
  SELECT pair_id, path, a.size <> b.size AS d1, a.full_hash IS DISTINCT FROM b.full_hash AS d2,
    a.modified_at <> b.modified_at AS d3, a.rating IS DISTINCT FROM b.rating AS d4
  FROM a JOIN b USING (pair_id, path)
)
SELECT pair_id, path, 'only_a' AS field FROM a ANTI JOIN b USING (pair_id, path)
UNION ALL SELECT pair_id, path, 'only_b' FROM b ANTI JOIN a USING (pair_id, path)
UNION ALL SELECT pair_id, path, 'size' FROM both_sides WHERE d1
UNION ALL SELECT pair_id, path, 'full_hash' FROM both_sides WHERE d2
UNION ALL SELECT pair_id, path, 'modified_at' FROM both_sides WHERE d3
UNION ALL SELECT pair_id, path, 'rating' FROM both_sides WHERE d4
"""

_KM = "2 * 6371.0088 * asin(sqrt(least(1, pow(sin(radians(q.lat - p.lat) / 2), 2) + cos(radians(p.lat)) * cos(radians(q.lat)) * pow(sin(radians(q.lon - p.lon) / 2), 2))))"

P1 = f"""
WITH c AS (
  SELECT DISTINCT cell_id AS id, lat, lon FROM map_cells
  WHERE lat IS NOT NULL AND lon IS NOT NULL AND NOT isnan(lat) AND NOT isnan(lon)
    AND lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180 AND NOT (lat = 0 AND lon = 0)
), near AS (
  SELECT p.id AS a_id, q.id AS b_id FROM c p JOIN c q ON q.lat BETWEEN p.lat - 0.001 AND p.lat + 0.001 AND p.id < q.id
  WHERE {_KM} <= 0.1
), poly AS (
  SELECT region_id, code, level, bbox, generate_subscripts(polys, 1) AS pn, unnest(polys) AS rings FROM geo_regions
), ring AS (
  SELECT region_id, pn, unnest(rings) AS r FROM poly
), vert AS (
  SELECT region_id, pn, r, unnest(range(1, len(r) + 1)) AS i FROM ring
), edge AS (
  SELECT region_id, pn, r[i][1] AS ax, r[i][2] AS ay, r[i % len(r) + 1][1] AS bx, r[i % len(r) + 1][2] AS by FROM vert
), box AS (
  SELECT region_id, pn, min(ax) AS x0, max(ax) AS x1, min(ay) AS y0, max(ay) AS y1 FROM edge GROUP BY ALL
), lies AS (
  SELECT DISTINCT id, region_id FROM (
    SELECT c.id, e.region_id, e.pn FROM c JOIN box b ON c.lon BETWEEN b.x0 AND b.x1 AND c.lat BETWEEN b.y0 AND b.y1
    JOIN edge e ON e.region_id = b.region_id AND e.pn = b.pn
    WHERE (e.ay > c.lat) <> (e.by > c.lat) AND c.lon < (e.bx - e.ax) * (c.lat - e.ay) / (e.by - e.ay) + e.ax
    GROUP BY c.id, e.region_id, e.pn HAVING count(*) % 2 = 1)
), reach AS (
  SELECT p.id AS a_id, q.city_id AS b_id, q.population AS pop, {_KM} AS km FROM c p JOIN geo_cities q ON q.lat BETWEEN p.lat - 0.2 AND p.lat + 0.2
  WHERE EXISTS (SELECT 1 FROM lies l JOIN geo_regions g USING (region_id) WHERE l.id = p.id AND g.level = 1 AND g.code = q.cc)
), best AS (
  SELECT a_id, b_id, row_number() OVER (PARTITION BY a_id ORDER BY km, pop DESC, b_id) AS n FROM reach WHERE km <= 20
)
SELECT 'near' AS rel, a_id, b_id FROM near
UNION ALL SELECT 'in', id, region_id FROM lies
UNION ALL SELECT 'city', a_id, b_id FROM best WHERE n = 1
"""
