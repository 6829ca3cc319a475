"""DuckDB SQL for the queries of the registry, written apart from them."""

from __future__ import annotations

PX = """px AS (SELECT vec_id AS patch_id, label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings),
pu AS (SELECT patch_id, i, i // 8 AS r, i % 8 AS c, v + ((label % 5) - 2)::DOUBLE * 0.05::DOUBLE AS u FROM px),
pc AS (SELECT patch_id, i, r, c, CASE WHEN u < -0.20::DOUBLE THEN 4 WHEN u < -0.02::DOUBLE THEN 3 WHEN u < 0.06::DOUBLE THEN 15 WHEN u < 0.12::DOUBLE THEN 18 WHEN u < 0.20::DOUBLE THEN 33 ELSE 24 END AS code FROM pu),
cl AS (SELECT *, CASE WHEN code IN (3, 5, 6, 49) THEN 0 WHEN code = 15 THEN 1 WHEN code IN (18, 19, 39, 40, 41) THEN 2 WHEN code = 33 THEN 3 WHEN code = 24 THEN 4 ELSE 255 END AS cls FROM pc)"""
CNT = PX + """,
cnt AS (SELECT patch_id, count(*) AS total, count(*) FILTER (cls <> 255) AS valid, count(*) FILTER (cls = 0) AS n0, count(*) FILTER (cls = 1) AS n1, count(*) FILTER (cls = 2) AS n2, count(*) FILTER (cls = 3) AS n3, count(*) FILTER (cls = 4) AS n4 FROM cl GROUP BY patch_id),
dom AS (SELECT *, valid::DOUBLE / total AS vf, greatest(n0, n1, n2, n3, n4) AS top,
  CASE WHEN valid = 0 THEN 'none' WHEN n0 = greatest(n0, n1, n2, n3, n4) THEN 'forest' WHEN n1 = greatest(n1, n2, n3, n4, n0) THEN 'pasture' WHEN n2 = greatest(n0, n1, n2, n3, n4) THEN 'agriculture' WHEN n3 = greatest(n0, n1, n2, n3, n4) THEN 'water' ELSE 'urban' END AS dominant_class FROM cnt),
long AS (SELECT patch_id, valid, total, dominant_class, unnest([0, 1, 2, 3, 4]) AS k, unnest([n0, n1, n2, n3, n4]) AS n FROM dom),
fr AS (SELECT *, CASE WHEN valid > 0 THEN n::DOUBLE / valid ELSE 0 END AS f FROM long)"""


def r6(x: str, n: int = 6) -> str:
    return f"round({x}, {n}) + 0.0::DOUBLE"


NAME = "['forest', 'pasture', 'agriculture', 'water', 'urban'][{} + 1]"
FR = ", ".join(f"{r6(f'CASE WHEN valid > 0 THEN n{k}::DOUBLE / valid ELSE 0 END')} AS frac_{n}" for k, n in enumerate(("forest", "pasture", "agriculture", "water", "urban")))
CLASS_FRACTIONS = f"WITH {CNT} SELECT patch_id, valid, {r6('vf')} AS valid_frac, dominant_class, n0 AS n_forest, n1 AS n_pasture, n2 AS n_agriculture, n3 AS n_water, n4 AS n_urban, {FR} FROM dom WHERE vf >= 0.8::DOUBLE"
DOMINANT_CLASS = f"WITH {CNT} SELECT dominant_class, count(*) AS patches FROM dom GROUP BY 1"
REMAP_HISTOGRAM = f"WITH {PX} SELECT d.cls::BIGINT AS cls, count(cl.cls) AS pixels, {r6('count(cl.cls) * 100.0::DOUBLE / (SELECT count(*) FROM cl)')} AS pct FROM (SELECT unnest([0, 1, 2, 3, 4, 255]) AS cls) d LEFT JOIN cl USING (cls) GROUP BY 1"
PATCH_HISTOGRAM = f"WITH {PX} SELECT patch_id, cls::BIGINT AS cls, count(*) AS n FROM cl GROUP BY 1, 2"
KEPT_DROPPED = f"""WITH {CNT}, s AS (SELECT CASE WHEN valid::DOUBLE / total >= 0.8::DOUBLE THEN 'kept' ELSE 'dropped' END AS status, k, n FROM long UNION ALL SELECT 'all', k, n FROM long),
g AS (SELECT status, {NAME.format('k')} AS class_name, sum(n)::BIGINT AS pixels FROM s GROUP BY 1, 2)
SELECT status, class_name, pixels, {r6('CASE WHEN sum(pixels) OVER (PARTITION BY status) > 0 THEN pixels * 100.0::DOUBLE / sum(pixels) OVER (PARTITION BY status) ELSE 0 END')} AS pct FROM g"""
SUMMARY_JSON = f"""WITH {PX}, g AS (SELECT cls, count(*) AS n FROM cl WHERE cls <> 255 GROUP BY cls)
SELECT '{{"ignore_value": 255, "class_ids": [0, 1, 2, 3, 4], "code_map": {{"3": 0, "5": 0, "6": 0, "49": 0, "15": 1, "18": 2, "19": 2, "39": 2, "40": 2, "41": 2, "33": 3, "24": 4}}, "global_counts": {{' || string_agg('"' || cls || '": ' || n, ', ' ORDER BY cls) || '}}}}' AS summary FROM g"""
MOSAIC = PX + ", mo AS (SELECT (patch_id // 20) * 8 + r AS r, (patch_id % 20) * 8 + c AS c, code FROM pc), hw AS (SELECT ((max(vec_id) + 20) // 20) * 8 AS h, 160 AS w FROM embeddings)"


def tiles(stride: int) -> str:
    return f"""WITH {MOSAIC}, o AS (SELECT a.y, b.x FROM (SELECT unnest(range(0, h - 31, {stride})) AS y FROM hw) a, (SELECT unnest(range(0, w - 31, {stride})) AS x FROM hw) b)
SELECT 'scene_r' || y || '_c' || x AS tile_id, count(*) AS pixels, {r6('avg((code <> 4)::INT)')} AS valid_fraction
FROM o JOIN mo ON mo.r >= y AND mo.r < y + 32 AND mo.c >= x AND mo.c < x + 32 GROUP BY y, x HAVING avg((code <> 4)::INT) >= 1 - 0.95::DOUBLE"""


ROTATE_PIXELS = f"""WITH {PX}, t AS (SELECT patch_id, 90 AS angle, c * 8 + (7 - r) AS j, code FROM pc UNION ALL SELECT patch_id, 180, (7 - r) * 8 + (7 - c), code FROM pc UNION ALL SELECT patch_id, 270, (7 - c) * 8 + r, code FROM pc)
SELECT patch_id::VARCHAR || '_rot' || angle AS patch_id, angle::INT AS angle, sum((j + 1) * code)::BIGINT AS place_sum, sum((j + 1) * (j + 1) * code)::BIGINT AS square_sum FROM t GROUP BY t.patch_id, angle"""
ROTATE_TRANSFORM = f"""WITH p AS (SELECT vec_id AS patch_id, 500000.0::DOUBLE + (vec_id % 20) * 8 * 10.0::DOUBLE AS c0, 9000000.0::DOUBLE - (vec_id // 20) * 8 * 10.0::DOUBLE AS f0 FROM embeddings),
q AS (SELECT *, unnest([8, 7]) AS n, unnest([false, true]) AS compat FROM p)
SELECT patch_id, angle::INT AS angle, compat, {', '.join(r6(f't.{n}') + f' AS {n}' for n in 'abcdef')} FROM (
SELECT patch_id, 90 AS angle, compat, 0.0::DOUBLE AS a, 10.0::DOUBLE AS b, c0 AS c, 10.0::DOUBLE AS d, 0.0::DOUBLE AS e, f0 - 10 * n AS f FROM q UNION ALL
SELECT patch_id, 180, compat, -10, 0, c0 + 10 * n, 0, 10, f0 - 10 * n FROM q UNION ALL
SELECT patch_id, 270, compat, 0, -10, c0 + 10 * n, -10, 0, f0 FROM q) t"""
AUGMENT_UNION = f"""WITH {CNT}, a AS (SELECT 0 AS angle UNION ALL SELECT 90 UNION ALL SELECT 180 UNION ALL SELECT 270)
SELECT CASE WHEN angle = 0 THEN patch_id::VARCHAR ELSE patch_id::VARCHAR || '_rot' || angle END AS patch_id, patch_id::VARCHAR AS source_patch_id, angle::BIGINT AS angle, n0 AS n_forest, valid FROM cnt, a"""
SPLITS = """l AS (SELECT CASE WHEN doc_id % 10 < 7 THEN 0 WHEN doc_id % 10 < 9 THEN 1 ELSE 2 END AS o, (doc_id % 400)::VARCHAR AS patch_id FROM documents WHERE doc_id % 50 <> 49),
sp AS (SELECT patch_id, ['train', 'val', 'test'][max(o) + 1] AS split FROM l GROUP BY patch_id)"""
SPLIT_INHERIT = f"WITH {SPLITS} SELECT vec_id::VARCHAR || '_rot' || angle AS patch_id, split FROM embeddings JOIN sp ON sp.patch_id = vec_id::VARCHAR, (SELECT unnest([90, 180, 270]) AS angle)"
SPLIT_APPEND = f"WITH {SPLITS} SELECT * FROM sp UNION ALL SELECT vec_id::VARCHAR, 'train' FROM embeddings WHERE vec_id::VARCHAR NOT IN (SELECT patch_id FROM sp)"
FINE = "d AS (SELECT h * 10 // 7 + 8 AS h2, w * 10 // 7 + 8 AS w2 FROM hw), g AS (SELECT i // w2 AS r, i % w2 AS c FROM (SELECT unnest(range(h2 * w2)) AS i, w2 FROM d))"
NEAREST_RESAMPLE = f"""WITH {MOSAIC}, {FINE},
s AS (SELECT *, floor(((c + 0.5::DOUBLE) * 7 - 13) / 10)::BIGINT AS sc, floor(((r + 0.5::DOUBLE) * -7 + 9) / -10)::BIGINT AS sr FROM g)
SELECT s.r, s.c, coalesce(mo.code, 255)::BIGINT AS v FROM s LEFT JOIN (SELECT * FROM mo WHERE code <> 3) mo ON mo.r = sr AND mo.c = sc"""
LABEL_ATTACH = f"WITH {MOSAIC} SELECT r, " + ", ".join(f"count(*) FILTER ((r + c) % {k + 2} <> 0) AS n_{n}, (sum(code * 10 + {k}) FILTER ((r + c) % {k + 2} <> 0))::BIGINT AS sum_{n}" for k, n in enumerate(("mapbiomas", "deforestation", "no_forest", "residual", "hydrography"))) + " FROM mo GROUP BY r"


def grid(dims: str) -> str:
    return f"dim AS ({dims}), g AS (SELECT i // w AS r, i % w AS c FROM (SELECT unnest(range(h * w)) AS i, w FROM dim))"


def burnt(name: str, rings: str) -> str:
    """name (r, c, burnt) of grid g: pixels whose centre is in a quadrilateral (k, x, y)."""
    edges = " UNION ALL ".join(f"SELECT k, x + {x0} AS x0, y + {y0} AS y0, x + {x1} AS x1, y + {y1} AS y1 FROM {name}_q" for x0, y0, x1, y1 in ((0, 0, 6, -2), (6, -2, 8, 5), (8, 5, -1, 4), (-1, 4, 0, 0)))
    return f"""{name}_q AS ({rings}), {name}_e AS ({edges}),
{name}_h AS (SELECT r, c, k FROM g JOIN {name}_e ON (y0 > r + 0.5) <> (y1 > r + 0.5) AND c + 0.5::DOUBLE < (x1 - x0) * (r + 0.5::DOUBLE - y0) / (y1 - y0) + x0 GROUP BY ALL HAVING count(*) % 2 = 1),
{name} AS (SELECT g.r, g.c, (b.r IS NOT NULL)::BIGINT AS burnt FROM g LEFT JOIN (SELECT DISTINCT r, c FROM {name}_h) b ON g.r = b.r AND g.c = b.c)"""


ROWS_BURNT = "SELECT r, sum(burnt)::BIGINT AS burnt, sum(burnt * c)::BIGINT AS place_sum"
RASTERIZE_POINTS = f"""WITH {grid('SELECT max(l_suppkey * 7 % 128) + 1 AS h, max(l_partkey % 160) + 1 AS w FROM lineitem')}, k AS (SELECT DISTINCT l_partkey % 160 AS c, l_suppkey * 7 % 128 AS r FROM lineitem)
SELECT g.r, count(k.r) AS burnt, coalesce(sum(CASE WHEN k.r IS NOT NULL THEN g.c END), 0)::BIGINT AS place_sum FROM g LEFT JOIN k ON g.r = k.r AND g.c = k.c GROUP BY g.r"""
RING_DIMS = "SELECT max(s_suppkey * 53 % 120) + 6 AS h, max(s_suppkey * 37 % 150) + 9 AS w FROM supplier"
RINGS = "SELECT s_suppkey AS k, ((s_suppkey * 37 + {n}) % 150)::DOUBLE AS x, ((s_suppkey * 53 + {n}) % 120)::DOUBLE AS y FROM supplier"
RASTERIZE_RINGS = f"WITH {grid(RING_DIMS)}, {burnt('b', RINGS.format(n=0))} {ROWS_BURNT} FROM b GROUP BY r"
FEATURE_SOURCES = {"deforestation": 0, "no_forest": 11, "residual": 23, "hydrography": 31}
_MEETS = "WHERE x - 1 <= 100 AND 20 <= x + 8 AND y - 2 <= 90 AND 10 <= y + 5"
FEATURE_LAYERS = f"WITH {grid(RING_DIMS)}, " + ",\n".join(burnt(name, f"SELECT * FROM ({RINGS.format(n=n)}{' WHERE s_suppkey % 3 = 1' if name == 'deforestation' else ''}) {_MEETS}") for name, n in FEATURE_SOURCES.items()) + " " + " UNION ALL ".join(f"SELECT '{name}' AS layer, * FROM ({ROWS_BURNT} FROM {name} GROUP BY r)" for name in FEATURE_SOURCES)
EXPORT_BAND = f"""WITH {MOSAIC}, {FINE},
s AS (SELECT *, floor((c + 0.5::DOUBLE) * 7 / 10)::BIGINT AS sc, floor((r + 0.5::DOUBLE) * -7 / -10)::BIGINT AS sr FROM g)
SELECT s.r, sum(coalesce(mo.code + 1, 0))::BIGINT AS total, count(mo.code) AS inside FROM s LEFT JOIN mo ON mo.r = sr AND mo.c = sc GROUP BY s.r"""
SCENE = f"""{MOSAIC}, sc AS (SELECT r, c, code, CASE WHEN code = 4 THEN 0 ELSE code END AS b2, CASE WHEN code = 33 THEN code ELSE 0 END AS b8,
  CASE WHEN (r * 7 + c) % 11 <> 0 THEN code ELSE 0 END AS mb, CASE WHEN (r + c) % 2 <> 0 THEN code * 10 + 1 ELSE 99 END AS de FROM mo),
cs AS (SELECT *, CASE WHEN mb IN (3, 5, 6, 49) THEN 0 WHEN mb = 15 THEN 1 WHEN mb IN (18, 19, 39, 40, 41) THEN 2 WHEN mb = 33 THEN 3 WHEN mb = 24 THEN 4 ELSE 255 END AS fc FROM sc),
o AS (SELECT a.y, b.x FROM (SELECT unnest(range(0, h - 31, 32)) AS y FROM hw) a, (SELECT unnest(range(0, w - 31, 32)) AS x FROM hw) b),
wi AS (SELECT 'scene_r' || y || '_c' || x AS patch_id, y, x, (r - y) * 32 + (c - x) + 1 AS i, b2, b8, mb, de, fc FROM o JOIN cs ON cs.r >= y AND cs.r < y + 32 AND cs.c >= x AND cs.c < x + 32),
ke AS (SELECT patch_id FROM wi GROUP BY patch_id HAVING avg((b2 <> 0 OR b8 <> 0)::INT) >= 1 - 0.95::DOUBLE),
ws AS (SELECT * FROM wi WHERE patch_id IN (SELECT patch_id FROM ke))"""
SCENE_PATCHES = f"""WITH {SCENE} SELECT patch_id, y AS "row", x AS col, {r6('avg((b2 <> 0 OR b8 <> 0)::INT)')} AS valid_fraction, 500000.0::DOUBLE + x * 10 AS origin_x, 9000000.0::DOUBLE - y * 10 AS origin_y,
sum(i * b2)::BIGINT AS b2_sum, sum(i * b8)::BIGINT AS b8_sum, sum(i * mb)::BIGINT AS label_sum FROM ws GROUP BY patch_id, y, x"""
SCENE_BLOCKS = f"""WITH {SCENE}, l AS (SELECT patch_id, i, unnest(['s2_rgbnir', 's2_rgbnir', 'mapbiomas', 'deforestation', 'mapbiomas_5c']) AS layer, unnest([1, 2, 1, 1, 1]) AS band, unnest([b2, b8, mb, de, fc]) AS v FROM ws)
SELECT patch_id, layer, band::BIGINT AS band, (CASE layer WHEN 'deforestation' THEN 99 WHEN 'mapbiomas_5c' THEN 255 ELSE -1 END)::DOUBLE AS nodata, sum(i * v)::BIGINT AS place_sum, count(*) AS pixels FROM l GROUP BY patch_id, layer, band"""
IMAGE_LABEL_JOIN = f"WITH {SCENE} SELECT patch_id, count(*) FILTER (fc <> 255) AS valid FROM ws WHERE (y // 32 + x // 32) % 3 = 2 GROUP BY patch_id"
REMAP_STATUS = f"""WITH {SCENE}, p AS (SELECT DISTINCT patch_id, (y // 32 + x // 32) % 3 AS k FROM ws)
SELECT patch_id, CASE k WHEN 0 THEN 'missing' WHEN 1 THEN 'written' ELSE 'exists' END AS status FROM p"""
INDEX_OF_SCENE = f"""WITH {SCENE}, n AS (SELECT patch_id, count(*) AS total, count(*) FILTER (fc <> 255) AS valid, [count(*) FILTER (fc = 0), count(*) FILTER (fc = 1), count(*) FILTER (fc = 2), count(*) FILTER (fc = 3), count(*) FILTER (fc = 4)] AS k FROM ws GROUP BY patch_id)
SELECT patch_id, 'patches/' || patch_id || '/s2_rgbnir.tif' AS image_path, 'patches/' || patch_id || '/mapbiomas_5c.tif' AS label_path, {r6('valid::DOUBLE / total')} AS label_valid_fraction,
['forest', 'pasture', 'agriculture', 'water', 'urban'][list_position(k, list_max(k))] AS dominant_class, k[4] AS n_water FROM n WHERE valid::DOUBLE / total >= 0.5::DOUBLE"""
AUGMENT_TRANSFORMS = ROTATE_TRANSFORM.replace("SELECT patch_id, angle::INT AS angle, compat,", "SELECT patch_id::VARCHAR || '_rot' || angle AS patch_id, angle::INT AS angle,") + " WHERE NOT compat"
WRITEBACK_REPEATS = "SELECT vec_id AS patch_id, CASE WHEN vec_id % 4 = 0 THEN -1 ELSE vec_id * 10 + vec_id % 4 END AS answer FROM embeddings"
SCENES = """sc AS (SELECT 'scene' || o_orderkey AS scene_id, o_orderdate AS acquired, (o_orderkey * 31 % 1000)::DOUBLE / 10 AS cloud_pct, 100.0::DOUBLE * (o_orderkey % 120) AS area_km2,
(o_orderkey * 13 % 360)::DOUBLE AS x1, (o_custkey * 7 % 180)::DOUBLE AS y1, (o_orderkey * 13 % 360)::DOUBLE + 100 AS x2, (o_custkey * 7 % 180)::DOUBLE + o_orderkey % 120 AS y2 FROM orders),
ok AS (SELECT * FROM sc WHERE acquired >= TIMESTAMP '1995-01-01' AND acquired < TIMESTAMP '1997-01-01' AND cloud_pct < 40 AND area_km2 >= 6000 AND x1 <= 180 AND 100 <= x2 AND y1 <= 90 AND 50 <= y2)"""
CATALOG_FILTER = f"WITH {SCENES} SELECT scene_id, strftime(acquired, '%Y%m%d') AS day, {r6('cloud_pct')} AS cloud_pct, {r6('area_km2')} AS area_km2 FROM ok"
CATALOG_TOP1 = f"WITH {SCENES} SELECT scene_id, strftime(acquired, '%Y%m%d') AS day, {r6('ok.cloud_pct')} AS cloud_pct FROM ok ORDER BY ok.cloud_pct, scene_id LIMIT 1"
CLOUD_BITMASK = f"SELECT event_id, {r6('CASE WHEN ((event_id * 37 % 8192) & 3072) = 0 THEN value END')} AS value FROM events"
FEATURE_SEMI = f"WITH {SCENES} SELECT 1996::INT AS year, count(*) AS features, {r6('sum(area_km2)')} AS area FROM sc WHERE year(acquired) = 1996 AND x1 <= 210 AND 190 <= x2 AND y1 <= 70 AND 50 <= y2 HAVING count(*) > 0"
NEAR = "abs(b.r - a.r) <= 1 AND abs(b.c - a.c) <= 1"


def cc(where: str, kind: str, name: str) -> str:
    """Components of equal kind by transitive closure; comp_id is the least pixel index."""
    return f"""{name}m AS (SELECT patch_id, i, r, c, {kind} AS k FROM cl WHERE {where}),
{name}w(patch_id, k, i, j, r, c) AS (SELECT patch_id, k, i, i, r, c FROM {name}m UNION SELECT a.patch_id, a.k, a.i, b.i, b.r, b.c FROM {name}w a JOIN {name}m b ON a.patch_id = b.patch_id AND a.k = b.k AND {NEAR}),
{name}r AS (SELECT patch_id, k, j, min(i) AS comp_id FROM {name}w GROUP BY patch_id, k, j),
{name} AS (SELECT x.patch_id, x.k, comp_id, count(*) AS area, min(c) AS x1, min(r) AS y1, max(c) AS x2, max(r) AS y2 FROM {name}r x JOIN {name}m m ON m.patch_id = x.patch_id AND m.i = x.j GROUP BY x.patch_id, x.k, comp_id)"""


CC = CNT + ", " + cc("cls <> 255", "cls", "comp")
CONV = CNT + ", " + cc("cls IN (1, 2)", "0", "conv")
CONNECTED = f"WITH RECURSIVE {CC} SELECT patch_id, k::BIGINT AS cls, comp_id::BIGINT AS comp_id, area, x1::BIGINT AS x1, y1::BIGINT AS y1, x2::BIGINT AS x2, y2::BIGINT AS y2 FROM comp"
SIZES = """sz AS (SELECT comp.patch_id, comp.k, area, area::DOUBLE / greatest(cnt.valid, 1) AS share, sum(area) OVER (PARTITION BY comp.patch_id, comp.k) AS n FROM comp JOIN cnt USING (patch_id)),
sd AS (SELECT patch_id, k, max(n)::BIGINT AS pixel_count, count(*) AS n_cc, max(area)::DOUBLE / max(n) AS largest, median(share) AS med, quantile_cont(share, 0.9) AS p90,
  coalesce(sum(area) FILTER (area <= 32 OR share < 0.002), 0)::DOUBLE / max(n) AS small_area, count(*) FILTER (area <= 32 OR share < 0.002) AS n_small, count(*) FILTER (share >= 0.02 OR area >= 0.1::DOUBLE * n) AS n_large FROM sz GROUP BY patch_id, k)"""
COMPONENT_SIZES = f"""WITH RECURSIVE {CC}, {SIZES} SELECT patch_id, k::BIGINT AS cls, pixel_count, n_cc, {r6('largest')} AS largest_cc_frac, {r6('med')} AS median_cc_patch_frac, {r6('p90')} AS p90_cc_patch_frac, {r6('small_area')} AS small_cc_area_frac, {r6('n_small::DOUBLE / n_cc')} AS small_cc_share, n_small AS n_small_cc_patch, n_large AS n_large_cc_patch FROM sd"""
TOUCH = f"""nb AS (SELECT a.patch_id, a.i, any_value(a.cls) AS k, count(*) FILTER (b.cls = a.cls) - 1 AS same, count(*) FILTER (b.cls <> a.cls AND b.cls <> 255) AS diff FROM cl a JOIN cl b ON a.patch_id = b.patch_id AND {NEAR} WHERE a.cls <> 255 GROUP BY a.patch_id, a.i),
tc AS (SELECT patch_id, k, count(*) FILTER (same < 8) AS boundary, count(*) FILTER (same < 8 AND diff > 0) AS contact FROM nb GROUP BY patch_id, k)"""
RATIO = "CASE WHEN boundary > 0 THEN contact::DOUBLE / boundary ELSE 0 END"
CONTACT_RATIO = f"WITH {PX}, {TOUCH} SELECT patch_id, k::BIGINT AS cls, boundary, contact, {r6(RATIO)} AS contact_ratio FROM tc"
MOM = """ms AS (SELECT patch_id, cls AS k, count(*) AS n, sum(c)::BIGINT AS sx, sum(r)::BIGINT AS sy, sum(c * c)::BIGINT AS sxx, sum(r * r)::BIGINT AS syy, sum(c * r)::BIGINT AS sxy FROM cl WHERE cls <> 255 GROUP BY patch_id, cls),
mv AS (SELECT *, (n * sxx - sx * sx) / (n * n)::DOUBLE / 49 AS vx, (n * syy - sy * sy) / (n * n)::DOUBLE / 49 AS vy, (n * sxy - sx * sy) / (n * n)::DOUBLE / 49 AS cov, sx / n::DOUBLE / 7 AS cx, sy / n::DOUBLE / 7 AS cy FROM ms),
mt AS (SELECT *, vx + vy AS trace, sqrt(greatest((vx + vy) * (vx + vy) - greatest(vx * vy - cov * cov, 0.0::DOUBLE) * 4, 0.0::DOUBLE)) AS root FROM mv),
me AS (SELECT *, sqrt(((trace + root) / 2) / greatest((trace - root) / 2, 1e-12::DOUBLE)) AS elong FROM mt)"""
MOMENTS = f"WITH {PX}, {MOM} SELECT patch_id, k::BIGINT AS cls, {r6('cy')} AS centroid_y, {r6('cx')} AS centroid_x, {r6('vx')} AS var_x, {r6('vy')} AS var_y, round(elong, 3) AS elongation FROM me"
KEPT = """kc AS (SELECT conv.*, row_number() OVER (PARTITION BY conv.patch_id ORDER BY area DESC, comp_id) AS rank FROM conv JOIN cnt USING (patch_id) WHERE area >= greatest(4, ceil(0.001::DOUBLE * greatest(cnt.valid, 1)))),
un AS (SELECT cnt.patch_id, valid, coalesce(sum(area), 0)::BIGINT AS px, count(conv.area) AS n, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2 FROM cnt LEFT JOIN conv USING (patch_id) GROUP BY cnt.patch_id, valid),
pr AS (SELECT *, valid > 0 AND px > 0 AND px::DOUBLE / greatest(valid, 1) >= 0.01::DOUBLE AS present FROM un)"""
BOX = ", ".join(f"{r6(f'CASE WHEN present THEN ({{}}{k}{plus})::DOUBLE / 8 END')} AS n{k}" for k, plus in (("x1", ""), ("y1", ""), ("x2", " + 1"), ("y2", " + 1")))
GROUNDING_BOXES = f"WITH RECURSIVE {CONV}, {KEPT} SELECT patch_id, rank::BIGINT AS rank, comp_id::BIGINT AS comp_id, area, {BOX.format(*['kc.'] * 4)} FROM kc JOIN (SELECT patch_id, present FROM pr) USING (patch_id) WHERE rank <= 3 AND present"
GROUNDING_UNION = f"WITH RECURSIVE {CONV}, {KEPT}, kn AS (SELECT patch_id, count(*) AS kept FROM kc WHERE rank <= 3 GROUP BY patch_id) SELECT patch_id, px AS pixel_count, n AS n_components, coalesce(kept, 0)::BIGINT AS kept_components, present, {BOX.format(*['pr.'] * 4)} FROM pr LEFT JOIN kn USING (patch_id)"
WRITEBACK = f"WITH {PX}, p AS (SELECT patch_id, count(*) FILTER (cls IN (1, 2)) AS px FROM cl GROUP BY patch_id), o AS (SELECT patch_id, CASE WHEN px > 0 THEN px END AS new, CASE WHEN patch_id % 3 = 0 THEN -1 END AS old FROM p) SELECT patch_id, coalesce(new, old)::BIGINT AS overwritten, coalesce(old, new)::BIGINT AS kept FROM o"
HN = "en AS (SELECT patch_id, max(f) AS top, sum(CASE WHEN f > 0 THEN -f * ln(f) ELSE 0 END) / ln(5.0::DOUBLE) AS h FROM fr GROUP BY patch_id)"
MIX = "CASE WHEN {t} >= 0.90 AND h <= 0.15 THEN 'Land cover is highly homogeneous.' WHEN h >= 0.65 THEN 'Land cover is highly mixed across classes.' WHEN h >= 0.45 THEN 'Land cover is moderately mixed.' ELSE 'Land cover is slightly mixed.' END"
ENTROPY = f"WITH {CNT}, {HN} SELECT patch_id, {r6('h')} AS entropy, {MIX.format(t='top')} AS mixture FROM en"
SEC = """rk AS (SELECT *, row_number() OVER (PARTITION BY patch_id ORDER BY n DESC, k) AS pos FROM fr WHERE valid > 0),
fo AS (SELECT patch_id, k, CASE WHEN k = 3 THEN 0 ELSE 1 END AS o, f FROM rk WHERE pos > 1 AND k IN (3, 4) AND f >= 0.01),
re AS (SELECT patch_id, k, 10 + pos AS o, f FROM rk WHERE pos > 1 AND f >= 0.01 AND (patch_id, k) NOT IN (SELECT (patch_id, k) FROM fo)),
al AS (SELECT *, row_number() OVER (PARTITION BY patch_id ORDER BY o) AS s FROM (SELECT * FROM fo UNION ALL SELECT * FROM re)),
se AS (SELECT al.* FROM al LEFT JOIN (SELECT patch_id, count(*) AS n FROM fo GROUP BY patch_id) x USING (patch_id) WHERE s <= least(3 + coalesce(x.n, 0), 4))"""
PCT = "round_even(f * 100, 0)::INT::VARCHAR"
SECONDARY = f"""WITH {CNT}, {SEC} SELECT r.patch_id, string_agg(k::VARCHAR, ',' ORDER BY pos) AS class_order, coalesce(any_value(sl.l), '') AS secondary, any_value(t.p) AS percent
FROM rk r LEFT JOIN (SELECT patch_id, string_agg({NAME.format('k')}, ',' ORDER BY s) AS l FROM se GROUP BY patch_id) sl USING (patch_id) JOIN (SELECT patch_id, {PCT} AS p FROM rk WHERE pos = 1) t USING (patch_id) GROUP BY r.patch_id"""
PHRASE = f"""ph AS (SELECT sd.patch_id, sd.k, concat_ws(', ',
  CASE WHEN largest >= 0.95 AND kr < 0.40 THEN 'a single contiguous region' WHEN largest >= 0.85 AND n_cc <= 5 AND kr >= 0.55 THEN 'a main region interwoven with other classes' WHEN largest >= 0.85 AND n_cc <= 5 THEN 'a single main block'
   WHEN largest >= 0.60 AND n_cc <= 8 THEN CASE WHEN n_cc <= 5 THEN 'in ' || n_cc || ' regions' ELSE 'a few clustered regions' END
   WHEN (n_cc >= 6 AND med <= 0.0015 AND p90 <= 0.01) OR (n_cc >= 8 AND n_small::DOUBLE / n_cc >= 0.70) OR (small_area >= 0.55 AND n_large = 0) THEN CASE WHEN n_cc <= 5 THEN 'scattered in ' || n_cc || ' regions' ELSE 'scattered in small regions' END
   WHEN n_cc >= 10 THEN 'scattered in many regions' WHEN n_cc >= 5 THEN CASE WHEN n_cc <= 5 THEN 'scattered in ' || n_cc || ' regions' ELSE 'scattered in multiple regions' END ELSE 'in ' || n_cc || ' regions' END,
  CASE WHEN elong >= 3.0 THEN 'forming a linear band' WHEN elong <= 1.5 AND vx + vy <= 0.02 THEN 'compact' END,
  CASE WHEN largest >= 0.60 OR vx + vy <= 0.05 OR n_cc <= 3 THEN CASE
    WHEN (cx <= 0.33 OR cx >= 0.67) AND (cy <= 0.33 OR cy >= 0.67) THEN 'mostly in the ' || CASE WHEN cy <= 0.33 THEN 'upper' ELSE 'lower' END || '-' || CASE WHEN cx <= 0.33 THEN 'left' ELSE 'right' END
    WHEN cx <= 0.33 OR cx >= 0.67 THEN 'mostly on the ' || CASE WHEN cx <= 0.33 THEN 'left' ELSE 'right' END || ' side' WHEN cy <= 0.33 OR cy >= 0.67 THEN 'mostly in the ' || CASE WHEN cy <= 0.33 THEN 'upper' ELSE 'lower' END || ' part' END END,
  CASE WHEN pos = 1 AND f < 0.75 AND kr >= 0.55 THEN 'with substantial intermixing' END) AS phrase
FROM sd JOIN me USING (patch_id, k) JOIN (SELECT patch_id, k, {RATIO} AS kr FROM tc) USING (patch_id, k) JOIN rk USING (patch_id, k))"""
ALLP = f"WITH RECURSIVE {CC}, {SIZES}, {TOUCH}, {MOM}, {SEC}, {PHRASE}"
PHRASES = ALLP + " SELECT patch_id, k::BIGINT AS cls, phrase FROM ph"
UP = f"upper(left({NAME.format('k')}, 1)) || substr({NAME.format('k')}, 2)"
CAPTIONS = ALLP + f""", {HN}, sb AS (SELECT patch_id, list({NAME.format('k')} || ' (about ' || {PCT} || '%)' ORDER BY s) AS l FROM se GROUP BY patch_id),
sp2 AS (SELECT patch_id, string_agg({UP} || ' is ' || phrase || '.', ' ' ORDER BY s) AS t FROM (SELECT * FROM se WHERE s <= 2) JOIN ph USING (patch_id, k) GROUP BY patch_id)
SELECT rk.patch_id, concat_ws(' ', CASE WHEN f >= 0.5 THEN 'The image is dominated by ' || {NAME.format('k')} || ' (about ' || {PCT} || '%).' ELSE 'The image shows mixed land cover.' END,
  CASE len(l) WHEN 1 THEN 'Secondary classes include ' || l[1] || '.' WHEN 2 THEN 'Secondary classes include ' || l[1] || ' and ' || l[2] || '.' ELSE CASE WHEN len(l) > 2 THEN 'Secondary classes include ' || array_to_string(l[1 : len(l) - 1], ', ') || ', and ' || l[len(l)] || '.' END END,
  {UP} || ' is ' || phrase || '.', t, {MIX.format(t='f')}) AS caption
FROM rk JOIN ph USING (patch_id, k) JOIN en USING (patch_id) LEFT JOIN sb USING (patch_id) LEFT JOIN sp2 USING (patch_id) WHERE pos = 1"""
VQA = f"WITH {CNT} SELECT patch_id, k::BIGINT AS cls, 'Is there any ' || {NAME.format('k')} || ' areas in the image?' AS question, CASE WHEN n > 0 THEN 'yes' ELSE 'no' END AS answer FROM long"
INDEX_RECORDS = f"""WITH {CNT}, p AS (SELECT patch_id, count(*) FILTER (cls IN (1, 2)) AS px FROM cl GROUP BY patch_id)
SELECT patch_id::VARCHAR AS patch_id, 'region' || (patch_id % 5) AS region, (2020 + patch_id % 3)::BIGINT AS year, {r6('vf')} AS label_valid_fraction, dominant_class, n3 AS n_water, {r6('n3::DOUBLE / valid')} AS frac_water, px > 0 AND px::DOUBLE / valid >= 0.01::DOUBLE AS present, 5::BIGINT AS n_questions FROM dom JOIN p USING (patch_id) WHERE vf >= 0.8::DOUBLE"""
DEDUPE_LAST = f"WITH e AS (SELECT 'p' || (user_id % 300) AS patch_id, event_id AS pos, {r6('events.value')} AS value FROM events WHERE user_id % 11 <> 0) SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY patch_id ORDER BY pos DESC) = 1"
ID_MATCH = "SELECT DISTINCT CASE WHEN o_orderkey % 2 = 0 THEN 'root/p' ELSE 'p' END || o_custkey AS patch_id FROM orders WHERE o_orderkey % 17 <> 0 AND o_custkey % 5 = 0 AND o_custkey IN (SELECT c_custkey FROM customer)"
REGIONS = "SELECT DISTINCT lower(n_name) AS region FROM nation WHERE n_nationkey % 3 <> 2"
SCENE_PATHS = """SELECT lower(r_name) AS region, 'S2_RGBNIR_2020_' || lower(r_name) || '_scene.tif' AS path, 'MapBiomas_2020_' || lower(r_name) || '_scene.tif' AS mapbiomas, 'PRODES_deforestation_2020_' || lower(r_name) || '_scene.tif' AS prodes_deforestation,
'PRODES_hydrography_2020_' || lower(r_name) || '_scene.tif' AS prodes_hydrography, 'PRODES_no_forest_' || lower(r_name) || '_scene.tif' AS prodes_no_forest, 'PRODES_residual_' || lower(r_name) || '_scene.tif' AS prodes_residual FROM region"""
LABEL_FALLBACK = "SELECT vec_id AS patch_id, CASE WHEN vec_id % 5 = 0 THEN vec_id || '/named.tif' WHEN vec_id % 3 = 0 THEN vec_id || '/five.tif' WHEN vec_id % 2 = 0 THEN vec_id || '/label.tif' END AS label FROM embeddings"
SKIP_EXISTING = "SELECT CASE WHEN vec_id % 4 = 1 THEN 'exists' ELSE 'written' END AS status, count(*) AS patches FROM embeddings GROUP BY 1"
JSON_TRANSFORM = """WITH e AS (SELECT event_id, CASE WHEN event_id % 50 = 0 THEN NULL ELSE (props::JSON ->> '$.k')::BIGINT END AS k FROM events) SELECT event_id, '{"k":' || (k * 2) || '}' AS record, k IS NULL AS error FROM e"""
COMPONENT_ROTATION = f"WITH RECURSIVE {CC} SELECT angle::BIGINT AS angle, k::BIGINT AS cls, count(*) AS components, sum(area)::BIGINT AS pixels FROM comp, (SELECT unnest([0, 90, 180, 270]) AS angle) GROUP BY 1, 2"
