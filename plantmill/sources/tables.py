"""Plant tables derived from the driver's tables, each written for Spark and for DuckDB from one SQL text.

Plants follow the order keys: of each `PLANT` orders three in four make a large plant and the rest a small one, so their
number grows with the data while a plant keeps its size. Only integer counts, maxima and rounded values are used, so both engines give the same rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

PLANT, SIDE, ROWS, COLS, FRAMES, RADIUS, FOCAL = 16_384, 24, 48, 64, 7, 100.0, 200.0


def _plant(order: str) -> str:
    return f"(2 * idiv({order}, {PLANT}) + (CASE WHEN {order} % 4 = 0 THEN 1 ELSE 0 END))"


#: name -> SQL over the driver's tables, or over earlier names. `//` is written idiv(a, b).
SQL = {
    "plants": f"SELECT DISTINCT {_plant('o_orderkey')} AS plant_id FROM orders",
    "voxels_seen": f"SELECT {_plant('l_orderkey')} AS plant_id, l_partkey % {SIDE} AS i, l_suppkey % {SIDE} AS j, idiv(l_orderkey, 4) % {SIDE} AS k, count(*) AS n FROM lineitem GROUP BY 1, 2, 3, 4",
    "discs": "SELECT a, b FROM (SELECT x.k - 6 AS a, y.k - 6 AS b FROM levels x, levels y WHERE x.k < 13 AND y.k < 13) g",
    "noise": f"SELECT v.plant_id, i, j, k FROM voxels_seen v JOIN (SELECT plant_id AS p, CAST(sum(n) AS BIGINT) AS total FROM voxels_seen GROUP BY 1) t ON v.plant_id = t.p WHERE n >= idiv(3 * total, {2 * SIDE**3}) + 2",
    "occupied": f"SELECT plant_id, i, j, k FROM noise UNION SELECT plant_id, CAST({SIDE // 2} + a AS BIGINT), CAST({SIDE // 2} + b AS BIGINT), CAST(k AS BIGINT) FROM plants, discs, levels WHERE a * a + b * b <= (3 + k % 3) * (3 + k % 3)",
    "pixels": f"""SELECT {_plant('l_orderkey')} AS plant_id, l_linenumber AS frame_idx, l_partkey % {ROWS} + 1 AS row, l_suppkey % {COLS} + 1 AS col,
        round(least(1.0, CAST(max(l_quantity) AS DOUBLE) / 50.0) * 255) / 255 AS r, round(least(1.0, CAST(max(l_discount) AS DOUBLE) * 10.0) * 255) / 255 AS g, round(least(1.0, CAST(max(l_tax) AS DOUBLE) * 12.5) * 255) / 255 AS b
        FROM lineitem GROUP BY 1, 2, 3, 4""",
    "angles": f"SELECT frame_idx, round(cos(2 * pi() * frame_idx / {FRAMES}), 6) AS ca, round(sin(2 * pi() * frame_idx / {FRAMES}), 6) AS sa FROM (VALUES {', '.join(f'({k})' for k in range(1, FRAMES + 1))}) v(frame_idx)",
    "frames": f"""SELECT plant_id, frame_idx, -sa AS r11, ca AS r12, CAST(0.0 AS DOUBLE) AS r13, CAST(0.0 AS DOUBLE) AS r21, CAST(0.0 AS DOUBLE) AS r22, CAST(-1.0 AS DOUBLE) AS r23, -ca AS r31, -sa AS r32, CAST(0.0 AS DOUBLE) AS r33,
        CAST(0.0 AS DOUBLE) AS t1, CAST(0.25 AS DOUBLE) AS t2, CAST({RADIUS} AS DOUBLE) + plant_id % 5 AS t3, {COLS} AS width, {ROWS} AS height, CAST({FOCAL} AS DOUBLE) AS fx, CAST({FOCAL} AS DOUBLE) AS fy, CAST({COLS / 2} AS DOUBLE) AS cx, CAST({ROWS / 2} AS DOUBLE) AS cy,
        CAST(0.01 AS DOUBLE) AS k1, CAST(0.001 AS DOUBLE) AS k2, CAST(0.0005 AS DOUBLE) AS p1, CAST(-0.0005 AS DOUBLE) AS p2 FROM plants, angles""",
    "grids": f"SELECT plant_id, CAST({-SIDE / 2} AS DOUBLE) AS ox, CAST({-SIDE / 2} AS DOUBLE) AS oy, CAST({-SIDE / 2} AS DOUBLE) AS oz, CAST({SIDE - 1} AS DOUBLE) AS wx, CAST({SIDE - 1} AS DOUBLE) AS wy, CAST({SIDE - 1} AS DOUBLE) AS wz, CAST(1.0 AS DOUBLE) AS voxel_size FROM plants",
    "fruits": """SELECT o_custkey AS plant_id, o_orderkey AS node_id, (o_orderkey % 10007) * CAST(2.399963229728653 AS DOUBLE) AS azimuth, CAST(round(o_totalprice * 100) AS BIGINT) % 1000000 AS arc FROM orders""",
    "curve_points": "SELECT user_id AS curve_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, round(CAST(value AS DOUBLE), 3) / 10 AS x, CAST(event_id % 97 AS DOUBLE) / 10 AS y, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS DOUBLE) / 2 AS z FROM events",
    "calm_points": "SELECT curve_id, seq, x / 10 AS x, y / 10 AS y, z FROM curve_points",
    "twigs": f"""SELECT plant_id, fruit, CASE WHEN plant_id % 2 = 0 THEN 1 ELSE -1 END AS side, (plant_id + (CASE WHEN plant_id % 2 = 0 THEN 3 ELSE 5 END) * fruit) % 8 AS way, 3 + 4 * fruit AS height, 6 + n % 3 AS len
        FROM (SELECT {_plant('o_orderkey')} AS plant_id, idiv(o_orderkey, 4) % 5 AS fruit, count(*) AS n FROM orders GROUP BY 1, 2) c""",
    "ways": "SELECT way, dx, dy FROM (VALUES (0, 1, 0), (1, 1, 1), (2, 0, 1), (3, -1, 1), (4, -1, 0), (5, -1, -1), (6, 0, -1), (7, 1, -1)) v(way, dx, dy)",
    "reach": "SELECT r FROM (VALUES (2), (3), (4), (5), (6), (7), (8)) v(r)",
    "girth": "SELECT a, b FROM (VALUES (-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 0), (0, 1), (1, -1), (1, 0), (1, 1)) v(a, b)",
    "levels": f"SELECT k FROM (VALUES {', '.join(f'({k})' for k in range(SIDE))}) v(k)",
    "twig_voxels": f"SELECT t.plant_id, t.fruit, r, {SIDE // 2} + dx * r AS i, {SIDE // 2} + dy * r AS j, height + idiv(r, 3) AS k, r = len AS is_tip FROM twigs t JOIN ways w ON w.way = t.way JOIN reach s ON r <= len",
    "twig_links": f"SELECT plant_id, {SIDE // 2} + dx * r AS i, {SIDE // 2} + dy * (r - s) AS j, height + idiv((r - 1), 3) AS k FROM twigs t JOIN ways w ON w.way = t.way JOIN reach z ON r <= len JOIN sides b ON s >= 0",
    "sides": "SELECT s FROM (VALUES (0), (1)) v(s)",
    "canes": f"SELECT plant_id, CAST({SIDE // 2} + a AS BIGINT) AS i, CAST({SIDE // 2} + b AS BIGINT) AS j, CAST(k AS BIGINT) AS k FROM plants, girth, levels UNION SELECT plant_id, CAST(i AS BIGINT), CAST(j AS BIGINT), CAST(k AS BIGINT) FROM twig_voxels UNION SELECT plant_id, CAST(i AS BIGINT), CAST(j AS BIGINT), CAST(k AS BIGINT) FROM twig_links",
    "debris": "SELECT a, b FROM (VALUES (1, 1), (1, 2), (2, 2)) v(a, b)",
    "littered": f"SELECT plant_id, i, j, k FROM canes UNION ALL SELECT plant_id, CAST(a AS BIGINT), CAST(b AS BIGINT), CAST(0 AS BIGINT) FROM plants, debris UNION ALL SELECT plant_id, CAST({SIDE - 2} AS BIGINT), CAST(a + plant_id % 3 AS BIGINT), CAST(b AS BIGINT) FROM plants, debris",
    "images": "SELECT l_orderkey AS plant_id, l_linenumber AS frame_idx, max(CASE WHEN l_partkey % 2 = 0 THEN 1 ELSE 0 END) AS has_pose, round(CAST(max(l_quantity) AS DOUBLE), 3) AS x, round(CAST(max(l_tax) AS DOUBLE), 3) AS y, round(CAST(max(l_discount) AS DOUBLE), 3) AS z FROM lineitem GROUP BY 1, 2",
}
NEEDS = {"calm_points": ["curve_points"], "noise": ["voxels_seen"], "discs": ["levels"], "occupied": ["noise", "plants", "discs", "levels"], "twig_voxels": ["twigs", "ways", "reach"], "twig_links": ["twigs", "ways", "reach", "sides"], "canes": ["plants", "girth", "levels", "twig_voxels", "twig_links"], "littered": ["canes", "plants", "debris"], "frames": ["plants", "angles"], "grids": ["plants"]}


def _needed(name: str) -> list[str]:
    out: list[str] = []
    for n in NEEDS.get(name, []):
        out += [x for x in [*_needed(n), n] if x not in out]
    return out


def with_clause(*names: str) -> str:
    """`WITH name AS (...), ...` in DuckDB's dialect for the named tables and what they need."""
    order: list[str] = []
    for n in names:
        order += [x for x in [*_needed(n), n] if x not in order]
    return "WITH " + ",\n".join(f"{n} AS ({re.sub(r'idiv[(]([^,]+), ([^)]+)[)]', r'(\1 // \2)', SQL[n])})" for n in order)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived table, or one of the driver's."""
    if name not in SQL:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = re.sub(r"idiv[(]([^,]+), ([^)]+)[)]", r"(\1 div \2)", SQL[name])
    used = {t: load(spark, sf_dir, t) for t in ("orders", "lineitem", "events", *NEEDS.get(name, [])) if re.search(rf"\b{t}\b", text)}
    for t in used:
        text = re.sub(rf"(\bFROM|\bJOIN|,) {t}\b", rf"\1 {{{t}}}", text)
    return spark.sql(text, **used)
