"""One query for each operator over the driver's tables, and the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from somatrix.functions import shape, text
from somatrix.operators import descent, facts, neighbors, raster, selection, stats
from somatrix.plans.views import CELLS_SQL, DENSE, FEATURES, PX_SQL, SPARSE, cells, foreground, px
from somatrix.tables import materialise, table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, *columns: str, places: int = 4) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in columns})


# Raster

#: Components by recursion over reachable pixels: each pixel's label is the least code it reaches.
COMPONENTS_SQL = """WITH RECURSIVE {px},
fg AS (SELECT img, r, c, r * 2147483648 + c AS code FROM sparse),
links AS (SELECT a.img, a.code AS a, b.code AS b FROM fg a JOIN fg b ON a.img = b.img AND abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1 AND {near}),
walk AS (SELECT img, code, code AS reached FROM fg UNION SELECT w.img, w.code, l.b FROM walk w JOIN links l ON w.img = l.img AND w.reached = l.a),
labelled AS (SELECT img, code, CAST(min(reached) AS BIGINT) AS label FROM walk GROUP BY img, code),
stats AS (SELECT img, label, count(*) AS area, min(code // 2147483648) AS top, min(code % 2147483648) AS "left", max(code // 2147483648) - min(code // 2147483648) + 1 AS height,
  max(code % 2147483648) - min(code % 2147483648) + 1 AS width FROM labelled GROUP BY img, label)
"""


def _components_sql(near: str, select: str) -> str:
    return COMPONENTS_SQL.format(px=PX_SQL, near=near) + select


NEAR8, NEAR4 = "true", "abs(a.r - b.r) + abs(a.c - b.c) <= 1"


def _labelled(spark: SparkSession, sf_dir: str, connectivity: int) -> DataFrame:
    return raster.label_components(foreground(spark, sf_dir, SPARSE), connectivity, tile=32)


def _component_summary(spark: SparkSession, sf_dir: str, connectivity: int) -> DataFrame:
    found = raster.component_stats(_labelled(spark, sf_dir, connectivity))
    return found.groupBy("img").agg(F.count("*").alias("n"), F.max("area").alias("max_area"), F.sum("area").alias("pixels"))


_SUMMARY = "SELECT img, count(*) AS n, max(area) AS max_area, CAST(sum(area) AS BIGINT) AS pixels FROM stats GROUP BY img"


@query(_components_sql(NEAR8, _SUMMARY))
def components8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _component_summary(spark, sf_dir, 8)


@query(_components_sql(NEAR4, _SUMMARY))
def components4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _component_summary(spark, sf_dir, 4)


@query(_components_sql(NEAR8, """SELECT img, row_number() OVER (PARTITION BY img ORDER BY label) AS cell, area, CAST(top AS BIGINT) AS top, CAST("left" AS BIGINT) AS "left",
  CAST(height AS BIGINT) AS height, CAST(width AS BIGINT) AS width, round(width / height, 6) AS aspect_ratio FROM stats WHERE area BETWEEN 3 AND 24000000"""))
def bbox_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = raster.number_cells(raster.component_stats(_labelled(spark, sf_dir, 8)), least=3)
    aspect = F.round(F.col("width") / F.col("height"), 6).alias("aspect_ratio")
    return found.select("img", F.col("cell").cast("long").alias("cell"), "area", "top", "left", "height", "width", aspect)


@query(_components_sql(NEAR8, "SELECT img, CAST(code // 2147483648 AS BIGINT) AS r, CAST(code % 2147483648 AS BIGINT) AS c FROM labelled JOIN stats USING (img, label) WHERE area > 3"))
def erase_small(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.erase_small(_labelled(spark, sf_dir, 8), 3)


@query(_components_sql(NEAR8, """, best AS (SELECT img, label FROM (SELECT img, label, row_number() OVER (PARTITION BY img ORDER BY area DESC, label) AS k FROM stats) WHERE k = 1)
SELECT img, CAST(code // 2147483648 AS BIGINT) AS r, CAST(code % 2147483648 AS BIGINT) AS c FROM labelled JOIN best USING (img, label)"""))
def largest_object(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.largest_component(_labelled(spark, sf_dir, 8))


@query(_components_sql(NEAR8, """, boxes AS (SELECT img, row_number() OVER (PARTITION BY img ORDER BY label) AS cell, top, "left", height, width FROM stats WHERE area >= 3)
SELECT b.img, b.cell, CAST(p.r - b.top AS BIGINT) AS r, CAST(p.c - b."left" AS BIGINT) AS c FROM boxes b JOIN sparse p ON p.img = b.img AND p.r BETWEEN b.top AND b.top + b.height - 1 AND p.c BETWEEN b."left" AND b."left" + b.width - 1"""))
def crop_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = raster.number_cells(raster.component_stats(_labelled(spark, sf_dir, 8)), least=3)
    found = raster.crops(foreground(spark, sf_dir, SPARSE), boxes.select("img", "cell", "top", "left", "height", "width"))
    return found.select("img", F.col("cell").cast("long").alias("cell"), F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"))


def _px_sql(select: str) -> str:
    return f"WITH {PX_SQL.strip()},\nsize AS (SELECT img, max(r) + 1 AS h, max(c) + 1 AS w FROM px GROUP BY img){select}"


_CLASS = """,
votes AS (SELECT a.img, a.r, a.c, count(b.r) AS n FROM sparse a LEFT JOIN sparse b ON a.img = b.img AND abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1 AND (a.r <> b.r OR a.c <> b.c) GROUP BY a.img, a.r, a.c),
classed AS (SELECT img, r, c, n, CASE WHEN n = 1 THEN 'end' WHEN n = 2 THEN 'path' WHEN n >= 3 THEN 'junction' ELSE 'isolated' END AS kind FROM votes)
"""


@query(_px_sql(_CLASS + "SELECT img, kind, count(*) AS pixels, CAST(sum(n) AS BIGINT) AS neighbours FROM classed GROUP BY img, kind"))
def neighbor_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = raster.neighbour_class(foreground(spark, sf_dir, SPARSE))
    return found.groupBy("img", "kind").agg(F.count("*").alias("pixels"), F.sum("n").alias("neighbours"))


@query(_px_sql(_CLASS + """, body AS (SELECT img, r, c FROM px WHERE v > 0.25),
band AS (SELECT DISTINCT b.img, b.r + dr.d AS r, b.c + dc.d AS c FROM body b, (VALUES (-1), (0), (1)) dr(d), (VALUES (-1), (0), (1)) dc(d))
SELECT img, k AS kind, count(*) AS pixels FROM (SELECT classed.img, CASE WHEN band.img IS NOT NULL THEN 'initial' ELSE kind END AS k FROM classed LEFT JOIN band USING (img, r, c)) GROUP BY img, k"""))
def contact_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    pixels = px(spark, sf_dir)
    found = raster.feature_class(foreground(spark, sf_dir, SPARSE), foreground(spark, sf_dir, 0.25), raster.extent(pixels))
    return found.groupBy("img", "kind").agg(F.count("*").alias("pixels"))


#: Objects of ``nodes`` (img, kind, conn, r, c), by recursion: two of one image, kind and connectivity are linked where they touch.
_WALK = """,
coded AS (SELECT *, r * 2147483648 + c AS code FROM nodes),
links AS (SELECT a.img, a.kind, a.conn, a.code AS a, b.code AS b FROM coded a JOIN coded b ON a.img = b.img AND a.kind = b.kind AND a.conn = b.conn AND abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1 AND (a.conn = 8 OR abs(a.r - b.r) + abs(a.c - b.c) <= 1)),
walk AS (SELECT img, kind, conn, code, code AS reached FROM coded UNION SELECT w.img, w.kind, w.conn, w.code, l.b FROM walk w JOIN links l ON w.img = l.img AND w.kind = l.kind AND w.conn = l.conn AND w.reached = l.a),
objects AS (SELECT img, kind, conn, code, CAST(min(reached) AS BIGINT) AS label FROM walk GROUP BY img, kind, conn, code)
"""


def _recursive(select: str) -> str:
    return _px_sql(select).replace("WITH", "WITH RECURSIVE", 1)


@query(_recursive(_CLASS + """, body AS (SELECT img, r, c FROM px WHERE v > 0.25),
band AS (SELECT DISTINCT b.img, b.r + dr.d AS r, b.c + dc.d AS c FROM body b, (VALUES (-1), (0), (1)) dr(d), (VALUES (-1), (0), (1)) dc(d)),
final AS (SELECT classed.img, classed.r, classed.c, CASE WHEN band.img IS NOT NULL THEN 'initial' ELSE kind END AS kind FROM classed LEFT JOIN band ON classed.img = band.img AND classed.r = band.r AND classed.c = band.c),
nodes AS (SELECT img, kind, 4 AS conn, r, c FROM final WHERE kind <> 'isolated' UNION ALL SELECT img, kind, 8, r, c FROM final WHERE kind = 'path')""" + _WALK + """,
n AS (SELECT img, kind, conn, count(DISTINCT label) AS n FROM objects GROUP BY img, kind, conn),
wide AS (SELECT f.img, coalesce(max(n) FILTER (kind = 'end'), 0) AS end_points, coalesce(max(n) FILTER (kind = 'junction'), 0) AS junctions, coalesce(max(n) FILTER (conn = 8), 0) AS branches,
  coalesce(max(n) FILTER (kind = 'initial'), 0) AS initial_points, coalesce(max(n) FILTER (kind = 'path' AND conn = 4), 0) AS paths FROM (SELECT DISTINCT img FROM final) f LEFT JOIN n ON f.img = n.img GROUP BY f.img)
SELECT img, end_points, junctions, branches, initial_points, paths + end_points AS total_branches_length, end_points / nullif(initial_points, 0) AS ratio_branches FROM wide"""))
def skeleton_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    pixels = px(spark, sf_dir)
    classed = materialise(raster.feature_class(foreground(spark, sf_dir, SPARSE), foreground(spark, sf_dir, 0.25), raster.extent(pixels)), "classed")
    return raster.skeleton_features(classed)


_ERODE = """,
eroded AS (SELECT d.img, d.r, d.c FROM dense d JOIN size s ON d.img = s.img JOIN dense e ON d.img = e.img AND abs(d.r - e.r) <= {k} AND abs(d.c - e.c) <= {k}
  GROUP BY d.img, d.r, d.c, s.h, s.w HAVING count(*) = (least(s.h - 1, d.r + {k}) - greatest(0, d.r - {k}) + 1) * (least(s.w - 1, d.c + {k}) - greatest(0, d.c - {k}) + 1))
"""


@query(_px_sql(_ERODE.format(k=1) + "SELECT img, CAST(r AS BIGINT) AS r, CAST(c AS BIGINT) AS c FROM eroded"))
def erode(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = raster.erode(foreground(spark, sf_dir, DENSE), raster.extent(px(spark, sf_dir)))
    return found.select("img", F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"))


@query(_px_sql(_ERODE.format(k=4) + "SELECT img, count(*) AS pixels FROM eroded GROUP BY img"))
def erode4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.erode(foreground(spark, sf_dir, DENSE), raster.extent(px(spark, sf_dir)), 4).groupBy("img").agg(F.count("*").alias("pixels"))


@query(_px_sql("""
SELECT img, count(*) AS pixels FROM (SELECT DISTINCT b.img, b.r + dr.d AS r, b.c + dc.d AS c FROM sparse b, (VALUES (-1), (0), (1)) dr(d), (VALUES (-1), (0), (1)) dc(d)) x JOIN size USING (img)
WHERE r >= 0 AND c >= 0 AND r < h AND c < w GROUP BY img"""))
def dilate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.dilate(foreground(spark, sf_dir, SPARSE), raster.extent(px(spark, sf_dir))).groupBy("img").agg(F.count("*").alias("pixels"))


@query(None)
def soma_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = raster.soma(foreground(spark, sf_dir, DENSE), raster.extent(px(spark, sf_dir)), iterations=2, frame=10)
    return found.groupBy("img").agg(F.count("*").alias("pixels"), F.min("r").alias("top"), F.max("r").alias("bottom"))


@query(_px_sql(""",
low AS (SELECT img, r, c FROM px WHERE v > 0.1), other AS (SELECT img, r, c FROM px WHERE v < 0.2 AND v > 0)
SELECT 'difference' AS op, img, count(*) AS pixels FROM (SELECT * FROM low EXCEPT SELECT * FROM other) GROUP BY img
UNION ALL SELECT 'intersection', img, count(*) FROM (SELECT * FROM low INTERSECT SELECT * FROM other) GROUP BY img
UNION ALL SELECT 'union', img, count(*) FROM (SELECT * FROM low UNION SELECT * FROM other) GROUP BY img
UNION ALL SELECT 'complement', img, count(*) FROM (SELECT img, r, c FROM px EXCEPT SELECT * FROM low) GROUP BY img"""))
def pixel_setops(spark: SparkSession, sf_dir: str) -> DataFrame:
    pixels = px(spark, sf_dir)
    low, other = pixels.filter("v > 0.1").select("img", "r", "c"), pixels.filter("v < 0.2 and v > 0").select("img", "r", "c")
    found = {"difference": raster.difference(low, other), "intersection": raster.intersection(low, other), "union": raster.union(low, other), "complement": raster.difference(pixels.select("img", "r", "c"), low)}
    return facts.concat_tables([df.groupBy("img").agg(F.count("*").alias("pixels")).select(F.lit(op).alias("op"), "img", "pixels") for op, df in found.items()])


_BOXES = """, boxes AS (SELECT img, size, count(*) AS n FROM (SELECT DISTINCT img, s.size, r // s.size AS br, c // s.size AS bc FROM sparse, (VALUES (2), (4), (8), (16)) s(size)) GROUP BY img, size)
"""


@query(_px_sql(_BOXES + "SELECT img, CAST(size AS INTEGER) AS size, n FROM boxes"))
def box_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.box_counts(foreground(spark, sf_dir, SPARSE), (2, 4, 8, 16))


@query(_px_sql(_BOXES + "SELECT img, round(regr_slope(ln(n), ln(size)), 6) AS slope FROM boxes GROUP BY img"))
def fractal_slope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(raster.fractal_slope(raster.box_counts(foreground(spark, sf_dir, SPARSE), (2, 4, 8, 16))), "slope", places=6)


@query(_px_sql(""",
centre AS (SELECT img, CAST(avg(r) AS INTEGER) AS r0, CAST(avg(c) AS INTEGER) AS c0 FROM px GROUP BY img),
d AS (SELECT p.img, sqrt((p.r - r0) * (p.r - r0) + (p.c - c0) * (p.c - c0)) AS d FROM sparse p JOIN centre USING (img)),
k AS (SELECT img, d, CAST(floor((d - 5) / 10 + 0.5) AS BIGINT) AS ring FROM d)
SELECT img, ring, count(*) AS pixels FROM k WHERE ring >= 0 AND abs(d - (5 + 10 * ring)) <= 1 GROUP BY img, ring"""))
def sholl_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    pixels = px(spark, sf_dir)
    centres = pixels.groupBy("img").agg(F.bround(F.avg("r")).cast("int").alias("r0"), F.bround(F.avg("c")).cast("int").alias("c0"))
    return raster.sholl(foreground(spark, sf_dir, SPARSE), centres, 5, 10).select("img", "ring", "pixels")


@query(_px_sql("""
SELECT img, round(max(sqrt(x * x + y * y)), 6) AS max_distance, CAST(greatest(0, ceil((floor(max(sqrt(x * x + y * y))) - 25) / 10)) AS BIGINT) AS circles
FROM (SELECT img, 3 - a * h AS x, 5 - b * w AS y FROM size, (VALUES (0), (1)) i(a), (VALUES (0), (1)) j(b)) GROUP BY img"""))
def sholl_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = raster.extent(px(spark, sf_dir))
    return rounded(raster.sholl_reach(size.select("img", F.lit(3).alias("r0"), F.lit(5).alias("c0")), size), "max_distance", places=6)


@query(_px_sql("""
SELECT img, colour, count(*) AS pixels FROM (SELECT img, r // 2 AS r, c // 2 AS c, arg_max(CAST(floor(abs(v) * 100) AS BIGINT), r * 64 + c) AS colour FROM px WHERE v > 0.1 GROUP BY img, r // 2, c // 2) GROUP BY img, colour"""))
def overlay_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    layers = px(spark, sf_dir).filter("v > 0.1").select("img", (F.col("r") / 2).cast("int").alias("r2"), (F.col("c") / 2).cast("int").alias("c2"), (F.col("r") * 64 + F.col("c")).alias("cell"), F.floor(F.abs("v") * 100).alias("colour"))
    return raster.overlay(layers.withColumnsRenamed({"r2": "r", "c2": "c"})).groupBy("img", "colour").agg(F.count("*").alias("pixels"))


@query(_components_sql(NEAR8, """, b AS (SELECT img, label, area % 3 AS cluster, height, width FROM stats WHERE area >= 3)
SELECT img, cluster, label AS cell, CAST(height AS BIGINT) AS height, CAST(width AS BIGINT) AS width,
  CAST(coalesce(sum(width) OVER (PARTITION BY img, cluster ORDER BY label ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset", CAST(max(height) OVER (PARTITION BY img) AS BIGINT) AS padded FROM b"""))
def strip_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = raster.component_stats(_labelled(spark, sf_dir, 8)).filter("area >= 3")
    boxes = found.select("img", (F.col("area") % 3).alias("cluster"), F.col("label").alias("cell"), "height", "width")
    return raster.strips(boxes).select("img", "cluster", "cell", "height", "width", "offset", "padded")


@query(_px_sql(" SELECT img, count(*) AS pixels, CAST(sum(CASE WHEN v > 0 THEN 1 ELSE 0 END) AS BIGINT) AS area, CAST(sum(floor(pow(least(greatest(v, 0), 1), 1.25) * 255)) AS BIGINT) AS gamma FROM px GROUP BY img"))
def gamma_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.least(F.greatest(F.col("v"), F.lit(0.0)), F.lit(1.0))
    return px(spark, sf_dir).groupBy("img").agg(F.count("*").alias("pixels"), F.count_if(F.col("v") > 0).alias("area"), F.sum(raster.gamma(value * 255, 1.25).cast("long")).alias("gamma"))


# Facts


def _cells_sql(select: str) -> str:
    return f"WITH {CELLS_SQL.strip()}\n{select}"


@query(_cells_sql("""SELECT "group" || '_' || treatment || '_' || region AS categories, 'C' || cell || '_' || region || '_' || "group" || '_' || treatment || '_' || tissue || '_' || subject AS cell_id, cell, cluster FROM cells"""))
def fact_union_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = cells(spark, sf_dir)
    halves = [whole.filter("cell % 2 = 0"), whole.filter("cell % 2 <> 0")]
    return facts.with_keys(facts.concat_tables(halves)).select("categories", "cell_id", "cell", "cluster")


@query("""SELECT o_orderkey AS cell, a.n AS lines, round(b.quantity, 2) AS quantity, c.price / nullif(b.quantity, 0) AS solidity
FROM orders JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) a ON o_orderkey = a.l_orderkey JOIN (SELECT l_orderkey, sum(CAST(l_quantity AS DECIMAL(18,2)))::DOUBLE AS quantity FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) b ON o_orderkey = b.l_orderkey
JOIN (SELECT l_orderkey, sum(CAST(l_extendedprice AS DECIMAL(18,2)))::DOUBLE AS price FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1) c ON o_orderkey = c.l_orderkey""")
def feature_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "cell")
    counted = lines.groupBy("cell").agg(F.count("*").alias("lines"))
    quantity = lines.filter("l_returnflag = 'R'").groupBy("cell").agg(F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("cell_area"))
    price = lines.filter("l_linestatus = 'F'").groupBy("cell").agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("price"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("cell"))
    joined = facts.join_features([orders, counted, quantity, price], ("cell",)).withColumn("convex_hull_area", F.col("cell_area")).withColumn("cell_area", F.col("price"))
    whole = facts.with_ratios(joined)
    return whole.select("cell", "lines", F.round("convex_hull_area", 2).alias("quantity"), F.col("cell_solidity").alias("solidity"))


_NAMES = "(SELECT c_custkey, 'R' || c_custkey || '_' || c_mktsegment || '_SS_T' || c_nationkey || '_CA1' || CASE WHEN c_custkey % 2 = 0 THEN '_FOTO1_PROCESSED' ELSE '' END || '.tif' AS name FROM customer)"


def _image_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    suffix = F.when(F.col("c_custkey") % 2 == 0, "_FOTO1_PROCESSED").otherwise("")
    name = F.concat(F.lit("R"), F.col("c_custkey").cast("string"), F.lit("_"), "c_mktsegment", F.lit("_SS_T"), F.col("c_nationkey").cast("string"), F.lit("_CA1"), suffix, F.lit(".tif"))
    return table(spark, sf_dir, "customer").select("c_custkey", name.alias("name"))


@query(rf"""SELECT c_custkey, regexp_extract(name, '^([^_]+)_([^_]+)_', 1) AS subject, regexp_extract(name, '^([^_]+)_([^_]+)_', 2) AS "group", split_part(name, '_', 4) AS tissue, 'CA1' AS region,
CAST(regexp_extract(name, '(\d+)', 1) AS INTEGER) AS first_number, left(name, length(name) - 4) AS stem FROM {_NAMES}""")
def name_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = _image_names(spark, sf_dir)
    parsed = [text.image_dimension(F.col("name"), d).alias(d) for d in ("subject", "group", "tissue", "region")]
    return names.select("c_custkey", *parsed, text.first_number(F.col("name")).alias("first_number"), text.without_extension(F.col("name")).alias("stem"))


@query("SELECT p_partkey, CAST(p_partkey AS INTEGER) AS cell, CAST(p_size AS INTEGER) AS x1, CAST(p_size + 1 AS INTEGER) AS y1, CAST(p_size * 2 AS INTEGER) AS x2, CAST(p_size * 3 AS INTEGER) AS y2 FROM part")
def box_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    name = F.concat(F.lit("R3_cell_"), F.col("p_partkey").cast("string"), F.lit(".tif"))
    box = F.format_string("(%d, %d, %d, %d)", "p_size", F.col("p_size") + 1, F.col("p_size") * 2, F.col("p_size") * 3)
    return part.select("p_partkey", text.cell_number(name).alias("cell"), text.box_from_text(box).alias("b")).select("p_partkey", "cell", "b.*")


@query("""SELECT base, extension FROM (SELECT base, extension, row_number() OVER (PARTITION BY base ORDER BY rank) AS k FROM
(SELECT page_id // 3 AS base, e.extension, e.rank FROM pages JOIN (VALUES (0, '.tif', 0), (1, '.tiff', 1), (2, '.png', 2), (3, '.jpg', 3)) e(m, extension, rank) ON (page_id * 7) % 5 = e.m)) WHERE k = 1""")
def ext_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    extension = F.element_at(F.array(*map(F.lit, [*text.EXTENSIONS, ".bmp"])), ((F.col("page_id") * 7) % 5 + 1).cast("int"))
    files = table(spark, sf_dir, "pages").select(F.floor(F.col("page_id") / 3).alias("base"), extension.alias("extension"))
    return facts.first_extension(files).select("base", "extension")


@query(_cells_sql("SELECT cell FROM cells WHERE \"group\" IN ('BUILDING', 'MACHINERY') AND treatment IN ('O', 'F') AND region IN ('ASIA', 'EUROPE', 'AFRICA')"))
def dimension_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = {"group": ["BUILDING", "MACHINERY"], "treatment": ["O", "F"], "region": ["ASIA", "EUROPE", "AFRICA"]}
    dimensions = {d: spark.createDataFrame([(v,) for v in values], f"{d} string") for d, values in lists.items()}
    return facts.probe_names(cells(spark, sf_dir), dimensions).select("cell")


@query(_cells_sql("""SELECT cell, CASE "group" WHEN 'BUILDING' THEN 'B' WHEN 'MACHINERY' THEN 'M' ELSE "group" END AS kept, CASE "group" WHEN 'BUILDING' THEN 'B' WHEN 'MACHINERY' THEN 'M' END AS nulled,
CASE cluster WHEN 1 THEN 4 WHEN 2 THEN 3 WHEN 3 THEN 2 WHEN 4 THEN 1 ELSE cluster END AS cluster FROM cells"""))
def category_recode(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = spark.createDataFrame([("BUILDING", "B"), ("MACHINERY", "M")], "old string, new string")
    numbers = spark.createDataFrame([(1, 4), (2, 3), (3, 2), (4, 1)], "old int, new int")
    whole = facts.recode(facts.recode(cells(spark, sf_dir), "group", names, to="kept"), "group", names, "null", to="nulled")
    return facts.recode(whole, "cluster", numbers).select("cell", "kept", "nulled", "cluster")


@query(_cells_sql("""SELECT cell, coalesce(colour, '128,128,128') AS colour, CAST(coalesce(split_part(colour, ',', 2), '128') AS INTEGER) AS green FROM cells LEFT JOIN
(SELECT cluster, arg_max(CAST(cell % 256 AS VARCHAR) || ',' || CAST(cell % 16 AS VARCHAR) || ',0', cell) AS colour FROM cells WHERE cluster < 4 GROUP BY cluster) USING (cluster)"""))
def color_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = cells(spark, sf_dir)
    coloured = whole.filter("cluster < 4").withColumn("colour", text.colour_text(F.col("cell") % 256, F.col("cell") % 16, F.lit(0)))
    found = facts.with_colours(whole, facts.colour_dimension(coloured))
    return found.select("cell", "colour", text.colour_from_text(F.col("colour"))[1].alias("green"))


@query(_cells_sql("SELECT \"group\", treatment, region, count(*) AS n, count(*) > 0 AS present FROM cells WHERE region = 'ASIA' GROUP BY ALL"))
def partitioned_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    asia = facts.matching(cells(spark, sf_dir), spark.createDataFrame([("ASIA",)], "region string"))
    return asia.groupBy("group", "treatment", "region").agg(F.count("*").alias("n"), (F.count("*") > 0).alias("present"))


@query(_cells_sql("SELECT cell, \"group\" = 'BUILDING' AS highlight, cluster = -1 AS noise FROM cells"))
def highlight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.highlight(facts.highlight(cells(spark, sf_dir), "group", "BUILDING"), "cluster", -1, "noise").select("cell", "highlight", "noise")


# Group summaries and tests


@query(_cells_sql('SELECT "group", cluster, count(*) AS n FROM cells WHERE cluster <> -1 GROUP BY ALL'))
def cluster_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.counts(facts.without_noise(cells(spark, sf_dir)), "group", "cluster")


@query(_cells_sql('SELECT "group", cluster, n, round(n / sum(n) OVER (PARTITION BY "group"), 6) AS share, round(100 * n / sum(n) OVER (PARTITION BY "group"), 2) AS percent FROM (SELECT "group", cluster, count(*) AS n FROM cells WHERE cluster <> -1 GROUP BY ALL)'))
def cluster_pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = stats.shares(facts.without_noise(cells(spark, sf_dir)), "group", "cluster")
    return found.select("group", "cluster", "n", F.round("share", 6).alias("share"), F.round("percent", 2).alias("percent"))


@query(_cells_sql("""SELECT o.ord, o.g AS "group", count(*) FILTER (WHERE cluster = 0) AS "0", count(*) FILTER (WHERE cluster = 1) AS "1", count(*) FILTER (WHERE cluster = 2) AS "2"
FROM (VALUES (0, 'MACHINERY'), (1, 'BUILDING'), (2, 'NONE')) o(ord, g) LEFT JOIN cells ON cells."group" = o.g GROUP BY ALL"""))
def cluster_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.pivoted(cells(spark, sf_dir), "group", "cluster", [0, 1, 2], ["MACHINERY", "BUILDING", "NONE"])


def _z_sql(spread: str) -> str:
    scaled = ", ".join(f"({f} - avg({f}) OVER ()) / nullif({spread}({f}) OVER (), 0) AS {f}" for f in FEATURES)
    means = ", ".join(f"round(avg({f}), 4) + 0.0 AS {f}" for f in FEATURES)
    return _cells_sql(f'SELECT "group", {means} FROM (SELECT "group", {scaled} FROM cells) GROUP BY "group"')


def _z(spark: SparkSession, sf_dir: str, population: bool) -> DataFrame:
    means = stats.group_means(stats.z_scores(cells(spark, sf_dir), FEATURES, population), "group", FEATURES)
    return means.select("group", *[(F.round(f, 4) + 0.0).alias(f) for f in FEATURES])


@query(_z_sql("stddev_samp"))
def zscore_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _z(spark, sf_dir, False)


@query(_z_sql("stddev_pop"))
def zscore_pop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _z(spark, sf_dir, True)


#: Features with gaps, for what missing values do to correlations.
_GAPS_SQL = ", gaps AS (SELECT CASE WHEN cell % 10 = 0 THEN NULL ELSE quantity END AS quantity, price, CASE WHEN cell % 7 = 1 THEN NULL ELSE total END AS total, balance FROM cells)"
_GAPPED = ("quantity", "price", "total", "balance")


def _corr_sql(missing: str) -> str:
    rows = []
    for a in _GAPPED:
        for b in _GAPPED:
            r = f"corr({a}, {b})" if missing != "propagate" else f"CASE WHEN count(*) FILTER (WHERE {a} IS NULL OR {b} IS NULL) = 0 THEN corr({a}, {b}) END"
            rows.append(f"SELECT '{a}' AS f1, '{b}' AS f2, round({r}, 6) + 0.0 AS r FROM g")
    g = "SELECT * FROM gaps" + (" WHERE " + " AND ".join(f"{f} IS NOT NULL" for f in _GAPPED) if missing == "complete" else "")
    return f"WITH {CELLS_SQL.strip()}{_GAPS_SQL}, g AS ({g})\n" + " UNION ALL ".join(rows)


def _corr(spark: SparkSession, sf_dir: str, missing: str) -> DataFrame:
    gaps = cells(spark, sf_dir).select(F.when(F.col("cell") % 10 != 0, F.col("quantity")).alias("quantity"), "price", F.when(F.col("cell") % 7 != 1, F.col("total")).alias("total"), "balance")
    return stats.correlations(gaps, _GAPPED, missing).select("f1", "f2", (F.round("r", 6) + 0.0).alias("r"))


@query(_corr_sql("pairwise"))
def corr_pairwise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _corr(spark, sf_dir, "pairwise")


@query(_corr_sql("complete"))
def corr_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _corr(spark, sf_dir, "complete")


@query(_corr_sql("propagate"))
def corr_propagate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _corr(spark, sf_dir, "propagate")


_EXPECTED = """, o AS (SELECT "group" AS g, cluster AS k, count(*) AS n FROM cells WHERE cluster <> -1 GROUP BY ALL),
e AS (SELECT a.g, b.k, coalesce(o.n, 0) AS n, a.n * b.n / t.n AS expected FROM (SELECT g, sum(n) AS n FROM o GROUP BY g) a CROSS JOIN (SELECT k, sum(n) AS n FROM o GROUP BY k) b CROSS JOIN (SELECT sum(n) AS n FROM o) t LEFT JOIN o ON o.g = a.g AND o.k = b.k)
"""


def _observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.counts(facts.without_noise(cells(spark, sf_dir)), "group", "cluster")


@query(f"WITH {CELLS_SQL.strip()}{_EXPECTED}SELECT round(sum((n - expected) * (n - expected) / expected), 6) AS chi2, CAST((count(DISTINCT g) - 1) * (count(DISTINCT k) - 1) AS INTEGER) AS df FROM e")
def chi_square(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.chi_square(_observed(spark, sf_dir), "group", "cluster").drop("p"), "chi2", places=6)


@query(f"""WITH {CELLS_SQL.strip()}{_EXPECTED}SELECT g AS "group", k AS cluster, CAST(n AS BIGINT) AS n, round((n - expected) / sqrt(expected), 6) + 0.0 AS residual, round(100 * (n - expected) * (n - expected) / expected / sum((n - expected) * (n - expected) / expected) OVER (), 4) AS contribution,
round(100.0 * n * n / sum(n) OVER (), 3) AS square_share FROM e""")
def chi_residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = stats.chi_square_cells(_observed(spark, sf_dir), "group", "cluster")
    return found.select("group", "cluster", "n", (F.round("residual", 6) + 0.0).alias("residual"), F.round("contribution", 4).alias("contribution"), "square_share")


@query(f"WITH {CELLS_SQL.strip()}{_EXPECTED}SELECT CAST((count(DISTINCT g) - 1) * (count(DISTINCT k) - 1) AS INTEGER) AS df, true AS p_in_range FROM e")
def chi_square_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.chi_square(_observed(spark, sf_dir), "group", "cluster").select("df", F.col("p").between(0, 1).alias("p_in_range"))


_RANKS = """WITH v AS (SELECT 'value' AS feature, event_type AS g, round(value, 1) AS value FROM events WHERE value IS NOT NULL),
r AS (SELECT g, value, rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2.0 AS rank FROM v),
s AS (SELECT g, count(*) AS n, CAST(sum(rank) AS DOUBLE) AS rank_sum FROM r GROUP BY g),
t AS (SELECT CAST(sum(k) AS DOUBLE) AS total, sum(CAST(k AS DOUBLE) * k * k - k) AS tied FROM (SELECT count(*) AS k FROM v GROUP BY value))
"""


def _event_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").filter("value is not null").select(F.lit("value").alias("feature"), F.col("event_type").alias("group"), F.round("value", 1).alias("value"))


@query(_RANKS + "SELECT 'value' AS feature, round((12 / (total * (total + 1)) * sum(rank_sum * rank_sum / n) - 3 * (total + 1)) / (1 - tied / (total * total * total - total)), 4) AS h, CAST(count(*) - 1 AS INTEGER) AS df FROM s, t GROUP BY total, tied")
def kruskal_wallis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.kruskal_wallis(_event_values(spark, sf_dir)).drop("p"), "h")


@query(_RANKS + """SELECT 'value' AS feature, a.g AS g1, b.g AS g2, round((a.rank_sum / a.n - b.rank_sum / b.n) / sqrt((total * (total + 1) / 12 - tied / (12 * (total - 1))) * (1.0 / a.n + 1.0 / b.n)), 4) + 0.0 AS z
FROM s a JOIN s b ON a.g < b.g, t""")
def dunn_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.dunn(_event_values(spark, sf_dir)).select("feature", "g1", "g2", (F.round("z", 4) + 0.0).alias("z"))


#: The upper tail of chi square, for even degrees of freedom, as a finite sum; that of |z| by a series of positive terms.
_TAIL = "exp(-x / 2) * list_sum(list_transform(range(0, CAST(df / 2 AS BIGINT)), lambda i: power(x / 2, i) / gamma(i + 1)))"
_TWO_SIDED = "1 - 2 / sqrt(pi()) * exp(-x * x) * list_sum(list_transform(range(0, 120), lambda i: exp(2 * i * ln(2) + lgamma(i + 1) - lgamma(2 * i + 2)) * power(x, 2 * i + 1)))"


@query(f"""WITH {CELLS_SQL.strip()}{_EXPECTED}, s AS (SELECT sum((n - expected) * (n - expected) / expected) AS x, CAST((count(DISTINCT g) - 1) * (count(DISTINCT k) - 1) AS INTEGER) AS df FROM e)
SELECT df, round({_TAIL}, 6) AS p FROM s""")
def chi_square_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.chi_square(_observed(spark, sf_dir), "group", "cluster").select("df", "p"), "p", places=6)


@query(_RANKS + f""", h AS (SELECT (12 / (total * (total + 1)) * sum(rank_sum * rank_sum / n) - 3 * (total + 1)) / (1 - tied / (total * total * total - total)) AS x, CAST(count(*) - 1 AS INTEGER) AS df FROM s, t GROUP BY total, tied)
SELECT 'value' AS feature, df, round({_TAIL}, 6) AS p FROM h""")
def kruskal_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.kruskal_wallis(_event_values(spark, sf_dir)).drop("h"), "p", places=6)


@query(_RANKS + f""", z AS (SELECT a.g AS g1, b.g AS g2, abs(a.rank_sum / a.n - b.rank_sum / b.n) / sqrt((total * (total + 1) / 12 - tied / (12 * (total - 1))) * (1.0 / a.n + 1.0 / b.n)) / sqrt(2) AS x FROM s a JOIN s b ON a.g < b.g, t),
q AS (SELECT g1, g2, least(1.0, ({_TWO_SIDED}) * count(*) OVER ()) AS p FROM z)
SELECT 'value' AS feature, g1, g2, round(p, 6) AS p, p < 0.05 AS significant FROM q""")
def dunn_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corrected p of each pair of groups, and whether the pair is drawn as different."""
    pairs = stats.dunn(_event_values(spark, sf_dir))
    return pairs.select("feature", "g1", "g2", F.round("p", 6).alias("p"), (F.col("p") < 0.05).alias("significant"))


_QUARTILES = """WITH v AS (SELECT event_type AS g, value FROM events WHERE value IS NOT NULL),
q AS (SELECT g, count(*) AS n, min(value) AS least, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3, max(value) AS most, avg(value) AS mean, stddev_samp(value) AS deviation FROM v GROUP BY g)
"""


def _raw_event_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").filter("value is not null").select(F.lit("value").alias("feature"), F.col("event_type").alias("group"), "value")


@query(_QUARTILES + """SELECT 'value' AS feature, g AS "group", n, least, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, most, round(mean, 6) AS mean, round(deviation, 6) AS deviation FROM q""")
def violin_quartiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.quartiles(_raw_event_values(spark, sf_dir)), "q1", "median", "q3", "mean", "deviation", places=6)


@query(_QUARTILES + """, b AS (SELECT g, n, least AS start, (most - least) / 511 AS step, 0.9 * CASE WHEN least(deviation, (q3 - q1) / 1.34) > 0 THEN least(deviation, (q3 - q1) / 1.34) ELSE greatest(deviation, (q3 - q1) / 1.34) END * power(CAST(n AS DOUBLE), -0.2) AS width FROM q),
c AS (SELECT v.g, (value - start) / step AS pos, CAST(least(floor((value - start) / step), 510) AS INTEGER) AS low FROM v JOIN b ON v.g = b.g),
w AS (SELECT g, place, sum(w) AS w FROM (SELECT g, low AS place, 1 - (pos - low) AS w FROM c UNION ALL SELECT g, low + 1, pos - low FROM c) GROUP BY g, place),
p AS (SELECT g, CAST(unnest(range(0, 512)) AS INTEGER) AS place FROM b)
SELECT 'value' AS feature, p.g AS "group", p.place AS place, round(start + p.place * step, 6) AS x, round(sum(w * exp(-0.5 * power((p.place - w.place) * step / width, 2))) / (n * width * sqrt(2 * pi())), 8) AS density
FROM p JOIN b ON p.g = b.g JOIN w ON w.g = p.g GROUP BY p.g, p.place, start, step, n, width""")
def violin_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = stats.densities(_raw_event_values(spark, sf_dir))
    return found.select("feature", "group", "place", F.round("x", 6).alias("x"), F.round("density", 8).alias("density"))


_MEANS = f', m AS (SELECT "group" AS g, {", ".join(f"avg({f}) AS {f}" for f in FEATURES)} FROM cells GROUP BY g)\n'


@query(f"WITH {CELLS_SQL.strip()}{_MEANS}SELECT x.g AS a, y.g AS b, round(sqrt({' + '.join(f'(x.{f} - y.{f}) * (x.{f} - y.{f})' for f in FEATURES)}), 3) AS distance FROM m x JOIN m y ON x.g < y.g")
def group_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = stats.group_means(cells(spark, sf_dir), "group", FEATURES)
    return rounded(stats.group_distances(means, "group", FEATURES), "distance", places=3)


@query(None)
def group_dendrogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = stats.group_means(stats.z_scores(cells(spark, sf_dir), FEATURES), "group", FEATURES)
    return stats.complete_linkage(stats.group_distances(means, "group", FEATURES))


def _predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select(F.col("quality").alias("label"), (1 - F.col("toxic")).alias("predicted"))


@query("SELECT quality AS label, 1 - toxic AS predicted, count(*) AS n FROM labels GROUP BY ALL")
def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.confusion(_predictions(spark, sf_dir))


@query("""WITH p AS (SELECT quality AS y, 1 - toxic AS p FROM labels), k AS (SELECT DISTINCT y AS c FROM p UNION SELECT DISTINCT p FROM p),
s AS (SELECT c, count(*) FILTER (WHERE y = c AND p = c) AS hit, count(*) FILTER (WHERE y = c) AS support, count(*) FILTER (WHERE p = c) AS said FROM k, p GROUP BY c),
f AS (SELECT c, coalesce(hit / nullif(said, 0), 0) AS pr, coalesce(hit / nullif(support, 0), 0) AS re, hit, support FROM s),
g AS (SELECT *, coalesce(2 * pr * re / nullif(pr + re, 0), 0) AS f1 FROM f)
SELECT CAST(c AS VARCHAR) AS name, round(pr, 6) AS "precision", round(re, 6) AS recall, round(f1, 6) AS f1, support FROM g
UNION ALL SELECT 'accuracy', round(sum(hit) / sum(support), 6), round(sum(hit) / sum(support), 6), round(sum(hit) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM g
UNION ALL SELECT 'macro avg', round(avg(pr), 6), round(avg(re), 6), round(avg(f1), 6), CAST(sum(support) AS BIGINT) FROM g
UNION ALL SELECT 'weighted avg', round(sum(pr * support) / sum(support), 6), round(sum(re * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM g""")
def class_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.class_report(_predictions(spark, sf_dir)), "precision", "recall", "f1", places=6)


# Splits, neighbours


@query(_cells_sql("SELECT test, count(*) AS n, CAST(sum(cell) AS BIGINT) AS cells FROM (SELECT cell, row_number() OVER (ORDER BY (cell * 2654435761) % 4294967296, cell) <= ceil(0.3 * count(*) OVER ()) AS test FROM cells) GROUP BY test"))
def train_test_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = (F.col("cell") * 2654435761) % 4294967296
    split = selection.exact_split(cells(spark, sf_dir).select("cell"), 0.3, "cell", order=order)
    return split.groupBy("test").agg(F.count("*").alias("n"), F.sum("cell").alias("cells"))


#: Distances over whole-number coordinates, which any engine computes alike.
_POINTS = "pts AS (SELECT vec_id AS id, [CAST(round(CAST(x AS DOUBLE) * 1000) AS BIGINT) FOR x IN embedding] AS v FROM embeddings)"
_KNN_SQL = f"""WITH {_POINTS},
d AS (SELECT a.id AS src, b.id AS dst, sqrt(list_sum([(a.v[i] - b.v[i]) * (a.v[i] - b.v[i]) FOR i IN range(1, len(a.v) + 1)])) AS d FROM pts a JOIN pts b ON a.id <> b.id),
nn AS (SELECT src, dst, d, row_number() OVER (PARTITION BY src ORDER BY d, dst) AS rank FROM d QUALIFY rank <= 10),
core AS (SELECT src AS id, d AS core FROM nn WHERE rank = 4)
"""


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    vec = F.transform("embedding", lambda x: F.round(x.cast("double") * 1000))
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), vec.alias("vec"))


@query(_KNN_SQL + "SELECT src, dst, round(d, 4) AS d, CAST(rank AS INTEGER) AS rank FROM nn")
def knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(neighbors.knn(points(spark, sf_dir), 10), "d").select("src", "dst", "d", "rank")


@query(None)
def knn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near neighbours by descent; a test holds them against the exact ones."""
    return rounded(descent.approximate_knn(points(spark, sf_dir), 10), "d")


@query(None)
def local_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = points(spark, sf_dir)
    return neighbors.local_dimension(vectors, materialise(neighbors.knn(vectors, 15), "neighbours"))


@query(_KNN_SQL + "SELECT id, round(core, 4) AS core FROM core")
def core_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(neighbors.core_distances(neighbors.knn(points(spark, sf_dir), 10), 5), "core")


@query(_KNN_SQL + "SELECT src, dst, round(greatest(d, a.core, b.core), 4) AS w FROM nn JOIN core a ON src = a.id JOIN core b ON dst = b.id")
def mutual_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = materialise(neighbors.knn(points(spark, sf_dir), 10), "neighbours")  # read three times
    return rounded(neighbors.mutual_reachability(near, neighbors.core_distances(near, 5)), "w")


@query(None)
def mst_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = materialise(neighbors.knn(points(spark, sf_dir), 10), "neighbours")
    forest = neighbors.minimum_spanning_forest(neighbors.mutual_reachability(near, neighbors.core_distances(near, 5)))
    return forest.agg(F.count("*").alias("edges"), F.round(F.sum("w"), 2).alias("weight"))


@query(None)
def fuzzy_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(neighbors.fuzzy_union(neighbors.memberships(neighbors.knn(points(spark, sf_dir), 10), 10)), "w")


@query("SELECT label, round(avg(CAST(embedding[1] AS DOUBLE)), 6) AS x, round(avg(CAST(embedding[2] AS DOUBLE)), 6) AS y FROM embeddings WHERE label <> 0 GROUP BY label")
def centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = table(spark, sf_dir, "embeddings").select("label", F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    return rounded(neighbors.centroids(flat, "label", ("x", "y"), noise=0), "x", "y", places=6)


@query(_KNN_SQL + """, even AS (SELECT src, dst FROM nn WHERE rank <= 5), both_ AS (SELECT src, dst, max(x) AS x, max(y) AS y FROM (SELECT src, dst, 1 AS x, 0 AS y FROM nn UNION ALL SELECT src, dst, 0, 1 FROM even) GROUP BY src, dst)
SELECT src AS id, round(sum(x * y) / count(*), 6) AS jaccard FROM both_ GROUP BY src""")
def neighborhood_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = materialise(neighbors.knn(points(spark, sf_dir), 10), "neighbours")  # read twice
    return rounded(neighbors.neighbourhood_jaccard(near, near.filter("rank <= 5")), "jaccard", places=6)


def _frame(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str]]:
    """All embeddings, one column an element."""
    vectors = table(spark, sf_dir, "embeddings")
    names = [f"e{i}" for i in range(vectors.select(F.max(F.size("embedding"))).first()[0])]
    return vectors.select("vec_id", F.col("label").cast("double").alias("label"), *[F.col("embedding")[i].cast("double").alias(n) for i, n in enumerate(names)]), names


@query(None)
def rfe_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame, names = _frame(spark, sf_dir)
    return selection.eliminate(frame, names, "label", len(names) // 2, trees=10, depth=4)


@query(None)
def svm_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame, names = _frame(spark, sf_dir)
    models = selection.one_against_one(frame, names, "label", 10)
    return stats.confusion(selection.vote(frame, names, models))


@query(None)
def forest_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class report of a forest on an exact hold-out of 0.3."""
    frame, names = _frame(spark, sf_dir)
    split = materialise(selection.exact_split(frame, 0.3, "vec_id"), "split")
    predicted = selection.forest_predictions(split.filter("not test"), split.filter("test"), names, "label", trees=20, depth=5)
    return rounded(stats.class_report(predicted.withColumn("label", F.col("label").cast("string"))), "precision", "recall", "f1")


# Small operators that the queries above don't reach


@query(_components_sql(NEAR8, """
SELECT img, label AS cell, round(4 * pi() * area / ((2 * height + 2 * width) * (2 * height + 2 * width)), 6) AS circularity, round(area / (2 * height + 2 * width), 6) AS compactness FROM stats"""))
def shape_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Circularity and compactness, with the box's outline for a perimeter."""
    found = raster.component_stats(_labelled(spark, sf_dir, 8))
    outline = 2 * F.col("height") + 2 * F.col("width")
    ratios = [F.round(f(F.col("area"), outline), 6).alias(f.__name__) for f in (shape.circularity, shape.compactness)]
    return found.select("img", F.col("label").alias("cell"), *ratios)


@query(_cells_sql("SELECT cell, quantity AS \"cell quantity\", total AS \"cell total\" FROM cells"))
def spaced_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = cells(spark, sf_dir).select("cell", F.col("quantity").alias("cell_quantity"), F.col("total").alias("cell_total"))
    return facts.spaced_names(facts.require_columns(named, ["cell", "cell_quantity"]))


@query(_cells_sql("SELECT cell, discount, tax, balance FROM cells"))
def column_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature columns by position, without those of a name part and a prefix."""
    whole = cells(spark, sf_dir).select("cell", "group", "quantity", "price", "discount", "tax", "balance", "total")
    return whole.select("cell", *facts.feature_columns(whole, 4, ("total",), ("UMAP_",)))


@query(_cells_sql("SELECT c.cell, c.cluster, CAST(x.cluster AS VARCHAR) AS label FROM cells c LEFT JOIN (SELECT cell, cluster FROM cells WHERE cluster > 2) x USING (cell)"))
def attach_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results go back to their cells by key, not by position."""
    whole = cells(spark, sf_dir).select("cell", "cluster")
    return facts.by_name(whole, whole.filter("cluster > 2").select("cell", F.col("cluster").cast("string").alias("label")), "cell")


@query(_cells_sql("SELECT \"group\", round(greatest(least(avg(balance) / 5000, 1), -1), 6) AS clamped FROM cells GROUP BY \"group\""))
def clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = cells(spark, sf_dir).groupBy("group").agg((F.avg("balance") / 5000).alias("x"))
    return means.select("group", F.round(stats.clamped(F.col("x")), 6).alias("clamped"))


@query("SELECT s_suppkey, 'a' AS first, CAST(s_nationkey AS VARCHAR) AS second, 3 AS n FROM supplier")
def comma_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = F.concat(F.lit("a , "), F.col("s_nationkey").cast("string"), F.lit(",c"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", text.listed(given).alias("v")).select("s_suppkey", F.col("v")[0].alias("first"), F.col("v")[1].alias("second"), F.size("v").alias("n"))


@query(_px_sql(""", pair AS (SELECT img, r, c, CAST(floor(greatest(v, 0) * 255) AS INTEGER) AS a, CAST(floor(abs(v) * 100) AS INTEGER) AS b FROM px)
SELECT img, count(*) AS pixels, CAST(sum(CAST(round_even(0.3 * a + 0.7 * b, 0) AS INTEGER)) AS BIGINT) AS blended, CAST(sum(CASE WHEN a = 0 AND b = 0 THEN 0 ELSE 255 END) AS BIGINT) AS alpha FROM pair GROUP BY img"""))
def blend_alpha(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted means of two channels, and transparency where both are black."""
    pair = px(spark, sf_dir).select("img", F.floor(F.greatest("v", F.lit(0.0)) * 255).cast("int").alias("old"), F.floor(F.abs("v") * 100).cast("int").alias("new"))
    mixed = raster.blend(pair, "old", "new", 0.3).withColumns({"b": F.col("old"), "g": F.col("new"), "r": F.col("new")})
    return raster.alpha_of(mixed).groupBy("img").agg(F.count("*").alias("pixels"), F.sum("blended").alias("blended"), F.sum("alpha").alias("alpha"))


@query(_px_sql(" SELECT img, CAST(r + 3 AS BIGINT) AS r, CAST(c + 2 AS BIGINT) AS c FROM sparse"))
def pad_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = raster.pad(foreground(spark, sf_dir, SPARSE), 3, 2)
    return moved.select("img", F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"))


@query(_px_sql(""", p AS (SELECT img, CAST(floor(abs(v) * 255) AS INTEGER) AS a, CAST(c * 4 AS INTEGER) AS b, CAST(r % 256 AS INTEGER) AS d FROM px)
SELECT img, mask, count(*) AS pixels FROM (SELECT img, 'low' AS mask FROM p WHERE a BETWEEN 0 AND 60 AND b BETWEEN 0 AND 120 AND d BETWEEN 0 AND 255
UNION ALL SELECT img, 'mid' FROM p WHERE a BETWEEN 40 AND 130 AND b BETWEEN 100 AND 255 AND d BETWEEN 5 AND 200) GROUP BY img, mask"""))
def colour_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    pixels = px(spark, sf_dir).select("img", "r", "c", F.floor(F.abs("v") * 255).cast("int").alias("blue"), (F.col("c") * 4).cast("int").alias("green"), (F.col("r") % 256).cast("int").alias("red"))
    found = raster.colour_masks(pixels, {"low": ((0, 60), (0, 120), (0, 255)), "mid": ((40, 130), (100, 255), (5, 200))})
    return found.groupBy("img", "mask").agg(F.count("*").alias("pixels"))


@query(_cells_sql("""SELECT cluster, CASE WHEN cluster = -1 THEN '0,0,0' ELSE concat_ws(',', CAST(floor(255 * least(greatest(abs(2 * cluster / k - 0.5), 0), 1)) AS INTEGER), CAST(floor(255 * sin(pi() * cluster / k) + 1e-9) AS INTEGER), CAST(floor(255 * cos(pi() / 2 * cluster / k) + 1e-9) AS INTEGER)) END AS colour
FROM (SELECT DISTINCT cluster, (SELECT count(DISTINCT cluster) FROM cells) AS k FROM cells)"""))
def rainbow_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A colour for each cluster, by its number's place among the clusters; noise is black."""
    clusters = cells(spark, sf_dir).select("cluster").distinct()
    k = clusters.count()
    each = [F.floor(255 * x + 1e-9).cast("int") for x in raster.rainbow(F.col("cluster") / k)]
    return clusters.select("cluster", F.when(F.col("cluster") == -1, F.lit("0,0,0")).otherwise(text.colour_text(*each)).alias("colour"))


@query(_cells_sql("SELECT cell, 'R' || subject || '_' || \"group\" || '_' || treatment || '_' || tissue || '_' || region || '.tif' AS name FROM cells"))
def name_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells(spark, sf_dir).select("cell", text.image_name(F.concat(F.lit("R"), "subject"), *map(F.col, ("group", "treatment", "tissue", "region"))).alias("name"))


@query(_cells_sql("SELECT cell, row_number() OVER (ORDER BY cell) AS place FROM cells"))
def sorted_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All cells in order of number."""
    return facts.numbered(cells(spark, sf_dir).select("cell"), "cell")


@query(_px_sql(""", other AS (SELECT img, max(r) + 1 AS h, max(c) + 1 AS w FROM px WHERE img % 2 = 0 OR r < 3 GROUP BY img)
SELECT size.img, CAST(size.h AS BIGINT) AS h, CAST(size.w AS BIGINT) AS w FROM size JOIN other USING (img, h, w)"""))
def same_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    pixels = px(spark, sf_dir)
    whole, other = raster.extent(pixels), raster.extent(pixels.filter("img % 2 = 0 or r < 3"))
    return facts.same_size(whole, other).select("img", F.col("h").cast("long").alias("h"), F.col("w").cast("long").alias("w"))


@query(_cells_sql("""SELECT f.feature, max(CASE WHEN g = 'BUILDING' THEN x END) AS "BUILDING", max(CASE WHEN g = 'MACHINERY' THEN x END) AS "MACHINERY" FROM (
SELECT "group" AS g, 'price' AS feature, round(avg(price), 4) AS x FROM cells GROUP BY g UNION ALL SELECT "group", 'total', round(avg(total), 4) FROM cells GROUP BY "group") f GROUP BY f.feature"""))
def transposed_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = rounded(stats.group_means(cells(spark, sf_dir), "group", ("price", "total")), "price", "total")
    return facts.transposed(means, "group", ["BUILDING", "MACHINERY"])
