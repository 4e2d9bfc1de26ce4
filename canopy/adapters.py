"""Domain tables derived from the shared test tables (used by the checks only)."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from canopy.operators.ordered import row_numbers

WAVELENGTHS = [397.66 + 9.6 * i for i in range(64)]
OBSERVED = ["b03", "b04", "b08", "b11", "b12", "scl"]
CLASS_NAMES = {0: "view", 1: "click", 2: "purchase", 3: "signup", 4: "error"}


class Tables:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")

    @cached_property
    def pixels(self) -> DataFrame:
        b04 = F.col("l_quantity") * 100
        b08 = F.col("l_extendedprice") / 10
        part = F.col("l_partkey")
        return self.raw("lineitem").select(
            F.concat(F.lit("T"), F.lpad((F.col("l_suppkey") % 13).cast("string"), 5, "0")).alias("tile"),
            F.to_date("l_shipdate").alias("acq_date"),
            F.expr("CAST(l_partkey DIV 50 AS INT)").alias("row"),
            (part % 50).cast("int").alias("col"),
            (b04 * 0.6).alias("b02"), (b04 * 0.8).alias("b03"), b04.alias("b04"),
            (b04 * 1.1).alias("b05"), (b08 * 0.7).alias("b06"), (b08 * 0.85).alias("b07"),
            b08.alias("b08"), (b08 * 1.02).alias("b8a"),
            (1000 + F.col("l_tax") * 10000).alias("b11"), (500 + F.col("l_discount") * 10000).alias("b12"),
            ((F.col("l_orderkey") + F.col("l_linenumber")) % 12).cast("int").alias("scl"),
            (30.0 + F.col("l_linenumber")).alias("zenith"), (150.0 + F.col("l_linenumber")).alias("azimuth"),
            (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("scene_order"),
        )

    @cached_property
    def observations(self) -> DataFrame:
        from canopy.operators.raster import unstack_bands

        return unstack_bands(
            self.pixels, OBSERVED,
            keys=["tile", "acq_date", "row", "col", "scene_order"],
        )

    @cached_property
    def indices(self) -> DataFrame:
        """NDVI and NBR in long form, one value per pixel row."""
        from canopy.functions.vegetation import s2_nbr, s2_ndvi

        wide = self.pixels.select(
            "tile", "acq_date", F.year("acq_date").alias("year"), "row", "col", "scene_order",
            s2_ndvi("b04", "b08").alias("ndvi"), s2_nbr("b08", "b12").alias("nbr"),
        )
        return wide.unpivot(
            ["tile", "acq_date", "year", "row", "col", "scene_order"], ["ndvi", "nbr"], "index", "value"
        )

    @cached_property
    def landcover(self) -> DataFrame:
        return self.raw("part").select(
            F.lit(32634).alias("epsg"), F.expr("CAST(p_partkey DIV 50 AS INT)").alias("row"),
            (F.col("p_partkey") % 50).cast("int").alias("col"), F.col("p_size").alias("clc"),
        )

    @cached_property
    def scenes(self) -> DataFrame:
        cust = F.col("o_custkey")
        zone = (34 + cust % 2).cast("string")
        letters = F.concat(F.lit("U"), F.substring(F.lit("KLMNP"), (cust % 5 + 1).cast("int"), F.lit(1)), F.lit("A"))
        sid = F.concat_ws(
            "_", F.lit("S2A_MSIL2A"), F.date_format("o_orderdate", "yyyyMMdd"), F.lit("N0511_R036"),
            F.concat(F.lit("T"), zone, letters), (F.col("o_orderkey") % 3).cast("string"),
        )
        minx, miny = (20 + cust % 10).cast("double"), (53 + cust % 4).cast("double")
        keys = ["B04_10m", "B08_10m", "B12_20m", "SCL_20m"]
        base = self.raw("orders").withColumn("scene_id", sid)
        assets = F.map_from_arrays(
            F.array(*[F.lit(k) for k in keys]),
            F.array(*[
                F.struct(F.concat(F.lit("store://scenes/"), F.col("scene_id"), F.lit(f"/{k}.jp2")).alias("href"))
                for k in keys
            ]),
        )
        return base.select(
            "scene_id",
            F.when(F.col("o_orderkey") % 4 == 0, "sentinel-1-grd").otherwise("sentinel-2-l2a").alias("collection"),
            F.col("o_orderdate").alias("datetime"),
            (F.col("o_totalprice") % 100).alias("cloud_cover"),
            F.when(F.substring("o_orderpriority", 1, 1).isin("1", "2", "3"), "IW").otherwise("EW").alias("instrument_mode"),
            F.when(F.col("o_orderstatus") == "F", "ASCENDING").when(F.col("o_orderstatus") == "O", "descending")
            .otherwise("Ascending").alias("orbit_state"),
            F.struct(minx.alias("minx"), miny.alias("miny"), (minx + 1).alias("maxx"), (miny + 1).alias("maxy")).alias("bbox"),
            assets.alias("assets"),
            F.col("o_orderkey").alias("item_no"),
        )

    @cached_property
    def spectra(self) -> DataFrame:
        return self.raw("embeddings").select(
            F.concat(F.lit("c"), (F.col("vec_id") % 2).cast("string")).alias("cube_id"),
            F.expr("CAST(vec_id DIV 25 AS INT)").alias("row"), (F.col("vec_id") % 25).cast("int").alias("col"),
            F.transform("embedding", lambda e: (e.cast("double") + 1) / 2).alias("spectrum"),
        )

    @cached_property
    def class_map(self) -> DataFrame:
        return self.raw("embeddings").select(
            F.concat(F.lit("c"), (F.col("vec_id") % 2).cast("string")).alias("cube_id"),
            F.expr("CAST(vec_id DIV 25 AS INT)").alias("row"), (F.col("vec_id") % 25).cast("int").alias("col"),
            (F.col("label") % 7).alias("class"),
        )

    @cached_property
    def _numbered_events(self) -> DataFrame:
        day = F.datediff("ts", F.lit("2024-01-01").cast("date"))
        return row_numbers(self.raw("events"), ["user_id"], ["ts", "event_id"], "rn", day)

    @cached_property
    def telemetry(self) -> DataFrame:
        e = F.col("event_id")
        d = lambda c: c.cast("double")
        return self._numbered_events.select(
            F.col("user_id").cast("string").alias("video_id"), (F.col("rn") - 1).cast("int").alias("frame"),
            (F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '2024-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ))") / 1e6).alias("ts"),
            (54 + (e % 7) / 100000).alias("lat"), (24 + (e % 11) / 100000).alias("lon"),
            d(60 + e % 5).alias("alt"), d(60 + e % 5).alias("rel_alt"), d(160 + e % 5).alias("abs_alt"),
            F.lit(40.0).alias("focal_len"), F.lit(1.0).alias("dzoom_ratio"),
            d(e % 4).alias("gb_yaw"), d(-90 + e % 3).alias("gb_pitch"), F.lit(0.0).alias("gb_roll"),
            F.date_format("ts", "HH:mm:ss.SSS").alias("utc"),
        )

    @cached_property
    def detections(self) -> DataFrame:
        e = F.col("event_id")
        d = lambda c: c.cast("double")
        cls = F.when(F.col("event_type") == "view", 0)
        for i, n in list(CLASS_NAMES.items())[1:]:
            cls = cls.when(F.col("event_type") == n, i)
        return self._numbered_events.select(
            e.alias("det_id"), F.col("user_id").cast("string").alias("video_id"),
            F.expr("CAST((rn - 1) DIV 2 AS INT)").alias("frame"),
            d((e * 13) % 600).alias("x1"), d((e * 7) % 400).alias("y1"),
            d((e * 13) % 600 + 20 + e % 30).alias("x2"), d((e * 7) % 400 + 20 + e % 30).alias("y2"),
            (((e * 37) % 100) / 100).alias("conf"), cls.cast("int").alias("cls"), F.col("event_type").alias("name"),
            (F.regexp_extract("props", r"([0-9]+)", 1).cast("int") % 5).cast("int").alias("track_id"),
        )

    @cached_property
    def regions(self) -> DataFrame:
        n = F.col("n_nationkey")
        cx, cy = 2.0 * n + 0.3, 2.0 * n + 0.1
        h = 2.0 + n % 3
        pt = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
        square = F.array(pt(cx - h, cy - h), pt(cx + h, cy - h), pt(cx + h, cy + h), pt(cx - h, cy + h), pt(cx - h, cy - h))
        diamond = F.array(pt(cx, cy - h), pt(cx + h, cy), pt(cx, cy + h), pt(cx - h, cy), pt(cx, cy - h))
        return self.raw("nation").select(
            F.concat(F.lit("r"), n.cast("string")).alias("region_id"), F.lit(32634).alias("epsg"),
            F.lit(0).alias("part"), F.lit(0).alias("ring"),
            F.when(n % 2 == 0, square).otherwise(diamond).alias("xy"),
            F.map_from_arrays(
                F.array(F.lit("group"), F.lit("order")),
                F.array((n % 4).cast("string"), n.cast("string")),
            ).alias("props"),
        )


# The same views as CTEs for the SQL checks.
VIEW_SQL = {
    "pixels": """
        SELECT 'T' || lpad(CAST(l_suppkey % 13 AS VARCHAR), 5, '0') AS tile,
               CAST(l_shipdate AS DATE) AS acq_date, CAST(l_partkey // 50 AS INT) AS "row",
               CAST(l_partkey % 50 AS INT) AS col,
               l_quantity * 100 * 0.6::DOUBLE AS b02, l_quantity * 100 * 0.8::DOUBLE AS b03,
               l_quantity * 100 AS b04, l_quantity * 100 * 1.1::DOUBLE AS b05,
               l_extendedprice / 10 * 0.7::DOUBLE AS b06, l_extendedprice / 10 * 0.85::DOUBLE AS b07,
               l_extendedprice / 10 AS b08, l_extendedprice / 10 * 1.02::DOUBLE AS b8a,
               1000 + l_tax * 10000 AS b11, 500 + l_discount * 10000 AS b12,
               CAST((l_orderkey + l_linenumber) % 12 AS INT) AS scl,
               CAST(30 + l_linenumber AS DOUBLE) AS zenith, CAST(150 + l_linenumber AS DOUBLE) AS azimuth,
               l_orderkey * 8 + l_linenumber AS scene_order
        FROM lineitem""",
    "observations": """
        SELECT tile, acq_date, "row", col, scene_order, band, value FROM (
          SELECT tile, acq_date, "row", col, scene_order, b03, b04, b08, b11, b12, CAST(scl AS DOUBLE) AS scl
          FROM pixels) UNPIVOT (value FOR band IN (b03, b04, b08, b11, b12, scl))""",
    "indices": """
        SELECT tile, acq_date, CAST(year(acq_date) AS INT) AS "year", "row", col, scene_order, 'ndvi' AS "index",
               greatest(0, least(1, (b08 - b04) / nullif(b08 + b04, 0))) AS value FROM pixels
        UNION ALL
        SELECT tile, acq_date, CAST(year(acq_date) AS INT), "row", col, scene_order, 'nbr',
               greatest(0, least(1, (b08 - b12) / nullif(b08 + b12, 0))) FROM pixels""",
    "landcover": """
        SELECT CAST(p_partkey // 50 AS INT) AS "row", CAST(p_partkey % 50 AS INT) AS col, p_size AS clc FROM part""",
    "scenes": """
        SELECT 'S2A_MSIL2A_' || strftime(o_orderdate, '%Y%m%d') || '_N0511_R036_T' || CAST(34 + o_custkey % 2 AS VARCHAR)
                 || 'U' || substr('KLMNP', CAST(o_custkey % 5 + 1 AS INT), 1) || 'A_' || CAST(o_orderkey % 3 AS VARCHAR) AS scene_id,
               CASE WHEN o_orderkey % 4 = 0 THEN 'sentinel-1-grd' ELSE 'sentinel-2-l2a' END AS collection,
               o_orderdate AS datetime, o_totalprice % 100 AS cloud_cover,
               CASE WHEN substr(o_orderpriority, 1, 1) IN ('1','2','3') THEN 'IW' ELSE 'EW' END AS instrument_mode,
               CASE o_orderstatus WHEN 'F' THEN 'ASCENDING' WHEN 'O' THEN 'descending' ELSE 'Ascending' END AS orbit_state,
               CAST(20 + o_custkey % 10 AS DOUBLE) AS minx, CAST(53 + o_custkey % 4 AS DOUBLE) AS miny,
               CAST(21 + o_custkey % 10 AS DOUBLE) AS maxx, CAST(54 + o_custkey % 4 AS DOUBLE) AS maxy,
               'T' || CAST(34 + o_custkey % 2 AS VARCHAR) || 'U' || substr('KLMNP', CAST(o_custkey % 5 + 1 AS INT), 1) || 'A' AS tile0,
               o_orderkey AS item_no
        FROM orders""",
    "spectra": """
        SELECT 'c' || CAST(vec_id % 2 AS VARCHAR) AS cube_id, CAST(vec_id // 25 AS INT) AS "row",
               CAST(vec_id % 25 AS INT) AS col,
               list_transform(embedding, lambda e: (CAST(e AS DOUBLE) + 1) / 2) AS spectrum
        FROM embeddings""",
    "long_spectra": """
        SELECT cube_id, "row", col, unnest(range(len(spectrum))) AS band, unnest(spectrum) AS value FROM spectra""",
    "class_map": """
        SELECT 'c' || CAST(vec_id % 2 AS VARCHAR) AS cube_id, CAST(vec_id // 25 AS INT) AS "row",
               CAST(vec_id % 25 AS INT) AS col, label % 7 AS class
        FROM embeddings""",
    "wl": """
        SELECT CAST(i AS INT) AS band, 397.66::DOUBLE + 9.6::DOUBLE * i AS wavelength_nm FROM range(64) t(i)""",
    "ev": """
        SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events""",
    "telemetry": """
        SELECT CAST(user_id AS VARCHAR) AS video_id, CAST(rn - 1 AS INT) AS frame,
               CAST(epoch_us(ts) - 1704067200000000 AS DOUBLE) / 1e6::DOUBLE AS ts,
               54 + (event_id % 7)::DOUBLE / 100000 AS lat, 24 + (event_id % 11)::DOUBLE / 100000 AS lon,
               CAST(60 + event_id % 5 AS DOUBLE) AS alt, CAST(60 + event_id % 5 AS DOUBLE) AS rel_alt,
               CAST(160 + event_id % 5 AS DOUBLE) AS abs_alt, 40.0::DOUBLE AS focal_len, 1.0::DOUBLE AS dzoom_ratio,
               CAST(event_id % 4 AS DOUBLE) AS gb_yaw, CAST(-90 + event_id % 3 AS DOUBLE) AS gb_pitch,
               0.0::DOUBLE AS gb_roll, strftime(ts, '%H:%M:%S.%g') AS utc
        FROM ev""",
    "detections": """
        SELECT event_id AS det_id, CAST(user_id AS VARCHAR) AS video_id, CAST((rn - 1) // 2 AS INT) AS frame,
               CAST((event_id * 13) % 600 AS DOUBLE) AS x1, CAST((event_id * 7) % 400 AS DOUBLE) AS y1,
               CAST((event_id * 13) % 600 + 20 + event_id % 30 AS DOUBLE) AS x2,
               CAST((event_id * 7) % 400 + 20 + event_id % 30 AS DOUBLE) AS y2,
               ((event_id * 37) % 100)::DOUBLE / 100 AS conf,
               CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3
                 WHEN 'error' THEN 4 END AS cls, event_type AS name,
               CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) % 5 AS track_id
        FROM ev""",
    "regions": """
        SELECT 'r' || CAST(n_nationkey AS VARCHAR) AS region_id, n_nationkey AS n,
               2.0::DOUBLE * n_nationkey + 0.3::DOUBLE AS cx, 2.0::DOUBLE * n_nationkey + 0.1::DOUBLE AS cy,
               2.0::DOUBLE + n_nationkey % 3 AS h
        FROM nation""",
    "edges": """
        SELECT region_id, n, unnest([0,1,2,3]) AS e,
               unnest(CASE WHEN n % 2 = 0 THEN [cx-h, cx+h, cx+h, cx-h] ELSE [cx, cx+h, cx, cx-h] END) AS ex1,
               unnest(CASE WHEN n % 2 = 0 THEN [cy-h, cy-h, cy+h, cy+h] ELSE [cy-h, cy, cy+h, cy] END) AS ey1,
               unnest(CASE WHEN n % 2 = 0 THEN [cx+h, cx+h, cx-h, cx-h] ELSE [cx+h, cx, cx-h, cx] END) AS ex2,
               unnest(CASE WHEN n % 2 = 0 THEN [cy-h, cy+h, cy+h, cy-h] ELSE [cy, cy+h, cy, cy-h] END) AS ey2
        FROM regions""",
    "cells": """
        SELECT CAST(r AS INT) AS "row", CAST(c AS INT) AS col
        FROM range(-10, 80) a(r), range(-10, 80) b(c)""",
    "region_cells": """
        SELECT n, region_id, "row", col FROM edges, cells
        WHERE (ey1 <= "row" + 0.5 AND "row" + 0.5 < ey2) OR (ey2 <= "row" + 0.5 AND "row" + 0.5 < ey1)
        GROUP BY n, region_id, "row", col
        HAVING sum(CASE WHEN col + 0.5 < ex1 + ("row" + 0.5 - ey1) * (ex2 - ex1) / (ey2 - ey1) THEN 1 ELSE 0 END) % 2 = 1""",
}
