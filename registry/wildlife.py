"""Detections, telemetry, tracking."""

from pyspark.sql import functions as F

from canopy.adapters import CLASS_NAMES
from canopy.functions import detection as D
from canopy.operators import fragments as Fr, paths as P, telemetry as Te, tracking as Tr
from canopy.session import shared
from registry.core import query

W, H = 640, 512


@query("iou", "det_id:i other_id:i iou:d",
       """SELECT det_id, other_id, CASE WHEN iw <= 0 OR ih <= 0 THEN 0 ELSE iw * ih / ((x2 - x1) * (y2 - y1) + (b2 - b1) * (d2 - d1) - iw * ih) END AS iou
          FROM (SELECT *, least(x2, b2) - greatest(x1, b1) AS iw, least(y2, d2) - greatest(y1, d1) AS ih FROM (
            SELECT a.det_id, b.det_id AS other_id, a.x1, a.x2, a.y1, a.y2, b.x1 + 0.5 * (a.x1 - b.x1) AS b1, b.x2 + 0.5 * (a.x1 - b.x1) AS b2,
                   b.y1 + 0.5 * (a.y1 - b.y1) AS d1, b.y2 + 0.5 * (a.y1 - b.y1) AS d2
            FROM detections a JOIN detections b ON a.video_id = b.video_id AND a.frame = b.frame AND a.det_id < b.det_id))""")
def _(t):
    a = t.detections.select("video_id", "frame", "det_id", "x1", "y1", "x2", "y2")
    b = a.select("video_id", "frame", *[F.col(c).alias(f"o_{c}") for c in ("det_id", "x1", "y1", "x2", "y2")])
    pairs = a.join(b, ["video_id", "frame"]).filter("det_id < o_det_id")  # two boxes per frame
    sx, sy = 0.5 * (F.col("x1") - F.col("o_x1")), 0.5 * (F.col("y1") - F.col("o_y1"))
    other = [F.col("o_x1") + sx, F.col("o_y1") + sy, F.col("o_x2") + sx, F.col("o_y2") + sy]
    return pairs.select("det_id", F.col("o_det_id").alias("other_id"), D.iou(["x1", "y1", "x2", "y2"], other).alias("iou"))


@query("camera_fov", "video_id:s frame:i hfov:d vfov:d fx:d fy:d",
       """SELECT video_id, frame, degrees(2 * atan(18 / f)) AS hfov, degrees(2 * atan(12 / f)) AS vfov, 320 * f / 18 AS fx, 256 * f / 12 AS fy
          FROM (SELECT video_id, frame, (20 + frame % 30) * (1 + (frame % 3) * 0.5::DOUBLE) AS f FROM telemetry)""")
def _(t):
    f = F.col("frame")
    cam = D.camera_fov((20 + f % 30).cast("double"), 1 + (f % 3) * 0.5, W, H)
    return t.telemetry.select("video_id", "frame", cam.alias("c")).select("video_id", "frame", "c.*")


def _crowded(t, per_frame=6):
    """Detections shrunk towards the image centre so that boxes of a frame meet."""
    s = lambda c, m: (m + (F.col(c) - m) * 0.15)
    shrunk = t.detections.withColumn("frame", F.floor(F.col("frame") * 2 / per_frame).cast("int"))
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    return (
        shrunk.withColumn("__w", w).withColumn("__h", h).withColumn("x1", F.floor(s("x1", 300.0))).withColumn("y1", F.floor(s("y1", 200.0)))
        .withColumn("x2", F.col("x1") + F.col("__w")).withColumn("y2", F.col("y1") + F.col("__h")).drop("__w", "__h")
    )


CROWDED = """SELECT det_id, video_id, CAST(floor(frame * 2 / 6) AS INT) AS frame, conf, cls, name, track_id,
               floor(300 + (x1 - 300) * 0.15::DOUBLE) AS x1, floor(200 + (y1 - 200) * 0.15::DOUBLE) AS y1,
               floor(300 + (x1 - 300) * 0.15::DOUBLE) + (x2 - x1) AS x2, floor(200 + (y1 - 200) * 0.15::DOUBLE) + (y2 - y1) AS y2
             FROM detections"""

SUPPRESS = f"""
    WITH RECURSIVE c AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY video_id, frame ORDER BY conf DESC, x1, y1, det_id) AS k
                     FROM ({CROWDED})),
    f AS (SELECT video_id, frame, 1::BIGINT AS k, [{{'i': det_id, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2, 'c': cls}}] AS kept FROM c WHERE k = 1
          UNION ALL
          SELECT c.video_id, c.frame, c.k, CASE WHEN len(list_filter(f.kept, lambda b:
              CASE WHEN least(c.x2, b.x2) <= greatest(c.x1, b.x1) OR least(c.y2, b.y2) <= greatest(c.y1, b.y1) THEN FALSE ELSE
                (least(c.x2, b.x2) - greatest(c.x1, b.x1)) * (least(c.y2, b.y2) - greatest(c.y1, b.y1))
                / ((c.x2 - c.x1) * (c.y2 - c.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) - (least(c.x2, b.x2) - greatest(c.x1, b.x1)) * (least(c.y2, b.y2) - greatest(c.y1, b.y1)))
                >= CASE WHEN c.cls = b.c AND sqrt(pow((c.x1 + c.x2 - b.x1 - b.x2) / 2, 2) + pow((c.y1 + c.y2 - b.y1 - b.y2) / 2, 2)) <= 28
                     THEN 0.35 ELSE 0.65 END END)) > 0
            THEN f.kept ELSE list_append(f.kept, {{'i': c.det_id, 'x1': c.x1, 'y1': c.y1, 'x2': c.x2, 'y2': c.y2, 'c': c.cls}}) END
          FROM f JOIN c ON c.video_id = f.video_id AND c.frame = f.frame AND c.k = f.k + 1)
    SELECT unnest(list_transform(kept, lambda b: b.i)) AS det_id FROM f
    QUALIFY row_number() OVER (PARTITION BY video_id, frame ORDER BY k DESC) = 1"""


@query("suppress_overlaps", "det_id:i", SUPPRESS)
def _(t):
    return Tr.suppress_overlaps(_crowded(t))


@query("suppress_overlaps_streamed", "det_id:i", SUPPRESS)
def _(t):
    """The same rule over crowded frames, dealt in another order beforehand."""
    return Tr.suppress_overlaps(_crowded(t).repartition(7, "det_id"))


def _half_known(det):
    """Every third confidence is missing, every seventh not a number."""
    i = F.col("det_id")
    return det.withColumn("conf", F.when(i % 3 == 0, None).when(i % 7 == 0, float("nan")).otherwise(F.col("conf")))


@query("suppress_overlaps_null_conf", "det_id:i",
       SUPPRESS.replace("ORDER BY conf DESC", "ORDER BY CASE WHEN det_id % 3 = 0 OR det_id % 7 = 0 THEN 0 ELSE conf END DESC"))
def _(t):
    return Tr.suppress_overlaps(_half_known(_crowded(t)))


GROUND = """SELECT det_id, video_id, frame, dlat, dlon, conf, cls, name, track_id, x1, y1, x2, y2,
       CASE WHEN abs(wz) >= 1e-6 AND -alt / wz > 0 THEN dlat + (-alt / wz) * wy / 6378137 * 180 / pi() END AS lat,
       CASE WHEN abs(wz) >= 1e-6 AND -alt / wz > 0 THEN dlon + (-alt / wz) * wx / (6378137 * cos(radians(dlat))) * 180 / pi() END AS lon
     FROM (SELECT *, cos(yaw) * px - sin(yaw) * ry AS wx, sin(yaw) * px + cos(yaw) * ry AS wy, pz AS wz
       FROM (SELECT *, cos(pit) * cx + sin(pit) * rz AS px, -sin(pit) * cx + cos(pit) * rz AS pz
         FROM (SELECT *, cos(rol) * cy - sin(rol) * cz AS ry, sin(rol) * cy + cos(rol) * cz AS rz
           FROM (SELECT *, ux / sqrt(ux * ux + uy * uy + 1) AS cx, uy / sqrt(ux * ux + uy * uy + 1) AS cy, 1 / sqrt(ux * ux + uy * uy + 1) AS cz
             FROM (SELECT d.*, t.lat AS dlat, t.lon AS dlon, t.rel_alt AS alt, radians(gb_yaw) AS yaw, radians(gb_pitch + 90) AS pit, radians(gb_roll + 180) AS rol,
                          ((x1 + x2) / 2 - 320) / (320 * 40 / 18.0::DOUBLE) AS ux, ((y1 + y2) / 2 - 256) / (320 * 40 / 18.0::DOUBLE * 0.8::DOUBLE) AS uy
                   FROM detections d JOIN telemetry t USING (video_id, frame))))))"""


def _located(t):
    geo = t.telemetry.drop("utc")
    return Te.locate_detections(Te.attach_telemetry(t.detections, geo), W, H)


@query("project_to_ground", "det_id:i lat:d lon:d lat_drone:d lon_drone:d grounded:b",
       f"SELECT det_id, lat, lon, dlat AS lat_drone, dlon AS lon_drone, lat IS NOT NULL AS grounded FROM ({GROUND})")
def _(t):
    return _located(t)


@query("project_to_ground_guarded", "det_id:i lat:d lon:d",
       """SELECT det_id, CASE WHEN dz < -1e-3 AND sqrt(e * e + n * n) <= greatest(15 * alt, 500) THEN dlat + n / 111320 END AS lat,
                 CASE WHEN dz < -1e-3 AND sqrt(e * e + n * n) <= greatest(15 * alt, 500) THEN dlon + e / (111320 * cos(radians(dlat))) END AS lon
          FROM (SELECT *, (cos(yaw) * px - sin(yaw) * ry) * alt / -dz AS e, (sin(yaw) * px + cos(yaw) * ry) * alt / -dz AS n
            FROM (SELECT *, cos(pit) * cx + sin(pit) * rz AS px, -sin(pit) * cx + cos(pit) * rz AS dz
              FROM (SELECT *, cos(rol) * cy - sin(rol) * cz AS ry, sin(rol) * cy + cos(rol) * cz AS rz
                FROM (SELECT *, ux / sqrt(ux * ux + uy * uy + 1) AS cx, uy / sqrt(ux * ux + uy * uy + 1) AS cy, -1 / sqrt(ux * ux + uy * uy + 1) AS cz
                  FROM (SELECT d.*, t.lat AS dlat, t.lon AS dlon, t.rel_alt AS alt, radians(gb_yaw) AS yaw, radians(gb_pitch - 0.5 + 90) AS pit, radians(5) AS rol,
                               ((x1 + x2) / 2 - 320) / (320 * 40 / 18.0::DOUBLE) AS ux, -((y1 + y2) / 2 - 256) / (256 * 40 / 12.0::DOUBLE) AS uy
                        FROM detections d JOIN telemetry t USING (video_id, frame))))))""")
def _(t):
    d = Te.attach_telemetry(t.detections, t.telemetry.drop("utc"))
    u, v = (F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2
    g = D.project_to_ground_guarded(
        u, v, W, H, "lat", "lon", "rel_alt", "gb_yaw", "gb_pitch", F.lit(5.0), "focal_len", "dzoom_ratio", pitch_bias=0.5
    )
    return d.select("det_id", g.alias("g")).select("det_id", "g.lat", "g.lon")


@query("geo_calibration", "video_id:s median_pitch:d median_rel_alt:d pitch_bias:d cluster_reassoc_m:d cluster_freeze_after:i max_ground_distance:d",
       """SELECT *, CASE WHEN off > 1 THEN greatest(-45, least(45, median_pitch + 90)) ELSE 0 END AS pitch_bias,
                 CASE WHEN off > 0.5 THEN greatest(3, least(8, median_rel_alt * tan(radians(off)) * 0.4)) ELSE 3 END AS cluster_reassoc_m,
                 12 AS cluster_freeze_after,
                 CASE WHEN off > 0.5 THEN greatest(500, median_rel_alt * tan(radians(off)) * 2) END AS max_ground_distance
          FROM (SELECT video_id, median(gb_pitch) AS median_pitch, median(rel_alt) AS median_rel_alt, abs(median(gb_pitch) + 90) AS off FROM
                (SELECT video_id, rel_alt, gb_pitch + frame % 4 * 0.7::DOUBLE AS gb_pitch FROM telemetry) GROUP BY video_id)""")
def _(t):
    tilted = t.telemetry.withColumn("gb_pitch", F.col("gb_pitch") + F.col("frame") % 4 * 0.7)
    return Te.geo_calibration(tilted, reassoc_m=3.0)


@query("locate_by_gsd", "det_id:i north:d east:d",
       """SELECT det_id, 600 + cos(-h) * dn - sin(-h) * de AS north, 500 + sin(-h) * dn + cos(-h) * de AS east FROM (
            SELECT det_id, radians(gb_yaw * 10) AS h, (floor((x1 + x2) / 2) - 320) * rel_alt * 10.88::DOUBLE / (13 * 640) AS de,
                   (256 - floor((y1 + y2) / 2)) * rel_alt * 8.704::DOUBLE / (13 * 512) AS dn FROM detections JOIN telemetry USING (video_id, frame))""")
def _(t):
    d = Te.attach_telemetry(t.detections, t.telemetry.drop("utc"))
    at = D.locate_by_gsd(
        "x1", "y1", "x2", "y2", F.lit(600.0), F.lit(500.0), "rel_alt", F.radians(F.col("gb_yaw") * 10), W, H
    )
    return d.select("det_id", at.alias("p")).select("det_id", "p.*")


COURSE = """SELECT video_id, frame, atan2(lead(lat) OVER w - lat, lead(lon) OVER w - lon) - pi() / 2 AS c FROM telemetry
            WINDOW w AS (PARTITION BY video_id ORDER BY frame)"""


@query("heading", "video_id:s frame:i heading:d",
       f"""SELECT video_id, frame, coalesce(c, (lag(c, 1) OVER w + lag(c, 2) OVER w) / 2) AS heading FROM ({COURSE})
           WINDOW w AS (PARTITION BY video_id ORDER BY frame)""")
def _(t):
    return Te.heading(t.telemetry.withColumn("gb_yaw", F.lit(None).cast("double")))


@query("heading_gimbal", "video_id:s frame:i heading:d",
       f"""SELECT video_id, frame, CASE WHEN frame % 2 = 0 THEN radians(gb_yaw) ELSE coalesce(c, (lag(c, 1) OVER w + lag(c, 2) OVER w) / 2) END AS heading
           FROM ({COURSE}) JOIN (SELECT video_id, frame, gb_yaw FROM telemetry) USING (video_id, frame) WINDOW w AS (PARTITION BY video_id ORDER BY frame)""")
def _(t):
    return Te.heading(t.telemetry.withColumn("gb_yaw", F.when(F.col("frame") % 2 == 0, F.col("gb_yaw"))))


TURNS = """
    WITH p AS (SELECT video_id, frame, lat, lon FROM telemetry),
    a AS (SELECT video_id, frame, 1 AS f, 2 AS r, lat AS v FROM p UNION ALL SELECT video_id, frame, 4, 8, lon FROM p),
    g AS (SELECT *, lag(v) OVER w IS DISTINCT FROM v AS s, lead(v) OVER w IS DISTINCT FROM v AS e FROM a WINDOW w AS (PARTITION BY video_id, f ORDER BY frame)),
    n AS (SELECT *, sum(CASE WHEN s THEN 1 ELSE 0 END) OVER (PARTITION BY video_id, f ORDER BY frame) AS run FROM g),
    u AS (SELECT video_id, f, run, v, lag(v) OVER x AS pv, lead(v) OVER x AS nv FROM n WHERE s WINDOW x AS (PARTITION BY video_id, f ORDER BY run)),
    c AS (SELECT n.video_id, n.frame, CASE WHEN pv < n.v AND nv < n.v THEN -1 WHEN pv > n.v AND nv > n.v THEN 1 ELSE 0 END * (CASE WHEN e THEN n.f ELSE 0 END + CASE WHEN s THEN r ELSE 0 END) AS code
          FROM n JOIN u ON n.video_id = u.video_id AND n.f = u.f AND n.run = u.run)
    SELECT video_id, frame, sum(code) AS turn FROM c GROUP BY video_id, frame"""


@query("turning_points", "video_id:s frame:i turn:i", TURNS)
def _(t):
    return Te.turning_points(t.telemetry.select("video_id", "frame", "lat", "lon"))


@query("interpolate_positions", "video_id:s frame:i lat:d lon:d",
       f"""WITH t AS ({TURNS}), q AS (SELECT video_id, frame, lat, lon, turn, row_number() OVER w AS i, count(*) OVER (PARTITION BY video_id) AS n
             FROM telemetry JOIN t USING (video_id, frame) WINDOW w AS (PARTITION BY video_id ORDER BY frame)),
           k AS (SELECT *, CASE WHEN turn <> 0 OR i = 1 OR i = n THEN i END AS a FROM q),
           m AS (SELECT *, max(a) OVER (PARTITION BY video_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS p,
                        min(a) OVER (PARTITION BY video_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS s FROM k)
           SELECT m.video_id, m.frame, CASE WHEN m.s > m.p THEN x.lat + (y.lat - x.lat) * (m.i - m.p) / (m.s - m.p) ELSE m.lat END AS lat,
                  CASE WHEN m.s > m.p THEN x.lon + (y.lon - x.lon) * (m.i - m.p) / (m.s - m.p) ELSE m.lon END AS lon
           FROM m JOIN q x ON x.video_id = m.video_id AND x.i = m.p JOIN q y ON y.video_id = m.video_id AND y.i = m.s""")
def _(t):
    return Te.interpolate_positions(t.telemetry.select("video_id", "frame", "lat", "lon"))


# --- identity ----------------------------------------------------------------

# One detection per step and video; the clusters so far travel as a list of structs.
def clusters_sql(idle: int = 120) -> str:
    return f"""
    WITH RECURSIVE d0 AS MATERIALIZED (SELECT det_id, video_id, frame, conf, track_id, lat, lon, row_number() OVER w AS k,
                     first_value(lat) OVER w AS olat, first_value(lon) OVER w AS olon FROM ({GROUND}) WHERE lat IS NOT NULL
                     WINDOW w AS (PARTITION BY video_id ORDER BY frame, conf DESC, x1, y1, det_id)),
    d AS MATERIALIZED (SELECT *, (lon - olon) * 111320 * cos(radians(olat)) AS x, (lat - olat) * 111320 AS y FROM d0),
    s AS (SELECT video_id, 0::BIGINT AS k, 0::BIGINT AS det_id, 0::BIGINT AS chosen, 0::BIGINT AS hits, 0.0::DOUBLE AS cx, 0.0::DOUBLE AS cy,
                 [{{'i': 0::BIGINT, 'n': 0::BIGINT, 'w': 0.0::DOUBLE, 'sx': 0.0::DOUBLE, 'sy': 0.0::DOUBLE, 'f': -1000000::BIGINT, 't': [-1::BIGINT]}}] AS state
          FROM (SELECT DISTINCT video_id FROM d)
          UNION ALL
          SELECT video_id, k, det_id, chosen, list_filter(nstate, lambda c: c.i = chosen)[1].n AS hits,
                 list_filter(nstate, lambda c: c.i = chosen)[1].sx / list_filter(nstate, lambda c: c.i = chosen)[1].w AS cx,
                 list_filter(nstate, lambda c: c.i = chosen)[1].sy / list_filter(nstate, lambda c: c.i = chosen)[1].w AS cy, nstate AS state
          FROM (SELECT *, CASE WHEN old IS NOT NULL THEN list_transform(state, lambda c: CASE WHEN c.i <> old THEN c ELSE
                    {{'i': c.i, 'n': c.n + 1, 'w': c.w + CASE WHEN move AND c.n < 30 THEN greatest(conf, 0.001) ELSE 0 END,
                      'sx': c.sx + CASE WHEN move AND c.n < 30 THEN x * greatest(conf, 0.001) ELSE 0 END,
                      'sy': c.sy + CASE WHEN move AND c.n < 30 THEN y * greatest(conf, 0.001) ELSE 0 END,
                      'f': frame::BIGINT, 't': CASE WHEN list_contains(c.t, track_id::BIGINT) THEN c.t ELSE list_append(c.t, track_id::BIGINT) END}} END)
                  ELSE list_append(state, {{'i': len(state)::BIGINT, 'n': 1::BIGINT, 'w': greatest(conf, 0.001)::DOUBLE, 'sx': (x * greatest(conf, 0.001))::DOUBLE,
                      'sy': (y * greatest(conf, 0.001))::DOUBLE, 'f': frame::BIGINT, 't': [track_id::BIGINT]}}) END AS nstate, coalesce(old, len(state)) AS chosen
            FROM (SELECT *, coalesce(own, near, frozen) AS old, own IS NOT NULL OR near IS NOT NULL AS move FROM (
              SELECT *, list_sort(list_transform(list_filter(live, lambda c: c.mine AND c.d <= 12), lambda c: {{'d': c.d, 'i': c.i}}))[1].i AS own,
                list_sort(list_transform(list_filter(live, lambda c: c.d <= 5 AND (c.mine OR c.d <= 2.25)), lambda c: {{'d': c.d, 'i': c.i}}))[1].i AS near,
                list_sort(list_transform(list_filter(live, lambda c: c.n >= 30 AND c.mine AND c.d <= 25), lambda c: {{'d': c.d, 'i': c.i}}))[1].i AS frozen
              FROM (SELECT d.*, s.state, list_transform(list_filter(s.state, lambda c: c.i > 0 AND d.frame - c.f <= {idle}), lambda c:
                      {{'i': c.i, 'n': c.n, 'mine': list_contains(c.t, d.track_id::BIGINT), 'd': sqrt(pow(d.x - c.sx / c.w, 2) + pow(d.y - c.sy / c.w, 2))}}) AS live
                    FROM s JOIN d ON d.video_id = s.video_id AND d.k = s.k + 1)))))
    SELECT s.det_id, chosen AS cluster_id, hits AS cluster_hits, hits >= 3 AS cluster_confirmed, olat + cy / 111320 AS cluster_lat,
           olon + cx / (111320 * cos(radians(olat))) AS cluster_lon FROM s JOIN d ON d.det_id = s.det_id WHERE s.k > 0"""


@query("spatial_clusters", "det_id:i cluster_id:n cluster_hits:n cluster_confirmed:b cluster_lat:d cluster_lon:d", clusters_sql())
def _(t):
    return Tr.spatial_clusters(_located(t))


# Every detection has a track here, and the gap exceeds every video, so a track keeps
# its entity for good and only a track's first detection looks for one.
ENTITIES = f"""
    WITH RECURSIVE d AS MATERIALIZED (SELECT det_id, video_id, frame, conf, track_id, lat, lon, dlat, dlon, row_number() OVER w AS k,
                     row_number() OVER (PARTITION BY video_id, frame ORDER BY conf DESC, x1, y1, det_id) AS place FROM ({GROUND})
                     WINDOW w AS (PARTITION BY video_id ORDER BY frame, conf DESC, x1, y1, det_id)),
    s AS (SELECT video_id, 0::BIGINT AS k, 0::BIGINT AS det_id, 0::BIGINT AS chosen, [0::BIGINT] AS used, [{{'t': -1::BIGINT, 'e': 0::BIGINT}}] AS owner,
                 [{{'e': 0::BIGINT, 'f': 0::BIGINT, 'lat': 0.0::DOUBLE, 'lon': 0.0::DOUBLE, 'dlat': 0.0::DOUBLE, 'dlon': 0.0::DOUBLE}}] AS state
          FROM (SELECT DISTINCT video_id FROM d)
          UNION ALL
          SELECT video_id, k, det_id, e AS chosen, list_append(CASE WHEN place = 1 THEN [0::BIGINT] ELSE used END, e) AS used,
                 CASE WHEN mine IS NULL THEN list_append(owner, {{'t': track_id::BIGINT, 'e': e}}) ELSE owner END AS owner,
                 list_append(list_filter(state, lambda c: c.e <> e), {{'e': e, 'f': frame::BIGINT, 'lat': lat, 'lon': lon, 'dlat': dlat, 'dlon': dlon}}) AS state
          FROM (SELECT *, coalesce(mine, list_sort(list_transform(list_filter(cand, lambda c: c.m <= c.reach), lambda c: {{'m': c.m, 'e': c.e}}))[1].e,
                                   len(state))::BIGINT AS e
            FROM (SELECT *, list_transform(list_filter(state, lambda c: c.e > 0 AND NOT list_contains(CASE WHEN place = 1 THEN [0::BIGINT] ELSE used END, c.e)), lambda c: {{
                    'e': c.e, 'reach': least(25, least(25, greatest(6, greatest(1, frame - c.f) / 30.0::DOUBLE * 8 + 6)) + 0.9::DOUBLE * 2 * 6371000 *
                       asin(sqrt(pow(sin(radians(c.dlat - dlat) / 2), 2) + cos(radians(dlat)) * cos(radians(c.dlat)) * pow(sin(radians(c.dlon - dlon) / 2), 2)))),
                    'm': least(2 * 6371000.0::DOUBLE * asin(sqrt(pow(sin(radians(c.lat - lat) / 2), 2) + cos(radians(lat)) * cos(radians(c.lat)) * pow(sin(radians(c.lon - lon) / 2), 2))),
                       1.15::DOUBLE * sqrt(pow((lon - dlon) * 111320 * cos(radians((lat + dlat) / 2)) - (c.lon - c.dlon) * 111320 * cos(radians((c.lat + c.dlat) / 2)), 2)
                         + pow((lat - dlat) * 111320 - (c.lat - c.dlat) * 111320, 2)))}}) AS cand
              FROM (SELECT d.*, s.state, s.used, s.owner, list_filter(s.owner, lambda o: o.t = d.track_id)[1].e AS mine
                    FROM s JOIN d ON d.video_id = s.video_id AND d.k = s.k + 1))))
    SELECT det_id, chosen AS entity_id FROM s WHERE k > 0"""


@query("resolve_entities", "det_id:i entity_id:i", ENTITIES)
def _(t):
    return Tr.resolve_entities(_located(t))


# Scores and order of first appearance per class travel as lists.
VOTES = """
    WITH RECURSIVE d AS MATERIALIZED (SELECT det_id, video_id, track_id, cls, conf,
                     row_number() OVER (PARTITION BY video_id, track_id ORDER BY frame, conf DESC, x1, y1, det_id) AS k FROM detections),
    s AS (SELECT video_id, track_id, 0::BIGINT AS k, 0::BIGINT AS det_id, -1 AS stable, [0.0::DOUBLE, 0.0, 0.0, 0.0, 0.0] AS score, [999999::BIGINT, 999999, 999999, 999999, 999999] AS seen
          FROM (SELECT DISTINCT video_id, track_id FROM d)
          UNION ALL
          SELECT video_id, track_id, k, det_id, CASE WHEN stable < 0 THEN lead WHEN lead <> stable AND score[lead + 1] >= score[stable + 1] + 0.5 THEN lead ELSE stable END AS stable, score, seen
          FROM (SELECT *, list_sort(list_transform([0, 1, 2, 3, 4], lambda c: {'a': -score[c + 1], 'b': seen[c + 1], 'c': c}))[1].c AS lead FROM (
            SELECT d.video_id, d.track_id, d.k, d.det_id, s.stable,
                   list_transform([0, 1, 2, 3, 4], lambda c: s.score[c + 1] + CASE WHEN c = d.cls THEN d.conf ELSE 0 END) AS score,
                   list_transform([0, 1, 2, 3, 4], lambda c: CASE WHEN c = d.cls THEN least(s.seen[c + 1], d.k) ELSE s.seen[c + 1] END) AS seen
            FROM s JOIN d ON d.video_id = s.video_id AND d.track_id = s.track_id AND d.k = s.k + 1)))
    SELECT s.det_id, stable AS cls, CASE WHEN stable <> d.cls THEN d.cls END AS cls_original FROM s JOIN d ON d.det_id = s.det_id WHERE s.k > 0"""


@query("smooth_class_track", "det_id:i cls:i cls_original:n", VOTES)
def _(t):
    return Tr.smooth_class(t.detections, "track_id", 0.5, class_names=CLASS_NAMES)


# The same per entity, where a class must have been seen three times to lead.
ENTITY_VOTES = (
    VOTES.replace("FROM detections)", "FROM (SELECT * REPLACE (track_id * 3 + det_id % 2 AS track_id) FROM detections))")
    .replace("999999] AS seen", "999999] AS seen, [0::BIGINT, 0, 0, 0, 0] AS hits")
    .replace("AS stable, score, seen", "AS stable, score, seen, hits")
    .replace("ELSE s.seen[c + 1] END) AS seen", """ELSE s.seen[c + 1] END) AS seen,
                   list_transform([0, 1, 2, 3, 4], lambda c: s.hits[c + 1] + CASE WHEN c = d.cls THEN 1 ELSE 0 END) AS hits""")
    .replace("WHEN lead <> stable AND", "WHEN lead <> stable AND hits[lead + 1] >= 3 AND")
)


@query("smooth_class_entity", "det_id:i cls:i cls_original:n", ENTITY_VOTES)
def _(t):
    d = t.detections.withColumn("entity_id", (F.col("track_id") * 3 + F.col("det_id") % 2).cast("long"))
    return Tr.smooth_class(d, "entity_id", 0.5, min_hits=3, class_names=CLASS_NAMES)


def _with_ids(t):
    """Detections with entity and cluster ids given by arithmetic, for the operators after matching."""
    e = F.col("det_id")
    return (
        _located(t).withColumn("entity_id", (F.col("track_id") * 3 + e % 2).cast("long"))
        .withColumn("cluster_id", F.when(e % 7 != 0, (F.col("track_id") + 10 * (F.col("frame") % 2)).cast("long")))
        .withColumn("cluster_hits", F.col("frame").cast("long")).withColumn("cluster_confirmed", (e % 3 == 0) & (e % 7 != 0))
        .withColumn("cluster_lat", F.col("lat")).withColumn("cluster_lon", F.col("lon"))
        .withColumn("grounded", e % 13 != 0)
    )


IDS = f"""SELECT *, track_id * 3 + det_id % 2 AS entity_id, CASE WHEN det_id % 7 <> 0 THEN track_id + 10 * (frame % 2) END AS cluster_id,
            det_id % 3 = 0 AND det_id % 7 <> 0 AS cluster_confirmed, det_id % 13 <> 0 AS grounded FROM ({GROUND})"""


@query("dedupe_frame", "det_id:i entity_id:i",
       f"""SELECT det_id, entity_id FROM ({IDS}) QUALIFY row_number() OVER (PARTITION BY video_id, frame, entity_id ORDER BY conf DESC, x1, y1, det_id) = 1""")
def _(t):
    return Tr.dedupe_frame(_with_ids(t))


@query("dedupe_frame_null_conf", "det_id:i entity_id:i",
       f"""SELECT det_id, entity_id FROM ({IDS}) QUALIFY row_number() OVER (PARTITION BY video_id, frame, entity_id
           ORDER BY CASE WHEN det_id % 3 = 0 OR det_id % 7 = 0 THEN 0 ELSE conf END DESC, x1, y1, det_id) = 1""")
def _(t):
    return Tr.dedupe_frame(_half_known(_with_ids(t)))


VALID = "SELECT video_id, track_id, count(*) AS frames, avg(conf) AS mean_conf FROM detections GROUP BY ALL HAVING count(*) >= 14 AND avg(conf) >= 0.5"


@query("valid_tracks", "video_id:s track_id:i frames:i mean_conf:d", VALID)
def _(t):
    return Tr.valid_tracks(t.detections, 14, 0.5)


@query("confirm_detections", "det_id:i status:s reject_reason:s",
       f"""SELECT det_id, CASE WHEN r IS NULL THEN 'confirmed' ELSE 'rejected' END AS status, r AS reject_reason FROM (
             SELECT det_id, CASE WHEN NOT grounded THEN 'no_ground_projection' WHEN cluster_confirmed THEN NULL
               WHEN track_id IS NULL THEN 'cluster_unconfirmed' WHEN v.frames IS NOT NULL THEN NULL ELSE 'track_short_or_low_conf' END AS r
             FROM ({IDS}) LEFT JOIN ({VALID}) v USING (video_id, track_id))""")
def _(t):
    return Tr.confirm_detections(_with_ids(t), 14, 0.5)


@query("cluster_summary", "video_id:s cluster_id:i frames:i first_frame:i last_frame:i mean_conf:d max_conf:d track_ids:j",
       f"""SELECT video_id, cluster_id, count(*) AS frames, min(frame) AS first_frame, max(frame) AS last_frame, avg(conf) AS mean_conf,
             max(conf) AS max_conf, list_sort(list_distinct(list(track_id))) AS track_ids
           FROM ({IDS}) WHERE cluster_id IS NOT NULL GROUP BY ALL HAVING count(*) >= 3""")
def _(t):
    return Tr.cluster_summary(_with_ids(t), 3)


@query("track_summary", "video_id:s track_id:i frames:i first_frame:i last_frame:i mean_conf:d max_conf:d cls:i name:s lat:d lon:d",
       f"""SELECT s.*, l.cls, l.name, l.lat, l.lon FROM (SELECT video_id, track_id, count(*) AS frames, min(frame) AS first_frame, max(frame) AS last_frame,
             avg(conf) AS mean_conf, max(conf) AS max_conf FROM detections GROUP BY ALL) s JOIN (SELECT * FROM ({GROUND})
             QUALIFY row_number() OVER (PARTITION BY video_id, track_id ORDER BY frame DESC, conf, x1 DESC, y1 DESC, det_id DESC) = 1) l USING (video_id, track_id)""")
def _(t):
    return Tr.track_summary(_located(t))


ENDS = f"""SELECT video_id, entity_id, min(frame) AS sf, max(frame) AS ef, min_by(name, (-k, o)) AS name, any_value(sl) AS sl, any_value(so) AS so,
             any_value(el) AS el, any_value(eo) AS eo, any_value(se) AS se, any_value(sn) AS sn, any_value(ee) AS ee, any_value(en) AS en FROM (
             SELECT *, count(*) OVER (PARTITION BY video_id, entity_id, name) AS k, min((frame, det_id)) OVER (PARTITION BY video_id, entity_id, name) AS o,
               first_value(lat) OVER w AS sl, first_value(lon) OVER w AS so, last_value(lat) OVER w AS el, last_value(lon) OVER w AS eo,
               first_value((lon - dlon) * 111320 * cos(radians((lat + dlat) / 2))) OVER w AS se, first_value((lat - dlat) * 111320) OVER w AS sn,
               last_value((lon - dlon) * 111320 * cos(radians((lat + dlat) / 2))) OVER w AS ee, last_value((lat - dlat) * 111320) OVER w AS en
             FROM (SELECT *, track_id * 1000 + frame // 4 AS entity_id FROM ({GROUND}))
             WINDOW w AS (PARTITION BY video_id, entity_id ORDER BY frame, det_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
           GROUP BY video_id, entity_id"""
CAND = f"""WITH e AS MATERIALIZED ({ENDS}),
   p AS (SELECT a.video_id, a.entity_id AS src, b.entity_id AS dst, sqrt(pow(a.ee - b.se, 2) + pow(a.en - b.sn, 2)) AS distance_m,
                4 + 2 * (b.sf - a.ef) / 5.0::DOUBLE AS allowed_m
         FROM e a JOIN e b ON a.video_id = b.video_id AND b.sf - a.ef > 0 AND b.sf - a.ef <= 12 AND a.name = b.name)
   SELECT *, distance_m / greatest(allowed_m, 1e-6) AS score FROM p WHERE distance_m <= allowed_m"""


def _fragments(t):
    return _located(t).withColumn("entity_id", F.col("track_id").cast("long") * 1000 + F.expr("frame DIV 4"))


def _candidates(t, fragments=None):
    return Fr.fragment_candidates(Fr.fragment_ends(_fragments(t) if fragments is None else fragments), 5.0, 12, 4.0, 2.0)


def _merged(t, compat=False):
    """Fragments are located once, for the search and for the relabelling, and kept without what neither reads."""
    fragments = shared(_fragments(t).select("video_id", "frame", "det_id", "entity_id", "track_id", "name", "lat", "lon", "lat_drone", "lon_drone"))
    return Fr.merge_fragments(fragments, _candidates(t, fragments), compat)


@query("fragment_candidates", "video_id:s src:i dst:i distance_m:d allowed_m:d score:d", CAND)
def _(t):
    return _candidates(t)


MERGED = f"""
    WITH RECURSIVE c AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY score, distance_m, src, dst) AS k FROM ({CAND})),
    s AS (SELECT video_id, 0::BIGINT AS k, [-1::BIGINT] AS a, [-1::BIGINT] AS b FROM (SELECT DISTINCT video_id FROM c)
          UNION ALL
          SELECT c.video_id, c.k, CASE WHEN free THEN list_append(a, src::BIGINT) ELSE a END AS a, CASE WHEN free THEN list_append(b, dst::BIGINT) ELSE b END AS b
          FROM (SELECT c.*, s.a, s.b, NOT list_contains(s.a, c.src::BIGINT) AND NOT list_contains(s.b, c.dst::BIGINT) AS free
                FROM s JOIN c ON c.video_id = s.video_id AND c.k = s.k + 1) c),
    l AS (SELECT video_id, unnest(a) AS src, unnest(b) AS dst FROM (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY k DESC) = 1)),
    h AS (SELECT video_id, src AS head, dst AS node FROM l WHERE src >= 0 AND (video_id, src) NOT IN (SELECT (video_id, dst) FROM l)
          UNION ALL SELECT h.video_id, h.head, l.dst FROM h JOIN l ON l.video_id = h.video_id AND l.src = h.node)
    SELECT det_id, coalesce(head, e) AS entity_id, coalesce(head, e) AS track_id FROM (SELECT det_id, video_id, track_id * 1000 + frame // 4 AS e FROM detections) d
    LEFT JOIN h ON h.video_id = d.video_id AND h.node = d.e"""


@query("merge_fragments", "det_id:i entity_id:i track_id:i", MERGED)
def _(t):
    return _merged(t)


@query("merge_fragments_compat", "det_id:i entity_id:i track_id:i")
def _(t):
    return _merged(t, compat=True)


@query("count_unique_by_motion", "det_id:i entity_id:i north:d east:d")
def _(t):
    return Tr.count_unique_by_motion(t.detections, t.telemetry, W, H)


@query("travel_radius", "event_id:i linear:d limited:d reciprocal:d log:d min_linear_log:d",
       """SELECT event_id, 12 * s AS linear, least(30, 12 * s) AS limited,
                 12 * list_sum([70.0::DOUBLE / (70 + k) for k in range(CAST(ceil(s) AS BIGINT))]) AS reciprocal,
                 12 * ln(s) / ln(1.15::DOUBLE) AS log, least(12 * s, 12 * ln(s) / ln(1.15::DOUBLE)) AS min_linear_log
          FROM (SELECT event_id, 1 + (event_id % 90) * 0.25::DOUBLE AS s FROM events)""")
def _(t):
    s = 1 + (F.col("event_id") % 90) * 0.25
    kinds = ["linear", "limited", "reciprocal", "log", "min_linear_log"]
    return t.raw("events").select("event_id", *[D.travel_radius(F.lit(12.0), s, k).alias(k) for k in kinds])


OBS = """SELECT det_id, video_id, track_id AS entity_id, CAST(frame AS DOUBLE) AS ts, conf AS prob, x1, y1, x2, y2,
           (det_id * 17 % 97)::DOUBLE AS north, (det_id * 31 % 89)::DOUBLE AS east FROM detections"""


def _observations(t):
    e = F.col("det_id")
    return t.detections.select(
        "det_id", "video_id", F.col("track_id").alias("entity_id"), F.col("frame").cast("double").alias("ts"), F.col("conf").alias("prob"),
        "x1", "y1", "x2", "y2", (e * 17 % 97).cast("double").alias("north"), (e * 31 % 89).cast("double").alias("east"),
    )


_DIST = "sqrt(pow((x1 + x2) / 2 - 320, 2) + pow((y1 + y2) / 2 - 256, 2))"
_B = f"(ln(greatest(sqrt(sqrt(320.0::DOUBLE * 320 + 256 * 256)), {_DIST})) / ln(sqrt(sqrt(320.0::DOUBLE * 320 + 256 * 256))))"
MODES = {
    "first": "ts, det_id", "last": "ts DESC, det_id DESC", "max_prob": "prob DESC, ts, det_id",
    "centered": f"1 / {_B} DESC, ts, det_id", "mixed": f"prob / {_B} DESC, ts, det_id",
}


def _representative(mode, order):
    @query(f"representative_{mode}", "video_id:s entity_id:i det_id:i",
           f"SELECT video_id, entity_id, det_id FROM ({OBS}) QUALIFY row_number() OVER (PARTITION BY video_id, entity_id ORDER BY {order}) = 1")
    def _(t):
        return Tr.representative_obs(_observations(t), mode, center=(320.0, 256.0))


for _m, _o in MODES.items():
    _representative(_m, _o)

MEDOID = f"""WITH o AS ({OBS}) SELECT a.video_id, a.entity_id, a.det_id FROM o a JOIN o b ON a.video_id = b.video_id AND a.entity_id = b.entity_id
             GROUP BY a.video_id, a.entity_id, a.det_id, a.ts
             QUALIFY row_number() OVER (PARTITION BY a.video_id, a.entity_id
               ORDER BY round(avg(sqrt(pow(a.north - b.north, 2) + pow(a.east - b.east, 2))), 9), a.ts, a.det_id) = 1"""


@query("representative_medoid", "video_id:s entity_id:i det_id:i", MEDOID)
def _(t):
    return Tr.representative_obs(_observations(t), "medoid")


@query("representative_medoid_blocks", "video_id:s entity_id:i det_id:i", MEDOID)
def _(t):
    """The same by the route for large entities."""
    return Tr.representative_obs(_observations(t).repartition("det_id"), "medoid")


@query("chain_timestamps", "video_id:s frame:i ts:d",
       """WITH f AS (SELECT *, frame // 30 AS file_no FROM telemetry), e AS (SELECT video_id, file_no, max_by(ts, frame) AS x FROM f GROUP BY ALL),
               s AS (SELECT video_id, file_no, coalesce(sum(x + 20) OVER (PARTITION BY video_id ORDER BY file_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sh FROM e)
          SELECT video_id, frame, ts + sh AS ts FROM f JOIN s USING (video_id, file_no)""")
def _(t):
    return Te.chain_timestamps(t.telemetry.withColumn("file_no", F.expr("frame DIV 30")))


PATHS = f"""SELECT video_id, track_id, frame, det_id, lat, lon, row_number() OVER w AS seq, count(*) OVER (PARTITION BY video_id, track_id) AS points
            FROM ({GROUND}) WHERE lat IS NOT NULL WINDOW w AS (PARTITION BY video_id, track_id ORDER BY frame, det_id)"""


@query("track_paths", "video_id:s track_id:i seq:i lat:d lon:d", f"SELECT * FROM ({PATHS}) WHERE points >= 2")
def _(t):
    return P.track_paths(_located(t))


@query("smooth_path", "video_id:s track_id:i seq:i lat:d lon:d",
       f"""SELECT video_id, track_id, seq, CASE WHEN points <= 2 THEN lat ELSE avg(lat) OVER w END AS lat, CASE WHEN points <= 2 THEN lon ELSE avg(lon) OVER w END AS lon
           FROM (SELECT * FROM ({PATHS}) WHERE points >= 2) WINDOW w AS (PARTITION BY video_id, track_id ORDER BY seq ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)""")
def _(t):
    return P.smooth_path(P.track_paths(_located(t)), slab=8)


# Stretches split at their farthest point; ends of all stretches stay.
SIMPLE = f"""
    WITH RECURSIVE p AS MATERIALIZED (SELECT * FROM ({PATHS}) WHERE points >= 2),
    s AS (SELECT video_id, track_id, min(seq) AS lo, max(seq) AS hi FROM p GROUP BY ALL
          UNION ALL
          SELECT video_id, track_id, unnest([lo, mid]) AS lo, unnest([mid, hi]) AS hi FROM (
            SELECT s.video_id, s.track_id, s.lo, s.hi, max(dist) AS far, arg_min(seq, (-dist, seq)) AS mid FROM (
              SELECT s.video_id, s.track_id, s.lo, s.hi, c.seq, CASE WHEN a.lat = b.lat AND a.lon = b.lon THEN sqrt(pow(c.lat - a.lat, 2) + pow(c.lon - a.lon, 2))
                  ELSE abs((b.lon - a.lon) * c.lat - (b.lat - a.lat) * c.lon + b.lat * a.lon - b.lon * a.lat) / sqrt(pow(b.lon - a.lon, 2) + pow(b.lat - a.lat, 2)) END AS dist
              FROM s JOIN p a ON a.video_id = s.video_id AND a.track_id = s.track_id AND a.seq = s.lo
                JOIN p b ON b.video_id = s.video_id AND b.track_id = s.track_id AND b.seq = s.hi
                JOIN p c ON c.video_id = s.video_id AND c.track_id = s.track_id AND c.seq > s.lo AND c.seq < s.hi) s
            GROUP BY s.video_id, s.track_id, s.lo, s.hi) WHERE far > 2e-5)
    SELECT DISTINCT video_id, track_id, unnest([lo, hi]) AS seq FROM s"""


@query("simplify_path", "video_id:s track_id:i seq:i", SIMPLE)
def _(t):
    return P.simplify_path(P.track_paths(_located(t)), 2e-5)


@query("latest_points", "det_id:i",
       """WITH f AS (SELECT *, CASE WHEN det_id % 3 = 0 THEN det_id % 4 END AS cl, CASE WHEN det_id % 5 <> 0 THEN track_id END AS tr FROM detections)
          SELECT det_id FROM f WHERE cl IS NOT NULL QUALIFY row_number() OVER (PARTITION BY video_id, cl ORDER BY frame DESC, det_id DESC) = 1
          UNION ALL SELECT det_id FROM f WHERE cl IS NULL AND tr IS NOT NULL QUALIFY row_number() OVER (PARTITION BY video_id, tr ORDER BY frame DESC, det_id DESC) = 1
          UNION ALL SELECT det_id FROM f WHERE cl IS NULL AND tr IS NULL""")
def _(t):
    e = F.col("det_id")
    f = t.detections.withColumn("cluster_id", F.when(e % 3 == 0, e % 4)).withColumn("track_id", F.when(e % 5 != 0, F.col("track_id")))
    return P.latest_points(f.withColumn("lat", F.lit(54.0)).withColumn("lon", F.lit(24.0)))


@query("features_bounds", "lon_min:d lat_min:d lon_max:d lat_max:d",
       f"SELECT min(lon) AS lon_min, min(lat) AS lat_min, max(lon) AS lon_max, max(lat) AS lat_max FROM ({GROUND})")
def _(t):
    return P.features_bounds(_located(t))
