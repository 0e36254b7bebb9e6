"""Areas, markers, players, search and claims (ids J5-J8, J17, P4-P6, L1-L3, L5, L6, A17-A19, U1, U4-U6, S5, W7, R9)."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxelspark.functions import grid, iso
from voxelspark.operators import overlay, spatial
from voxelspark.plans import outlines
from voxelspark.sources import overlays

from . import sqlcolor as q
from . import views as fx
from .views import define, oracle

define("o_listed", ("fx_claim_chunks",), "SELECT DISTINCT area_id FROM fx_claim_chunks")
define(
    "o_requests",
    (),
    "SELECT o_orderkey AS request_id, 'overworld' AS dimension, CAST(floor((o_orderkey*7919%3001)/10.0) AS INTEGER)-150+i AS chunk_x, "
    "CAST(o_custkey*31%301 AS INTEGER)-150 AS chunk_z FROM orders, (VALUES (0),(1),(2)) t(i)",
)
define(
    "o_conflicts",
    ("o_requests", "fx_areas", "fx_claim_chunks", "o_listed"),
    "SELECT DISTINCT r.* FROM o_requests r WHERE EXISTS (SELECT 1 FROM fx_claim_chunks c JOIN fx_areas a ON a.id=c.area_id AND a.kind='claim' WHERE c.chunk_x=r.chunk_x AND c.chunk_z=r.chunk_z) "
    "OR EXISTS (SELECT 1 FROM fx_areas a WHERE a.kind='claim' AND a.id NOT IN (SELECT area_id FROM o_listed) AND r.chunk_x*16<a.max_x AND r.chunk_x*16+16>a.min_x AND r.chunk_z*16<a.max_z AND r.chunk_z*16+16>a.min_z)",
)
define(
    "o_shapes",
    ("fx_areas", "fx_claim_chunks"),
    "SELECT a.*, CASE WHEN id%3=0 THEN 'polygon' WHEN id%3=1 THEN 'chunks' END AS shape, c.x0,c.z0,c.x1,c.z1 FROM fx_areas a LEFT JOIN "
    "(SELECT area_id, min(chunk_x)*16 AS x0, min(chunk_z)*16 AS z0, max(chunk_x)*16+16 AS x1, max(chunk_z)*16+16 AS z1 FROM fx_claim_chunks GROUP BY 1) c ON c.area_id=a.id",
)
_VIS = "(zoom<0 OR (coalesce(a.min_zoom<=zoom,true) AND coalesce(a.max_zoom>=zoom,true)))"
_HIT = "v.dimension=a.dimension AND v.min_x<a.max_x AND a.min_x<v.max_x AND v.min_z<a.max_z AND a.min_z<v.max_z"
define("o_view_areas", ("fx_viewports", "fx_areas"), f"SELECT v.view_id, a.* FROM fx_viewports v JOIN fx_areas a ON {_HIT} AND {_VIS}")


def requests(spark, sf):
    o = fx.table(spark, sf, "orders")
    base = o.select(
        F.col("o_orderkey").alias("request_id"),
        F.lit(fx.DIM).alias("dimension"),
        (F.floor((F.col("o_orderkey") * 7919 % 3001) / 10).cast("int") - 150).alias("cx"),
        ((F.col("o_custkey") * 31 % 301).cast("int") - 150).alias("chunk_z"),
    )
    return base.withColumn("i", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))).select(
        "request_id", "dimension", (F.col("cx") + F.col("i")).alias("chunk_x"), "chunk_z"
    )


def conflicts(spark, sf):
    return overlay.claim_conflicts(requests(spark, sf), fx.areas(spark, sf), fx.claim_chunks(spark, sf))


def shapes(spark, sf):
    """Areas as polygons, chunk sets (possibly empty) and plain rectangles."""
    c = fx.claim_chunks(spark, sf).groupBy("area_id").agg(
        F.collect_list(F.struct(F.col("chunk_x").alias("x"), F.col("chunk_z").alias("z"))).alias("chunks")
    )
    a = fx.areas(spark, sf)
    x0, z0, x1, z1 = [F.col(n).cast("double") for n in spatial.BOUNDS]
    pt = lambda x, z: F.struct(x.alias("x"), z.alias("z"))
    ring = F.array(pt(x0 + 0.25, z0 + 3), pt(x1 - 1.5, z0 - 2.75), pt((x0 + x1) / 2, z1 + 0.5))
    a = a.withColumns(
        {
            "shape": F.when(F.col("id") % 3 == 0, "polygon").when(F.col("id") % 3 == 1, "chunks"),
            "polygon": F.when(F.col("id") % 3 == 0, ring),
        }
    )
    a = a.join(c.withColumnRenamed("area_id", "id"), "id", "left")
    a = a.withColumn("chunks", F.when(F.col("shape") == "chunks", F.coalesce("chunks", F.array().cast("array<struct<x:int,z:int>>"))))
    # A tenth of the rectangles are given inverted.
    swap = F.col("id") % 10 == 2
    return a.withColumns({"min_x": F.when(swap, F.col("max_x")).otherwise(F.col("min_x")), "max_x": F.when(swap, F.col("min_x")).otherwise(F.col("max_x"))})


def q_unclaim(spark, sf):
    removed = fx.table(spark, sf, "orders").filter("o_orderstatus = 'F'").select(
        F.lit(fx.DIM).alias("dimension"), (F.col("o_orderkey") % 64 - 32).cast("int").alias("chunk_x"),
        ((F.col("o_orderkey") * 7) % 64 - 32).cast("int").alias("chunk_z"),
    ).distinct()
    left = overlay.unclaim(fx.claim_chunks(spark, sf), fx.areas(spark, sf), removed)
    return overlay.chunk_boxes(left)


def q_bounded(spark, sf):
    first = overlay.first_areas_in_views(fx.viewports(spark, sf), fx.areas(spark, sf), 40)
    return first.select("view_id", F.col("r_id").alias("id"), "truncated")


def q_force(spark, sf):
    on = ["dimension", "chunk_x", "chunk_z"]
    current = fx.marks(spark, sf).select(*on).distinct()
    changes = fx.table(spark, sf, "orders").select(
        F.element_at(F.array(*[F.lit(d) for d in DIMS]), (F.col("o_orderkey") % 5 + 1).cast("int")).alias("dimension"),
        (F.col("o_custkey") % 40).cast("int").alias("chunk_x"), (F.col("o_orderkey") % 9).cast("int").alias("chunk_z"),
        (F.col("o_orderkey") % 3 > 0).alias("loaded"), "o_custkey",
    )
    # One instruction per chunk: the latest order decides.
    changes = changes.groupBy(*on).agg(F.max_by("loaded", "o_custkey").alias("_l"), F.max("o_custkey").alias("k")).select(*on, (F.col("k") % 3 > 0).alias("loaded"))
    return overlay.force_loaded(current, changes)


DIMS = ("click", "error", "purchase", "signup", "view")


def q_documents(spark, sf):
    """Overlay documents written from the tables, one per hundred rows, and read back."""
    a = fx.areas(spark, sf).select(
        F.floor(F.col("id") / 100).alias("doc"),
        F.struct(
            F.col("id").cast("string").alias("id"), "kind", "name", "owner", "dimension", F.lit("rect").alias("shape"),
            F.col("min_x").alias("minX"), F.col("min_z").alias("minZ"), F.col("max_x").alias("maxX"), F.col("max_z").alias("maxZ"),
            F.col("min_zoom").alias("minZoom"),
        ).alias("areas"),
    )
    docs = a.groupBy("doc").agg(F.collect_list("areas").alias("areas")).select(F.to_json(F.struct("areas")).alias("value"))
    return overlays.parse_areas(docs).select("id", "kind", "owner", "shape", "min_x", "min_z", "max_x", "max_z", "min_zoom")


def q_search(spark, sf):
    found = overlay.search("ring", overlay.latest_positions(fx.positions(spark, sf)), fx.markers(spark, sf), fx.areas(spark, sf), fx.DIM, 100)
    return found


def q_coordinates(spark, sf):
    k = F.col("event_id")
    text = F.when(k % 4 == 0, F.concat_ws(" ", F.floor("x").cast("string"), F.floor("z").cast("string"))).when(
        k % 4 == 1, F.concat(F.floor("x").cast("string"), F.lit(", 72;"), F.floor("z").cast("string"))
    ).when(k % 4 == 2, F.concat_ws(" ", "name", F.lit("12"))).otherwise(F.concat_ws(" ", F.lit("1"), F.lit("2"), F.lit("3"), F.lit("4")))
    p = fx.positions(spark, sf).select("event_id", overlay.parse_coordinates(text).alias("at"))
    return p.filter("at is not null").select("event_id", F.col("at.x").alias("x"), F.col("at.z").alias("z"))


def q_toggle(spark, sf):
    o = fx.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("user"), (F.col("o_orderkey") % 17).cast("int").alias("min_cx"), (F.col("o_orderkey") % 5).cast("int").alias("min_cz"),
        (F.col("o_orderkey") % 13).cast("int").alias("max_cx"), (F.col("o_orderkey") % 7).cast("int").alias("max_cz"),
    )
    return overlay.toggled(overlay.select_range(o), ["user", "chunk_x", "chunk_z"])


def q_extent(spark, sf):
    return outlines.extent_to_chunks(fx.viewports(spark, sf), "ne", 12).select("view_id", "min_cx", "min_cz", "max_cx", "max_cz")


def q_area_rings(spark, sf):
    a = overlay.area_bounds(shapes(spark, sf))
    return outlines.area_rings(a, zoom=5, camera="sw", reference_y=63, min_zooms={"claim": 4}).select(
        "id", "part", F.size("ring").alias("points"), F.round(F.col("ring")[0]["u"], 3).alias("u0"), F.round(F.col("ring")[1]["v"], 3).alias("v1"),
    )


QUERIES = {
    "j5_areas_in_viewport": lambda s, sf: overlay.areas_in_views(fx.viewports(s, sf), fx.areas(s, sf).drop("owner", "name")).select("view_id", F.col("r_id").alias("id")),
    "j5_markers_in_viewport": lambda s, sf: overlay.markers_in_views(fx.viewports(s, sf), fx.markers(s, sf).drop("name", "y"), ["POI"]).select("view_id", F.col("r_id").alias("id")),
    "j6_points_in_rectangles": lambda s, sf: overlay.players_in_views(
        fx.viewports(s, sf), fx.positions(s, sf).select("event_id", F.lit(fx.DIM).alias("dimension"), "x", "z", "hidden")).select("event_id", F.col("r_view_id").alias("view_id")),
    "j7_claim_conflicts": conflicts,
    "j7_accepted_requests": lambda s, sf: overlay.accepted_requests(requests(s, sf), conflicts(s, sf)).groupBy("request_id").agg(F.count("*").alias("chunks")),
    "j8_unclaim": q_unclaim,
    "j17_spawn_seeding": lambda s, sf: overlay.seed_spawn_markers(fx.dimensions(s), fx.markers(s, sf)),
    "p4_kind_filter": lambda s, sf: fx.areas(s, sf).filter(overlay.kind_matches("kind", ["Claim"])).groupBy("kind", "owner").agg(F.count("*").alias("n")),
    "p5_zoom_visibility": lambda s, sf: fx.areas(s, sf).withColumn("zoom", F.explode(F.sequence(F.lit(-1), F.lit(11)))).filter(overlay.visible_at("zoom", "min_zoom", "max_zoom")).groupBy("zoom").agg(F.count("*").alias("n")),
    "p6_hidden_players": lambda s, sf: overlay.shown_players(fx.positions(s, sf)).groupBy("player").agg(F.count("*").alias("n")),
    "l1_ranked_search": q_search,
    "l2_coordinate_literals": q_coordinates,
    "l3_bounded_result": q_bounded,
    "l5_dimension_order": lambda s, sf: fx.positions(s, sf).select("dimension").distinct().withColumn(
        "place", F.row_number().over(overlay.Window.orderBy(*overlays.display_order("dimension", ("view", "click"))))),
    "l6_listing": lambda s, sf: fx.areas(s, sf).filter(overlay.kind_matches("kind", ["region"])).orderBy("id").select("id", "kind", "name", "dimension"),
    "a17_inventory": lambda s, sf: overlay.inventory(fx.areas(s, sf), fx.markers(s, sf), fx.positions(s, sf).select("player").distinct()),
    "a18_owner_legend": lambda s, sf: overlay.owner_legend(fx.areas(s, sf), fx.claim_chunks(s, sf)),
    "a19_shape_bounds": lambda s, sf: overlay.area_bounds(shapes(s, sf)).select("id", "shape", *spatial.BOUNDS),
    "u1_force_load_set": q_force,
    "u4_range_toggle": q_toggle,
    "u5_snapshot_diff": lambda s, sf: overlay.snapshot_diff(fx.positions(s, sf).filter("day(ts) < 3"), fx.positions(s, sf).filter("day(ts) = 29"), "player"),
    "u6_extent_to_chunks": q_extent,
    "s5_overlay_documents": q_documents,
    "w7_latest_position": lambda s, sf: overlay.latest_positions(fx.positions(s, sf)).select("player", "name", "dimension", "ts", "x", "z").orderBy("name"),
    "r9_area_outlines": q_area_rings,
    "r9_marker_points": lambda s, sf: outlines.marker_points(fx.markers(s, sf), zoom=5, camera="nw", reference_y=63).select("id", "u", "v"),
}

_SCORE = lambda f: f"(CASE WHEN lower({f})='ring' THEN -1 WHEN instr(lower({f}),'ring')>0 THEN instr(lower({f}),'ring')-1 END)"
ORACLE = {
    "j5_areas_in_viewport": oracle("o_view_areas", "SELECT view_id,id FROM o_view_areas"),
    "j5_markers_in_viewport": oracle(
        "fx_viewports fx_markers",
        "SELECT v.view_id,a.id FROM fx_viewports v JOIN fx_markers a ON v.dimension=a.dimension AND a.x>=v.min_x AND a.x<v.max_x AND a.z>=v.min_z AND a.z<v.max_z "
        "AND a.kind='poi' AND (zoom<0 OR coalesce(a.min_zoom<=zoom,true))",
    ),
    "j6_points_in_rectangles": oracle(
        "fx_viewports fx_positions",
        "SELECT p.event_id,v.view_id FROM fx_positions p JOIN fx_viewports v ON NOT p.hidden AND trunc(p.x)>=v.min_x AND trunc(p.x)<v.max_x AND trunc(p.z)>=v.min_z AND trunc(p.z)<v.max_z",
    ),
    "j7_claim_conflicts": oracle("o_conflicts", "SELECT * FROM o_conflicts"),
    "j7_accepted_requests": oracle(
        "o_conflicts", "SELECT request_id,count(*) AS chunks FROM o_requests WHERE request_id NOT IN (SELECT request_id FROM o_conflicts) GROUP BY 1"
    ),
    "j8_unclaim": oracle(
        "fx_claim_chunks fx_areas",
        ", r AS (SELECT DISTINCT o_orderkey%64-32 AS cx,(o_orderkey*7)%64-32 AS cz FROM orders WHERE o_orderstatus='F') "
        "SELECT area_id,CAST(min(chunk_x)*16 AS INTEGER) AS min_x,CAST(min(chunk_z)*16 AS INTEGER) AS min_z,CAST(max(chunk_x)*16+16 AS INTEGER) AS max_x,CAST(max(chunk_z)*16+16 AS INTEGER) AS max_z,count(*) AS chunks "
        "FROM fx_claim_chunks c WHERE NOT (EXISTS (SELECT 1 FROM fx_areas a WHERE a.id=c.area_id AND a.kind='claim') AND EXISTS (SELECT 1 FROM r WHERE r.cx=c.chunk_x AND r.cz=c.chunk_z)) GROUP BY 1",
    ),
    "j17_spawn_seeding": oracle(
        "fx_dims fx_markers",
        "SELECT 'spawn-'||dimension AS id,'spawn' AS kind,'Spawn' AS name,dimension,spawn_x AS x,spawn_z AS z FROM fx_dims WHERE enabled AND dimension NOT IN (SELECT dimension FROM fx_markers WHERE kind='spawn')",
    ),
    "p4_kind_filter": oracle("fx_areas", "SELECT kind,owner,count(*) AS n FROM fx_areas WHERE kind='claim' GROUP BY 1,2"),
    "p5_zoom_visibility": oracle(
        "fx_areas", f"SELECT zoom,count(*) AS n FROM (SELECT *,CAST(unnest(range(-1,12)) AS INTEGER) AS zoom FROM fx_areas) a WHERE {_VIS} GROUP BY 1"
    ),
    "p6_hidden_players": oracle("fx_positions", "SELECT player,count(*) AS n FROM fx_positions WHERE NOT hidden GROUP BY 1"),
    "l1_ranked_search": oracle(
        "fx_positions fx_markers fx_areas",
        ", l AS (SELECT * FROM (SELECT *,row_number() OVER (PARTITION BY player ORDER BY ts DESC,event_id DESC) AS rn FROM fx_positions) WHERE rn=1 AND NOT hidden), "
        f"h AS (SELECT 'player' AS type,CAST(player AS VARCHAR) AS id,name,CAST(trunc(x) AS INTEGER) AS x,CAST(trunc(z) AS INTEGER) AS z,dimension,{_SCORE('name')} AS score FROM l "
        f"UNION ALL SELECT kind,CAST(id AS VARCHAR),name,x,z,dimension,coalesce({_SCORE('name')},{_SCORE('CAST(id AS VARCHAR)')}) FROM fx_markers WHERE dimension='overworld' "
        f"UNION ALL SELECT kind,CAST(id AS VARCHAR),name,CAST(trunc((min_x+max_x)/2.0) AS INTEGER),CAST(trunc((min_z+max_z)/2.0) AS INTEGER),dimension,coalesce({_SCORE('name')},{_SCORE('owner')}) FROM fx_areas) "
        "SELECT type,id,name,x,z,dimension,CAST(score AS INTEGER) AS score FROM h WHERE score IS NOT NULL ORDER BY score,name,type,id LIMIT 100",
    ),
    "l2_coordinate_literals": oracle("fx_positions", "SELECT event_id,CAST(floor(x) AS INTEGER) AS x,CAST(floor(z) AS INTEGER) AS z FROM fx_positions WHERE event_id%4<2"),
    "l3_bounded_result": oracle(
        "o_view_areas",
        "SELECT view_id,id,n>40 AS truncated FROM (SELECT view_id,id,row_number() OVER (PARTITION BY view_id ORDER BY id) AS rn,count(*) OVER (PARTITION BY view_id) AS n FROM o_view_areas) WHERE rn<=40",
    ),
    "l5_dimension_order": oracle(
        "fx_positions",
        "SELECT dimension,CAST(row_number() OVER (ORDER BY CASE dimension WHEN 'view' THEN 0 WHEN 'click' THEN 1 ELSE 99 END,dimension) AS INTEGER) AS place FROM (SELECT DISTINCT dimension FROM fx_positions)",
    ),
    "l6_listing": oracle("fx_areas", "SELECT id,kind,name,dimension FROM fx_areas WHERE kind='region' ORDER BY id"),
    "a17_inventory": oracle(
        "fx_areas fx_markers fx_positions",
        "SELECT 'areas' AS what,count(*) AS n FROM fx_areas UNION ALL SELECT 'markers',count(*) FROM fx_markers UNION ALL SELECT 'players',count(DISTINCT player) FROM fx_positions",
    ),
    "a18_owner_legend": oracle(
        "fx_areas fx_claim_chunks",
        ", n AS (SELECT area_id,count(*) AS n FROM fx_claim_chunks GROUP BY 1), l AS (SELECT coalesce(owner,'Unclaimed') AS owner,CAST(sum(coalesce(n,greatest(1,floor((max_x-min_x)/16.0+0.5))*greatest(1,floor((max_z-min_z)/16.0+0.5)))) AS BIGINT) AS chunks "
        "FROM fx_areas a LEFT JOIN n ON n.area_id=a.id WHERE kind='claim' GROUP BY 1) "
        f"SELECT owner,chunks,({q.c.OWNER_COLORS and fx._arr(q.c.OWNER_COLORS)})[CAST(list_reduce(list_prepend(CAST(0 AS BIGINT),list_transform(string_split(owner,''),lambda c: CAST(ascii(c) AS BIGINT))),lambda a,b: (a*31+b)%4294967296)%10+1 AS INTEGER)] AS color FROM l",
    ),
    "a19_shape_bounds": oracle(
        "o_shapes",
        "SELECT id,coalesce(shape,'rect') AS shape,"
        "CAST(CASE WHEN shape='polygon' THEN min_x WHEN shape='chunks' AND x0 IS NOT NULL THEN x0 ELSE min_x END AS INTEGER) AS min_x,"
        "CAST(CASE WHEN shape='polygon' THEN min_z-3 WHEN shape='chunks' AND x0 IS NOT NULL THEN z0 ELSE min_z END AS INTEGER) AS min_z,"
        "CAST(CASE WHEN shape='polygon' THEN ceil(max_x-1.5) WHEN shape='chunks' AND x0 IS NOT NULL THEN x1 ELSE max_x END AS INTEGER) AS max_x,"
        "CAST(CASE WHEN shape='polygon' THEN max_z+1 WHEN shape='chunks' AND x0 IS NOT NULL THEN z1 ELSE max_z END AS INTEGER) AS max_z FROM o_shapes",
    ),
    "u1_force_load_set": oracle(
        "fx_marks",
        ", c AS (SELECT (['click','error','purchase','signup','view'])[CAST(o_orderkey%5+1 AS INTEGER)] AS dimension,CAST(o_custkey%40 AS INTEGER) AS chunk_x,CAST(o_orderkey%9 AS INTEGER) AS chunk_z,max(o_custkey)%3>0 AS loaded FROM orders GROUP BY 1,2,3) "
        "SELECT dimension,chunk_x,chunk_z FROM (SELECT DISTINCT dimension,chunk_x,chunk_z FROM fx_marks UNION SELECT dimension,chunk_x,chunk_z FROM c WHERE loaded) m WHERE NOT EXISTS (SELECT 1 FROM c WHERE NOT loaded AND c.dimension=m.dimension AND c.chunk_x=m.chunk_x AND c.chunk_z=m.chunk_z)",
    ),
    "u4_range_toggle": "SELECT u AS user,chunk_x,chunk_z FROM (SELECT o_custkey AS u,x AS chunk_x,CAST(unnest(range(least(o_orderkey%5,o_orderkey%7),greatest(o_orderkey%5,o_orderkey%7)+1)) AS INTEGER) AS chunk_z FROM "
    "(SELECT o_custkey,o_orderkey,CAST(unnest(range(least(o_orderkey%17,o_orderkey%13),greatest(o_orderkey%17,o_orderkey%13)+1)) AS INTEGER) AS x FROM orders)) GROUP BY 1,2,3 HAVING count(*)%2=1",
    "u5_snapshot_diff": oracle(
        "fx_positions",
        ", b AS (SELECT DISTINCT player FROM fx_positions WHERE day(ts)<3), a AS (SELECT DISTINCT player FROM fx_positions WHERE day(ts)=29) "
        "SELECT player,'joined' AS change FROM a WHERE player NOT IN (SELECT player FROM b) UNION ALL SELECT player,'left' FROM b WHERE player NOT IN (SELECT player FROM a)",
    ),
    "u6_extent_to_chunks": oracle(
        "fx_viewports",
        # north-east camera: a=-z, b=x; map y grows upward, so v=-y; blocks sit one below their top
        ", c AS (SELECT view_id,u,v,13.0e0-yy AS half FROM (SELECT view_id,CAST(unnest([min_x,max_x,min_x,max_x]) AS DOUBLE) AS u,0 AS v,CAST(unnest([min_z,min_z,max_z,max_z]) AS DOUBLE) AS yy FROM fx_viewports)), "
        "b AS (SELECT view_id,floor(half-u/2) AS bx,floor(-(half+u/2)) AS bz FROM c) "
        "SELECT view_id,CAST(floor(min(bx)/16) AS INTEGER) AS min_cx,CAST(floor(min(bz)/16) AS INTEGER) AS min_cz,CAST(floor(max(bx)/16) AS INTEGER) AS max_cx,CAST(floor(max(bz)/16) AS INTEGER) AS max_cz FROM b GROUP BY 1",
    ),
    "s5_overlay_documents": oracle("fx_areas", "SELECT CAST(id AS VARCHAR) AS id,kind,owner,'rect' AS shape,min_x,min_z,max_x,max_z,min_zoom FROM fx_areas"),
    "w7_latest_position": oracle(
        "fx_positions",
        "SELECT player,name,dimension,ts,x,z FROM (SELECT *,row_number() OVER (PARTITION BY player ORDER BY ts DESC,event_id DESC) AS rn FROM fx_positions) WHERE rn=1 AND NOT hidden",
    ),
    "r9_area_outlines": oracle(
        "o_shapes fx_claim_chunks",
        # south-west camera: a=z, b=-x
        ", vis AS (SELECT * FROM o_shapes WHERE coalesce(min_zoom<=5,true) AND coalesce(max_zoom>=5,true)), "
        "pts AS (SELECT id,0 AS part,4 AS points,min_z+3+min_x+0.25 AS u0,((min_z-2.75)-(max_x-1.5))*0.5-64 AS v1 FROM vis WHERE shape='polygon' "
        "UNION ALL SELECT v.id,CAST(row_number() OVER (PARTITION BY v.id ORDER BY c.chunk_x,c.chunk_z)-1 AS INTEGER),5,c.chunk_z*16+c.chunk_x*16,(c.chunk_z*16-(c.chunk_x*16+16))*0.5-64 FROM vis v JOIN fx_claim_chunks c ON c.area_id=v.id WHERE v.shape='chunks' "
        "UNION ALL SELECT id,0,5,min_z+min_x,(min_z-max_x)*0.5-64 FROM vis WHERE shape IS NULL) "
        "SELECT id,part,points,round(CAST(u0 AS DOUBLE),3) AS u0,round(CAST(v1 AS DOUBLE),3) AS v1 FROM pts",
    ),
    "r9_marker_points": oracle(
        "fx_markers",
        "SELECT id,CAST(-x+z AS DOUBLE) AS u,(-x-z)*0.5e0-(coalesce(y,63)+1) AS v FROM fx_markers WHERE coalesce(min_zoom<=5,true)",
    ),
}
