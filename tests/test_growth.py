"""Joins whose rows must not grow with the square of the input."""

from pyspark.sql import functions as F
from voxelspark.operators import lookups, overlay, surface


def most_rows(df):
    """The largest output of any operator of the plan that ran."""
    list(df.toLocalIterator())  # runs the plan of this very frame
    found, left = 0, [df._jdf.queryExecution().executedPlan()]
    while left:
        node = left.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            left.append(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            left.append(node.plan())
        metric = node.metrics().get("numOutputRows")
        if metric.isDefined():
            found = max(found, metric.get().value())
        left += [node.children().apply(i) for i in range(node.children().size())]
    return found


def test_aliases_of_a_name_with_many_layers(spark):
    n = 2000
    rows = spark.range(2 * n).select(
        F.when(F.col("id") % 2 == 0, "stone").otherwise(F.concat(F.lit("a"), F.col("id") % 7)).alias("name"),
        F.when(F.col("id") % 2 == 1, "stone").alias("alias"), F.floor(F.col("id") / 2).cast("int").alias("layer"), "id",
    )
    out = lookups.resolve_aliases(rows)
    got = {(r["name"], r["layer"]): r["id"] for r in out.filter("_late = 1").collect()}
    assert got == {(f"a{(2 * k + 1) % 7}", k): 2 * k for k in range(n)}
    assert most_rows(out) <= 4 * n


def test_first_areas_without_all_pairs(spark, monkeypatch):
    rows = []
    original = overlay.areas_in_views
    monkeypatch.setattr(overlay, "areas_in_views", lambda v, a, *rest: rows.append(v.count() * a.count()) or original(v, a, *rest))
    box = [F.lit(v).cast("int").alias(c) for c, v in zip(("min_x", "min_z", "max_x", "max_z"), (0, 0, 100, 100))]
    views = spark.range(20).select(F.col("id").alias("view_id"), F.lit("d").alias("dimension"), *box, F.lit(-1).alias("zoom"))
    # The last view meets few areas, and late ones; one meets just as many as the limit, one none.
    views = views.withColumn("max_x", F.when(F.col("view_id") == 19, 1).otherwise(F.col("max_x")))
    views = views.unionByName(views.filter("view_id = 0").withColumns({"view_id": F.lit(20).cast("long"), "min_x": F.lit(500), "max_x": F.lit(501)}))
    views = views.unionByName(views.filter("view_id = 0").withColumns({"view_id": F.lit(21).cast("long"), "min_x": F.lit(900), "max_x": F.lit(901)}))
    x = F.when(F.col("id").isin(3990, 3995, 3999), 0).when(F.col("id").isin(5, 3000, 3001), 500).otherwise(50).cast("int")
    areas = spark.range(4000).select("id", F.lit("d").alias("dimension"), F.lit("claim").alias("kind"), x.alias("min_x"), F.lit(0).alias("min_z"),
                                     (x + 1).alias("max_x"), F.lit(1).alias("max_z"), F.lit(None).cast("int").alias("min_zoom"), F.lit(None).cast("int").alias("max_zoom"))
    got = overlay.first_areas_in_views(views, areas, 3)
    got = sorted((r["view_id"], r["r_id"], r["truncated"]) for r in got.collect())
    want = overlay.bounded(original(views, areas), ["view_id"], ["r_id"], 3)
    assert got == sorted((r["view_id"], r["r_id"], r["truncated"]) for r in want.collect()) and len(got) == 63
    assert len(rows) > 1 and sum(rows) < 22 * 4000 / 4


def test_window_sums_without_pairs(spark):
    n = 6000
    k = F.col("id")
    cut = lambda c: F.when(k % 50 > 0, c)
    points = spark.range(n).select(
        cut(F.lit("d")).alias("dimension"), (k * 37 % 301 - 150).cast("int").alias("x"), (k * 53 % 911 - 300).cast("int").alias("z"), F.when(k % 7 > 0, k % 90).cast("int").alias("height")
    )
    low_x, low_z = (k * 29 % 301 - 150).cast("int"), (k * 31 % 701 - 300).cast("int")
    size = lambda m: (k * m % 517 - 3).cast("int")  # some are empty or inverted
    windows = spark.range(300).select(
        (k % 299).alias("window_id"), F.when(k != 9, "d").alias("dimension"), low_x.alias("min_x"), low_z.alias("min_z"), (low_x + size(11)).alias("max_x"), (low_z + size(7)).alias("max_z")
    )
    got = surface.window_sums(points, windows, "height")
    want = surface.window_columns(points, windows).groupBy("window_id").agg(F.count("*").alias("n"), F.sum("height").alias("height"))
    rows = sorted(map(tuple, got.collect()))
    assert rows == sorted(map(tuple, want.collect())) and len(rows) > 200 and sum(r[1] for r in rows) > 150_000
    assert most_rows(got) < 60_000
    assert surface.window_sums(points, windows.limit(0)).count() == 0


def test_window_assembly_makes_no_pairs(spark, monkeypatch):
    from workload import surface_queries

    monkeypatch.setattr(surface, "window_columns", None)
    assert surface_queries.QUERIES["j3_window_assembly"](spark, "/root/testdata/sf0.001").columns == ["window_id", "n", "height", "chunk_errors"]


def test_pairs_of_one_cell_are_dealt_to_every_partition(spark):
    from voxelspark.operators import spatial

    k = F.col("id")
    at = lambda m: (k * m % 1500).cast("int")
    points = spark.range(600).coalesce(1).select(k.alias("point"), F.when(k % 97 > 0, "d").alias("dimension"), at(37).alias("x"), at(53).alias("z"))
    box = dict(zip(spatial.BOUNDS, (at(11), at(7), at(11) + 1200, at(7) + 1100)))
    views = spark.range(1300).coalesce(1).select(k.alias("view"), F.when(k % 89 > 0, "d").alias("dimension"), *[c.cast("int").alias(n) for n, c in box.items()])
    got = spatial.points_in_rectangles(points, views).select("point", "r_view", F.spark_partition_id().alias("part")).collect()
    inside = (F.col("x") >= F.col("min_x")) & (F.col("x") < F.col("max_x")) & (F.col("z") >= F.col("min_z")) & (F.col("z") < F.col("max_z"))
    want = points.join(views, "dimension").filter(inside).select("point", "view")
    assert sorted(r[:2] for r in got) == sorted(map(tuple, want.collect())) and len(got) > 100_000
    parts = [sum(r["part"] == p for r in got) for p in {r["part"] for r in got}]
    assert len(parts) == int(spark.conf.get("spark.sql.shuffle.partitions")) and max(parts) < len(got) / 2


def shuffled(df):
    """Rows written by all shuffles of the plan that ran."""
    list(df.toLocalIterator())
    total, left = 0, [df._jdf.queryExecution().executedPlan()]
    while left:
        node = left.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            left.append(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            left.append(node.plan())
        metric = node.metrics().get("shuffleRecordsWritten")
        total += metric.get().value() if metric.isDefined() else 0
        left += [node.children().apply(i) for i in range(node.children().size())]
    return total


def test_voxel_view_shuffles_faces_not_pixels(spark, sf):
    from voxelspark.plans import isometric
    from workload import surface_queries, views

    slabs, columns = surface_queries.slabs(spark, sf), surface_queries.columns(spark, sf)
    tables = views.palette(spark), views.biomes(spark), views.dimensions(spark)
    view = isometric.voxel_view(slabs, columns, *tables, zoom=8)
    assert shuffled(view) < view.count() / 4  # the former code: more rows than pixels


def test_slice_below_slabs_draws_nothing(spark, sf):
    from voxelspark.plans import isometric, style
    from workload import surface_queries, views

    slabs, columns = surface_queries.slabs(spark, sf), surface_queries.columns(spark, sf)
    tables = views.palette(spark), views.biomes(spark), views.dimensions(spark)
    assert isometric.voxel_view(slabs, columns, *tables, slice_y=0).count() == 0
    cut = slabs.filter("x % 3 > 0")  # the others are drawn as height field, whatever the slice
    flat = isometric.voxel_view(cut, columns, *tables, slice_y=0)
    on = ["dimension", "x", "z"]
    bare = isometric.with_exposure(columns).join(cut.select(*on).distinct(), on, "left_anti")
    want = isometric.height_field_cells(isometric.face_colors(bare, *tables, "terrain", style.StyleOptions()), 7)
    assert sorted(flat.collect()) == sorted(isometric.nearest(want, 7).collect()) and flat.count() > 0


def test_placed_world_needs_one_shuffle_and_equals_the_other(spark, sf):
    from voxelspark.operators import surface
    from voxelspark.plans import isometric
    from workload import surface_queries, views

    pal, tables = views.palette(spark), (views.palette(spark), views.biomes(spark), views.dimensions(spark))
    v = views.voxels(spark, sf, 5)
    same = lambda a, b: a.count() == b.count() > 0 and a.select(sorted(a.columns)).exceptAll(b.select(sorted(a.columns))).isEmpty()
    columns = surface.surface_scan(v, pal, views.placed(views.sections(spark, sf), 5))
    slabs = surface_queries.placed_slabs(v, pal)
    assert same(columns, surface_queries.columns(spark, sf)) and same(slabs.drop("chunk_x", "chunk_z"), surface_queries.slabs(spark, sf))
    lines = views.table(spark, sf, "lineitem").count()
    assert shuffled(slabs) == lines and shuffled(columns) < 1.2 * lines
    how = {"camera": "nw", "slice_y": 30, "style": "height"}
    placed = isometric.voxel_view(slabs, columns, *tables, partitions=5, **how)
    assert same(placed, isometric.voxel_view(surface_queries.slabs(spark, sf), surface_queries.columns(spark, sf), *tables, **how))
    # Sections of nothing but air-like blocks count for no top; nor do they in the other.
    odd = v.filter("y < 16 or block_id = 6")
    flat = odd.drop("chunk_x", "chunk_z")
    spans = surface.canopy_spans(flat, pal)
    assert same(surface_queries.placed_slabs(odd, pal).drop("chunk_x", "chunk_z"), surface.extract_slabs(flat, spans, surface_queries.slab_depths(spans)))


def test_sliced_view_shuffles_fewer_rows_than_it_has_pixels(spark, sf):
    from workload import iso_queries

    view = iso_queries.QUERIES["r6_sliced_view"](spark, sf)
    assert shuffled(view) < view.count() / 4
