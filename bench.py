"""Headline queries on written world tables; prints one JSON line.

The domain tables (voxels, sections, columns, slabs, areas, ...) are derived from the
given Parquet files and written once, untimed, as a deployment would hold them. Each
query then runs from those tables: one warm-up, then the median of three runs.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from voxelspark.operators import changes, overlay, rays, surface
from voxelspark.plans import isometric, pyramid, style
from voxelspark.session import build_session
from workload import asset_queries, change_queries, overlay_queries, surface_queries
from workload import views as fx
from workload.style_queries import UNEXPLORED

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))


def written(spark, folder: str, name: str, df):
    path = f"{folder}/{name}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def main() -> None:
    spark = build_session("bench", CPUS, int(CPUS))
    folder = tempfile.mkdtemp(prefix="spark-")
    table = lambda name, df: written(spark, folder, name, df)
    pal, bio, dims = fx.palette(spark), fx.biomes(spark), fx.dimensions(spark)
    vox = table("voxels", fx.voxels(spark, SF))
    sec = table("sections", fx.sections(spark, SF))
    col = table("columns", surface.surface_scan(vox, pal, sec))
    spans = surface.canopy_spans(vox, pal)
    slab = table("slabs", surface.extract_slabs(vox, spans, surface_queries.slab_depths(spans)))
    areas, views = table("areas", fx.areas(spark, SF)), table("views", fx.viewports(spark, SF))
    marks, points = table("marks", fx.marks(spark, SF)), table("rays", fx.rays(spark, SF))
    pixels = lambda: pyramid.base_pixels(style.column_colors(col, pal, bio, dims))
    base = table("pixels", pixels())

    queries = {
        "a1_surface_scan": (lambda: surface.surface_scan(vox, pal, sec), vox),
        "a5_slab_depth": (lambda: surface_queries.slab_depths(surface.canopy_spans(vox, pal)), vox),
        "r2_plan_tiles": (lambda: pyramid.with_tiles(pixels()), col),
        "r3_pyramid": (lambda: pyramid.build_pyramid(base, UNEXPLORED, 6), base),
        "r4_height_field_view": (lambda: isometric.height_field_view(col, pal, bio, dims), col),
        "r6_voxel_view": (lambda: isometric.voxel_view(slab, col, pal, bio, dims), slab),
        "j5_areas_in_viewport": (lambda: overlay.areas_in_views(views, areas), areas),
        "j9_face_exposure": (lambda: isometric.face_exposure(slab, pal), slab),
        "j10_height_rays": (lambda: rays.pick_columns(points, col, dims), points),
        "j11_voxel_rays": (lambda: rays.pick_voxels(points, slab, pal, dims), points),
        "t1_dirty_coalescing": (lambda: changes.settled_chunks(marks, "6 hours"), marks),
        "u2_affected_tiles": (lambda: changes.affected_tiles(marks, 2, 8), marks),
    }
    # These derive their tables anew on every run, as registered.
    for family, name, source in ((overlay_queries, "j7_claim_conflicts", areas), (overlay_queries, "l3_bounded_result", views), (change_queries, "w9_track_segments", marks), (asset_queries, "a12_mip_levels", areas)):
        queries[name] = (lambda run=family.QUERIES[name]: run(spark, SF), source)
    seconds, rate = {}, {}
    only = [n for n in os.environ.get("BENCH_ONLY", "").split(",") if n]
    for name, (query, source) in queries.items():
        if only and name not in only:
            continue
        times = []
        for run in range(RUNS + 1):
            start = time.perf_counter()
            query().write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times[1:]), 3)
        rate[name] = round(source.count() / seconds[name])
        print(f"{name}: {seconds[name]} s", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline queries, total of median seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "input_rows_per_sec": rate,
                "sf": os.path.basename(SF.rstrip("/")),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
