"""Checks and limits on what a request may ask for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import grid

# Request limits.
MAX_BLOCK_COORDINATE = 40_000_000
MAX_QUERY_SPAN = 2_000_000
MAX_QUERY_ROWS = 20_000
MAX_SELECTED_CHUNKS = 144
MAX_HEIGHT_CHUNKS = 1024


def request_guard(rows: DataFrame) -> DataFrame:
    """Validity and first reason of a tile or area request."""
    span = grid.tile_span("zoom")
    most = F.floor(F.lit(MAX_BLOCK_COORDINATE) / span) + 2
    wide = (F.col("max_x") - F.col("min_x") > MAX_QUERY_SPAN) | (F.col("max_z") - F.col("min_z") > MAX_QUERY_SPAN)
    reason = (
        F.when((F.abs("tile_x") > most) | (F.abs("tile_y") > most), "tile index")
        .when((F.col("max_x") < F.col("min_x")) | (F.col("max_z") < F.col("min_z")), "inverted bounds")
        .when(wide, "span")
        .when(F.col("chunks") > MAX_SELECTED_CHUNKS, "selection")
        .when(F.col("heights") > MAX_HEIGHT_CHUNKS, "heights")
    )
    return rows.withColumns(
        {"reason": reason, "valid": reason.isNull(), "effective_limit": F.least(F.col("limit"), F.lit(MAX_QUERY_ROWS))}
    )


def world_border(rows: DataFrame, dimensions: DataFrame, default: int = 4000) -> DataFrame:
    """Rows inside their dimension's square border."""
    half = F.floor(F.when(F.col("border") > 0, F.col("border")).otherwise(F.lit(default)) / 2).cast("int")
    j = rows.join(dimensions.select("dimension", "border", "center_x", "center_z"), "dimension")
    inside = grid.in_bounds(
        "x", "z", F.col("center_x") - half, F.col("center_z") - half, F.col("center_x") + half, F.col("center_z") + half
    )
    return j.filter(inside)


def parse_slice(text, min_y, max_y) -> Column:
    """Slice level of a request: NULL for none, never below the floor."""
    y = grid.col(text).try_cast("int")
    return F.when(y.isNull() | (y >= grid.col(max_y)), None).otherwise(F.greatest(y, grid.col(min_y)))
