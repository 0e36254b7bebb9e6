"""SQL-callable forms of the grid rules, for use from ``spark.sql``."""

from __future__ import annotations

from pyspark.sql import SparkSession

# SQL functions are inlined by the analyzer, so they cost what the expression costs.
_TILE = "CAST(floor({block} / power(2D, greatest(15 - zoom, 0))) AS INT)"
_RANGE = f"sequence({_TILE.format(block='{low}')}, {_TILE.format(block='({high} - 1)')})"

DEFINITIONS = (
    "chunk_of(block INT) RETURNS INT RETURN shiftright(block, 4)",
    "region_of(block INT) RETURNS INT RETURN shiftright(block, 9)",
    "tile_span_blocks(zoom INT) RETURNS INT RETURN CAST(power(2D, greatest(15 - zoom, 0)) AS INT)",
    f"tile_of(block INT, zoom INT) RETURNS INT RETURN {_TILE.format(block='block')}",
    f"""tiles_covering(min_x INT, min_z INT, max_x INT, max_z INT, zoom INT)
    RETURNS TABLE (tile_x INT, tile_y INT)
    RETURN SELECT inline(CASE WHEN max_x > min_x AND max_z > min_z THEN flatten(transform(
      {_RANGE.format(low="min_z", high="max_z")},
      ty -> transform({_RANGE.format(low="min_x", high="max_x")}, tx -> named_struct('tile_x', tx, 'tile_y', ty)))) END)""",
)


def register(spark: SparkSession) -> None:
    """Define the functions for this session."""
    for definition in DEFINITIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {definition}")
