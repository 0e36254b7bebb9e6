"""The incremental pyramid's query makes its pixels once."""

from workload import store_queries


def test_pixels_are_made_once(spark, sf, monkeypatch):
    made, colors = spark.sparkContext.accumulator(0), store_queries.colors

    def counted(*args):
        rows = colors(*args)

        def run(batches):
            for b in batches:
                made.add(b.num_rows)
                yield b

        return rows.mapInArrow(run, rows.schema)

    monkeypatch.setattr(store_queries, "colors", counted)
    assert store_queries.q_incremental(spark, sf).count()
    assert made.value == colors(spark, sf).count()
