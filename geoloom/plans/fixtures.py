"""Views derived from the driver's tables; the same text runs in Spark and in DuckDB, but for raster samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "gps_point": ("events", "SELECT event_id AS point_id, user_id AS path_id, ts, -122.5e0 + ((event_id*7919) % 10007)/10007e0 AS lon, 37e0 + ((event_id*104729) % 10009)/10009e0 AS lat, value AS alt FROM events"),
    "gps_point_raw": ("events", "SELECT event_id AS point_id, CAST(-200 + (event_id*7919) % 400 AS DOUBLE) AS lon, CAST(-100 + (event_id*104729) % 200 AS DOUBLE) AS lat FROM events"),
    "footprint_map": ("supplier", "SELECT s_suppkey AS map_id, -122.5e0 + ((s_suppkey*7919) % 997)/997e0 AS min_lon, 37e0 + ((s_suppkey*4241) % 991)/991e0 AS min_lat, 0.02e0 + (s_suppkey % 7)*0.01e0 AS size FROM supplier"),
    "footprint_texture": ("customer", "SELECT c_custkey AS texture_id, -122.5e0 + ((c_custkey*6151) % 983)/983e0 AS min_lon, 37e0 + ((c_custkey*3089) % 977)/977e0 AS min_lat, 0.01e0 + (c_custkey % 5)*0.005e0 AS size FROM customer"),
    "mesh_box": ("orders", "SELECT o_orderkey AS mesh_id, o_orderkey % 40 AS file_no, 3 + o_custkey % 5 AS n_vertex, 3*(1 + o_custkey % 3) AS n_index, CAST((o_custkey*7919) % 4999 AS DOUBLE) + (o_orderkey % 31)*0.01e0 AS x0, CAST((o_custkey*104729) % 50 AS DOUBLE) AS y0, 0e0 AS z0, 1e0 AS size FROM orders"),
    "capture_record": ("events", "SELECT CAST(floor(event_id/512e0) AS BIGINT) AS dump_id, event_id AS seq, CASE event_type WHEN 'signup' THEN 'matrix' WHEN 'click' THEN 'bind_texture' WHEN 'view' THEN 'enable' WHEN 'purchase' THEN 'draw' ELSE 'clear' END AS tag, CAST(floor(value*100 + 0.5e0) AS BIGINT) AS arg, (event_id % 197 = 0) AS stencil FROM events"),
    "state_record": ("events", "SELECT CAST(floor(event_id/512e0) AS BIGINT) AS dump_id, event_id AS seq, CASE CAST(floor(value*100 + 0.5e0) AS BIGINT) % 10 WHEN 0 THEN 'matrix' WHEN 1 THEN 'bind_texture' WHEN 2 THEN 'enable' WHEN 3 THEN 'disable_texture' WHEN 4 THEN 'array_buffer' WHEN 5 THEN 'element_buffer' WHEN 6 THEN 'enable_attribute' WHEN 7 THEN 'disable_attribute' WHEN 8 THEN 'attribute_pointer' ELSE 'draw' END AS tag, user_id % 7 AS arg, user_id % 4 AS index FROM events"),
    "pixel_run_input": ("events", "SELECT user_id AS block_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS pos, CAST(floor(value/50e0) AS BIGINT) AS v FROM events"),
    "texture_level": ("part", "SELECT p_partkey % 200 AS texture_id, p_size % 6 AS level, p_partkey AS write_no, 64*(1 + p_partkey % 4) AS width, 128 AS height, 1024 + p_partkey % 977 AS size FROM part"),
    "dxt1_block": ("orders", "SELECT o_orderkey AS block_id, (o_orderkey*7919) % 65536 AS c0, (o_custkey*104729) % 65536 AS c1, (o_orderkey*2654435761) % 4294967296 AS idx FROM orders"),
    "raster_sample": ("embeddings", "SELECT CAST(floor(vec_id/64e0) AS BIGINT) AS map_id, vec_id % 64 AS row, CAST(p AS BIGINT) AS col, CAST(v AS DOUBLE)*1000e0 AS h FROM embeddings LATERAL VIEW posexplode(embedding) t AS p, v"),
    "band_sample": ("embeddings", "SELECT CAST(floor(vec_id/128e0) AS BIGINT) AS map_id, CAST(floor(vec_id/64e0) AS BIGINT) % 2 AS band, vec_id % 64 AS row, CAST(p AS BIGINT) AS col, CAST(v AS DOUBLE)*1000e0 AS h FROM embeddings LATERAL VIEW posexplode(embedding) t AS p, v"),
}
DUCKDB = VIEWS | {
    "band_sample": ("embeddings", 'SELECT CAST(floor(vec_id/128e0) AS BIGINT) AS map_id, CAST(floor(vec_id/64e0) AS BIGINT) % 2 AS band, vec_id % 64 AS "row", i-1 AS col, CAST(embedding[i] AS DOUBLE)*1000e0 AS h FROM embeddings, generate_series(1,64) g(i)'),
    "raster_sample": ("embeddings", 'SELECT CAST(floor(vec_id/64e0) AS BIGINT) AS map_id, vec_id % 64 AS "row", i-1 AS col, CAST(embedding[i] AS DOUBLE)*1000e0 AS h FROM embeddings, generate_series(1,64) g(i)'),
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived view over the tables in ``sf_dir``."""
    table, text = VIEWS[name]
    return spark.sql(text.replace(f"FROM {table}", "FROM {t}"), t=spark.read.parquet(f"{sf_dir}/{table}.parquet"))


def sql(names: str, text: str) -> str:
    """DuckDB SQL that begins with the named views; ``text`` may begin with further ones after a comma."""
    return "WITH " + ", ".join(f"{n} AS ({DUCKDB[n][1]})" for n in names.split()) + "\n" + text
