"""Keypoint tables derived from the star schema: the same SQL text runs in Spark and in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinefold.operators.filters import BUCKET_FRAMES
from kinefold.sources.tables import bounded_tasks

#: name -> (tables and views that it reads, SQL)
VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "inst": (("lineitem",), "SELECT concat('g', CAST(l_orderkey % 8 AS STRING)) AS group_id, CAST(floor(l_orderkey / 8.0) AS INT) AS frame, CAST(l_linenumber AS INT) AS animal, CAST(min(l_partkey) AS BIGINT) AS pk, CAST(min(l_suppkey) AS BIGINT) AS sk, CAST(min(l_quantity) AS DOUBLE) AS q, CAST(round(min(l_discount) * 100) AS INT) AS disc FROM lineitem GROUP BY 1, 2, 3"),
    "sess": (("orders",), "SELECT concat('g', CAST(o_orderkey % 8 AS STRING)) AS group_id, CASE WHEN o_orderkey % 8 < 3 THEN 'annotated' ELSE 'tracked' END AS label_source, CASE WHEN o_orderkey % 2 = 0 THEN '2d' ELSE '3d' END AS mode, CASE WHEN o_orderkey % 8 < 5 THEN 'train' ELSE 'test' END AS split, CAST(max(floor(o_orderkey / 8.0)) + 1 AS INT) AS n_frames FROM orders GROUP BY 1, 2, 3, 4"),
    "det": (("inst",), "SELECT group_id, frame, concat('c', CAST(animal % 2 AS STRING)) AS camera, animal AS det, CAST((pk * 37) % 160 AS DOUBLE) AS x0, CAST((sk * 53) % 120 AS DOUBLE) AS y0, CAST((pk * 37) % 160 AS DOUBLE) + 20 + q AS x1, CAST((sk * 53) % 120 AS DOUBLE) + 20 + q AS y1, CAST(16 + disc AS DOUBLE) / CAST(32 AS DOUBLE) AS score FROM inst"),
    "insts": (("det",), "SELECT group_id, frame, camera, det AS animal, x0, y0, x1, y1, CASE WHEN det % 5 = 0 THEN 'present' WHEN frame % 11 = 0 THEN 'absent' ELSE 'labeled' END AS status FROM det"),
    "regions": (("det",), "SELECT DISTINCT group_id, frame, camera, CAST((frame * 7) % 80 AS DOUBLE) AS x0, CAST((frame * 5) % 60 AS DOUBLE) AS y0, CAST((frame * 7) % 80 + 90 AS DOUBLE) AS x1, CAST((frame * 5) % 60 + 70 AS DOUBLE) AS y1, 'labelled_complete' AS status FROM det WHERE frame % 3 <> 0"),
    "part4": ((), "SELECT * FROM (VALUES ('nose', 0, 0), ('ear_l', -6, 4), ('ear_r', 6, 4), ('tail', 0, 30)) AS t(bodypart, dx, dy)"),
    "truth": (("inst", "part4"), "SELECT group_id, frame, animal, bodypart, CASE WHEN (pk + dy) % 13 = 0 THEN 'missing' WHEN (pk + dy) % 17 = 0 THEN 'projected' ELSE 'visible' END AS status, CASE WHEN (pk + dy) % 13 = 0 THEN NULL ELSE CAST((pk * 37) % 160 + dx AS DOUBLE) END AS x, CASE WHEN (pk + dy) % 13 = 0 THEN NULL ELSE CAST((sk * 53) % 120 + dy AS DOUBLE) END AS y FROM inst CROSS JOIN part4 WHERE (sk + dx) % 19 <> 0"),
    "pred": (("inst", "part4"), "SELECT group_id, frame, (animal * 3 + frame % 2) % 7 + 10 * (CASE WHEN animal > 7 THEN 1 ELSE 0 END) AS pred, bodypart, CAST((pk * 37) % 160 + dx + (pk % 5) - 2 AS DOUBLE) AS x, CAST((sk * 53) % 120 + dy + (sk % 5) - 2 AS DOUBLE) AS y, CAST(disc - 4 AS DOUBLE) / CAST(4 AS DOUBLE) AS logit FROM inst CROSS JOIN part4 WHERE pk % 11 <> 0 AND (pk + dx) % 7 <> 0"),
    "track": (("events",), "SELECT concat('t', CAST(CAST(floor(user_id / 6.0) AS INT) AS STRING)) AS group_id, CAST(user_id % 6 AS INT) AS animal, CAST(floor(event_id / 200.0) AS INT) AS frame, CAST(floor(min(value) * 8) AS DOUBLE) AS x, CAST(min(event_id) % 97 AS DOUBLE) AS y FROM events GROUP BY 1, 2, 3"),
    "files": (("customer",), "SELECT concat('rec', CAST(c_nationkey AS STRING), '_cam', CAST(c_custkey % 4 AS STRING), '_', CAST(c_custkey % 7 AS STRING), '.mp4') AS name, CAST(100 + c_custkey % 3 AS INT) AS n_frames FROM customer"),
}


def fixture(spark: SparkSession, sf_dir: str, name: str, **given: DataFrame) -> DataFrame:
    """A derived table; what it reads may be given, dealt in another way."""
    reads, sql = VIEWS[name]
    sources = {x: given[x] if x in given else fixture(spark, sf_dir, x) if x in VIEWS else table(spark, sf_dir, x) for x in reads}
    return fixture_of(spark, sql, sources)


def fixture_of(spark: SparkSession, sql: str, sources: dict[str, DataFrame]) -> DataFrame:
    """A view's SQL over these tables."""
    for x in sources:
        sql = sql.replace(f"FROM {x}", f"FROM {{{x}}}").replace(f"JOIN {x}", f"JOIN {{{x}}}")
    return spark.sql(sql, **sources)


def bucketed(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """inst or a view of it with the bucket of frames, dealt by clip and bucket before instances are made: views of one session that read the same columns share that shuffle."""
    reads, sql = VIEWS[name]
    if name != "inst":
        own = {x: bucketed(spark, sf_dir, x) if x in VIEWS and VIEWS[x][0] else fixture(spark, sf_dir, x) for x in reads}
        return fixture_of(spark, sql.replace("SELECT group_id, frame", "SELECT group_id, bucket, frame", 1), own)
    clip, bucket = "concat('g', CAST(l_orderkey % 8 AS STRING))", f"CAST(floor(l_orderkey / {8.0 * BUCKET_FRAMES}) AS INT)"
    rows = table(spark, sf_dir, "lineitem")
    rows = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), F.expr(clip), F.expr(bucket))
    sql = sql.replace(" AS group_id, ", f" AS group_id, {bucket} AS bucket, ", 1).replace("GROUP BY 1, 2, 3", "GROUP BY 1, 2, 3, 4")
    return fixture_of(spark, sql, {"lineitem": rows})


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    path = f"{sf_dir}/{name}.parquet"
    bounded_tasks(spark, path)
    return spark.read.parquet(path)


def ctes(*names: str) -> str:
    """WITH and the views, each after those that it reads."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in VIEWS and name not in order:
            for x in VIEWS[name][0]:
                visit(x)
            order.append(name)

    for name in names:
        visit(name)
    return "WITH " + ", ".join(f"{x} AS ({VIEWS[x][1]})" for x in order) + " "
