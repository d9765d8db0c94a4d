"""Queries of the set operations and the training tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinefold.functions.geometry import Box, Letterbox
from kinefold.functions.random import draw, draw_sql
from kinefold.operators import frames as w
from kinefold.operators import joins as j
from kinefold.operators import sampling as t
from kinefold.operators import sets as s
from kinefold.plans.fixtures import ctes, fixture, table
from kinefold.plans.q_metrics import rounded
from kinefold.plans.registry import query


def _axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each animal-frame's bodyparts, as a session's axis."""
    return fixture(spark, sf_dir, "truth").groupBy("group_id", "frame", "animal").agg(F.array_sort(F.collect_list("bodypart")).alias("names"))


_AXES = "axes AS (SELECT group_id, frame, animal, list(bodypart ORDER BY bodypart) AS names FROM truth GROUP BY 1, 2, 3)"


@query(ctes("truth") + f", {_AXES}, e AS (SELECT group_id || '/' || CAST(frame AS VARCHAR) || '/' || CAST(animal AS VARCHAR) AS session_order, unnest(names) AS name, generate_subscripts(names, 1) - 1 AS pos FROM axes), m AS (SELECT name, min((session_order, pos)) AS seen FROM e GROUP BY 1) SELECT name, seen[1] AS first_session, CAST(seen[2] AS INTEGER) AS first_pos FROM m")
def so1_union_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _axes(spark, sf_dir).withColumn("session_order", F.concat_ws("/", "group_id", "frame", "animal"))
    return s.union_axis(own).select("name", F.col("seen.session_order").alias("first_session"), F.col("seen.pos").alias("first_pos"))


@query(ctes("truth") + f", {_AXES} SELECT array_to_string(list_sort(list_filter(['nose', 'ear_l', 'ear_r', 'tail'], lambda x: NOT list_contains(names, x))), ',') AS missing, len(names) = 4 AND names <> ['nose', 'ear_l', 'ear_r', 'tail'] AS reordered, CAST(count(*) AS BIGINT) AS n FROM axes GROUP BY 1, 2")
def so2_axis_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = s.axis_diff(_axes(spark, sf_dir), ["nose", "ear_l", "ear_r", "tail"])
    return out.groupBy(F.array_join(F.array_sort("missing"), ",").alias("missing"), "reordered").agg(F.count(F.lit(1)).alias("n"))


@query(ctes("truth") + ", a AS (SELECT group_id, frame, animal, bodypart, x FROM truth), b AS (SELECT group_id, frame, animal, bodypart, CASE WHEN status = 'projected' THEN x + 1 ELSE x END AS x FROM truth) SELECT *, 'a' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT *, 'b' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)")
def so3_same_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = fixture(spark, sf_dir, "truth")
    b = a.withColumn("x", F.when(F.col("status") == "projected", F.col("x") + 1).otherwise(F.col("x")))
    return s.same_rows(a.select(*j.POINT, "x"), b.select(*j.POINT, "x"))


@query("WITH c AS (SELECT 'o' || CAST(o_custkey % 500 AS VARCHAR) AS session_id, 'ra' AS root FROM orders GROUP BY 1 UNION ALL SELECT 'o' || CAST(c_custkey AS VARCHAR), 'rb' FROM customer GROUP BY 1), k AS (SELECT session_id, count(DISTINCT root) > 1 AS clash FROM c GROUP BY 1) SELECT CASE WHEN clash THEN session_id || '__' || root ELSE session_id END AS session_id, root FROM c JOIN k USING (session_id)")
def so4_union_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "orders").select(F.concat(F.lit("o"), F.col("o_custkey") % 500).alias("session_id")).distinct()
    b = table(spark, sf_dir, "customer").select(F.concat(F.lit("o"), F.col("c_custkey")).alias("session_id")).distinct()
    return s.union_sessions({"ra": a, "rb": b}).select("session_id", "root")


@query(ctes("regions", "det") + "SELECT group_id, frame, camera, x0, y0, x1, y1 FROM regions UNION ALL SELECT group_id, frame, camera, x0, y0, x1, y1 FROM det")
def so5_union_rects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return j.union_rects(fixture(spark, sf_dir, "regions"), fixture(spark, sf_dir, "det"), ["group_id", "frame", "camera"])


@query(ctes("pred", "truth") + "SELECT group_id, frame FROM pred INTERSECT SELECT group_id, frame FROM truth")
def so6_shared_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture(spark, sf_dir, "pred").select("group_id", "frame").intersect(fixture(spark, sf_dir, "truth").select("group_id", "frame"))


@query(ctes("truth", "insts", "track") + "SELECT DISTINCT CAST(animal AS VARCHAR) AS animal FROM (SELECT animal FROM truth UNION ALL SELECT animal FROM insts UNION ALL SELECT animal FROM track)")
def so7_animal_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.animal_vocab(*(fixture(spark, sf_dir, n) for n in ("truth", "insts", "track")))


@query("SELECT page_id, CASE WHEN regexp_matches(url, '/(de|fr)/') THEN 'test' WHEN regexp_matches(url, 'example\\.org') THEN 'val' ELSE 'train' END AS split FROM pages")
def fn1_split_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", s.split_of(F.col("url"), "/(de|fr)/", r"example\.org").alias("split"))


_FILES = "f AS (SELECT 'exp/' || regexp_extract(name, '^(rec[0-9]+)', 1) || '/' || CASE WHEN n_frames = 100 THEN 'movie.mp4' ELSE name END AS path FROM files)"


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture(spark, sf_dir, "files").select(F.concat(F.lit("exp/"), F.regexp_extract("name", "^(rec[0-9]+)", 1), F.lit("/"), F.when(F.col("n_frames") == 100, "movie.mp4").otherwise(F.col("name"))).alias("path"))


@query(ctes("files") + f", {_FILES} SELECT path, CASE WHEN path LIKE '%/movie.mp4' THEN string_split(path, '/')[2] ELSE regexp_replace(string_split(path, '/')[3], '\\.mp4$', '') END AS session_id FROM f")
def fn2_session_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paths(spark, sf_dir).select("path", s.session_of(F.col("path")).alias("session_id"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN CAST(CAST(o_orderdate AS DATE) AS VARCHAR) ELSE strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') END AS created FROM orders")
def fn3_created_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the orders have the date as metadata, the others in a folder's name."""
    o = table(spark, sf_dir, "orders")
    iso = F.date_format(F.col("o_orderdate").cast("date"), "yyyy-MM-dd")
    meta = F.when(F.col("o_orderkey") % 3 == 0, iso).otherwise(F.lit("unknown"))
    folder = F.concat(F.date_format(F.col("o_orderdate").cast("date"), "yyyyMMdd"), F.lit("_run"))
    return o.select("o_orderkey", s.created_date(meta, folder).alias("created"))


@query(ctes("inst") + "SELECT group_id AS trial, frame, CASE WHEN animal % 3 = 0 THEN 'v' || CAST(animal AS VARCHAR) END AS variant, animal FROM inst")
def fn4_frame_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = fixture(spark, sf_dir, "inst")
    key = F.concat(F.col("group_id"), F.lit("/Frame_"), F.format_string("%05d", "frame"), F.when(F.col("animal") % 3 == 0, F.concat(F.lit("__v"), F.col("animal"))).otherwise(F.lit("")))
    return own.select(s.frame_key(key).alias("k"), "animal").select("k.*", "animal")


@query("SELECT n_regionkey::VARCHAR AS dataset, name, CASE WHEN bool_and(starts_with(name, n_regionkey::VARCHAR || '-')) OVER (PARTITION BY n_regionkey) THEN substr(name, len(n_regionkey::VARCHAR) + 2) ELSE name END AS local FROM (SELECT n_regionkey, CASE WHEN n_regionkey < 3 OR n_nationkey % 2 = 0 THEN n_regionkey::VARCHAR || '-' || n_name ELSE n_name END AS name FROM nation)")
def fn5_local_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    named = F.when((F.col("n_regionkey") < 3) | (F.col("n_nationkey") % 2 == 0), F.concat_ws("-", F.col("n_regionkey").cast("string"), "n_name")).otherwise(F.col("n_name"))
    return s.local_names(n.select(F.col("n_regionkey").cast("string").alias("dataset"), named.alias("name"))).select("dataset", "name", "local")


@query(ctes("inst") + "SELECT group_id, frame, animal, CAST(pk % 100 + frame * (1 + disc % 3) AS BIGINT) AS source_frame FROM inst")
def fn6_source_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture(spark, sf_dir, "inst").select("group_id", "frame", "animal", s.source_frame(F.col("pk") % 100, 1 + F.col("disc") % 3, F.col("frame")).cast("long").alias("source_frame"))


@query("SELECT CAST(c_nationkey AS VARCHAR) AS root, c_mktsegment AS key, CAST(count(DISTINCT c_custkey % 7) AS BIGINT) AS n FROM customer GROUP BY 1, 2 HAVING count(DISTINCT c_custkey % 7) > 1")
def fn7_merge_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys with several values."""
    c = table(spark, sf_dir, "customer")
    items = c.select(F.col("c_nationkey").cast("string").alias("root"), F.col("c_mktsegment").alias("key"), (F.col("c_custkey") % 7).cast("string").alias("value"))
    return s.merge_provenance(items)[1]


_PAIRS = "p AS (SELECT DISTINCT 'k' || CAST(p_size AS VARCHAR) AS a, 'k' || CAST(p_partkey % 51 AS VARCHAR) AS b FROM part), f AS (SELECT a, b FROM p UNION SELECT b, a FROM p)"


@query(f"WITH {_PAIRS} SELECT a, CAST(count(DISTINCT b) AS BIGINT) AS n, bool_or(a = b) AS self FROM f GROUP BY 1 HAVING count(DISTINCT b) > 1 OR bool_or(a = b)")
def fn8_flip_involution(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.concat(F.lit("k"), F.col("p_size")).alias("a"), F.concat(F.lit("k"), F.col("p_partkey") % 51).alias("b")).distinct()
    return s.flip_involution(p)[1]


@query("WITH n AS (SELECT p_brand, list(DISTINCT p_size::VARCHAR || CASE WHEN p_partkey % 2 = 0 THEN 'L' ELSE 'R' END) AS names FROM part GROUP BY 1), l AS (SELECT p_brand, names, unnest(names) AS l FROM n) SELECT p_brand, l, substr(l, 1, len(l) - 1) || 'R' AS r FROM l WHERE l LIKE '%L' AND list_contains(names, substr(l, 1, len(l) - 1) || 'R')")
def fn9_left_right_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    names = p.groupBy("p_brand").agg(F.collect_set(F.concat(F.col("p_size").cast("string"), F.when(F.col("p_partkey") % 2 == 0, "L").otherwise("R"))).alias("names"))
    return names.select("p_brand", F.explode(s.left_right_pairs(F.col("names"))).alias("p")).select("p_brand", "p.l", "p.r")


@query("WITH d AS (SELECT DISTINCT n_regionkey::VARCHAR AS dataset, n_regionkey::VARCHAR || '-' || n_name AS name FROM nation), b AS (SELECT dataset, name, CAST(row_number() OVER (ORDER BY name DESC) + 4 AS INTEGER) AS kpt_id FROM d WHERE dataset = '1'), new AS (SELECT dataset, name, CAST((SELECT max(kpt_id) FROM b) + row_number() OVER (ORDER BY dataset, name) AS INTEGER) AS kpt_id FROM d WHERE dataset <> '1') SELECT * FROM b UNION ALL SELECT * FROM new")
def rg1_registry_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One dataset's ids come from an earlier registry."""
    from pyspark.sql import Window

    names = table(spark, sf_dir, "nation").select(F.col("n_regionkey").cast("string").alias("dataset"), F.col("n_name").alias("name"))
    base = names.where("dataset = '1'").distinct().withColumn("name", F.concat_ws("-", "dataset", "name")).withColumn("kpt_id", (F.row_number().over(Window.orderBy(F.desc("name"))) + 4).cast("int"))
    return s.registry_build(names, base)


@query("WITH d AS (SELECT DISTINCT n_regionkey::VARCHAR AS dataset, n_name AS local FROM nation WHERE n_regionkey IN (1, 2)), b AS (SELECT local, row_number() OVER (ORDER BY local) - 1 AS kpt_id FROM d WHERE dataset = '1'), f AS (SELECT dataset, local, (SELECT max(kpt_id) FROM b) + row_number() OVER (ORDER BY dataset, local) AS new_id FROM d) SELECT dataset, local, CAST(kpt_id AS INTEGER) AS kpt_id, CAST(new_id AS INTEGER) AS new_id FROM f JOIN b USING (local) WHERE dataset = '1'")
def rg1_registry_moved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second dataset would put a prefix before the names of the first, and so move its ids: refused."""
    names = table(spark, sf_dir, "nation").where("n_regionkey in (1, 2)").select(F.col("n_regionkey").cast("string").alias("dataset"), F.col("n_name").alias("local"))
    base = s.registry(names.where("dataset = '1'")).ids
    return s.registry(names, base).moved


# Training tables


def _index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.window_index(fixture(spark, sf_dir, "truth"), fixture(spark, sf_dir, "sess"))


_INDEX = "ix AS (SELECT DISTINCT group_id, animal, mode, label_source, split, n_frames FROM truth JOIN sess USING (group_id))"


@query(ctes("truth", "sess") + f", {_INDEX} SELECT * FROM ix")
def tr1_window_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, sf_dir).select("group_id", "animal", "mode", "label_source", "split", "n_frames")


_POOL = "pw AS (SELECT *, CASE WHEN label_source = 'annotated' THEN 0.7::DOUBLE ELSE 0.3::DOUBLE END * CASE WHEN mode = '3d' THEN 0.6::DOUBLE ELSE 0.4::DOUBLE END / count(*) OVER (PARTITION BY label_source, mode) AS w FROM ix)"


@query(ctes("truth", "sess") + f", {_INDEX}, {_POOL} SELECT group_id, animal, round(w, 9) AS w FROM pw")
def tr2_pool_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(t.pool_weights(_index(spark, sf_dir), 0.7, 0.6).select("group_id", "animal", "w"), 9)


@query(ctes("truth", "sess") + f", {_INDEX}, {_POOL} SELECT mode, label_source, round(sum(w) / (SELECT sum(w) FROM pw), 9) AS share FROM pw GROUP BY 1, 2")
def tr3_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(t.mix(t.pool_weights(_index(spark, sf_dir), 0.7, 0.6), "mode", "label_source"), 9)


@query()
def tr4_weighted_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = fixture(spark, sf_dir, "inst").count()
    return t.weighted_draw(t.pool_weights(_index(spark, sf_dir), 0.7, 0.6), n, 3, ["group_id", "animal"])


@query(ctes("truth", "sess") + f", {_INDEX} SELECT group_id, animal, round(1.0::DOUBLE / (count(*) OVER (PARTITION BY split) * (SELECT count(DISTINCT split) FROM ix)), 9) AS w FROM ix")
def tr5_balance_datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(t.balance_datasets(_index(spark, sf_dir), "split").select("group_id", "animal", "w"), 9)


@query(ctes("truth", "sess") + f", {_INDEX} SELECT group_id, animal, round(CASE WHEN label_source = 'annotated' THEN 0.8::DOUBLE ELSE 0.2::DOUBLE END / count(*) OVER (PARTITION BY label_source), 9) AS w FROM ix")
def tr6_cohort_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(t.cohort_weights(_index(spark, sf_dir), 0.8).select("group_id", "animal", "w"), 9)


_VIEWS = "v AS (SELECT DISTINCT group_id, frame, camera FROM det)"


@query(ctes("det") + f", {_VIEWS} SELECT group_id, frame, camera, round(pow(count(*) OVER (PARTITION BY group_id), -0.5::DOUBLE), 9) AS w FROM v")
def tr7_alpha_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    views = fixture(spark, sf_dir, "det").select("group_id", "frame", "camera").distinct()
    return rounded(t.alpha_weights(views, 0.5), 9)


_NEG = "n AS (SELECT group_id, frame, camera, bool_and(status = 'absent') AS negative FROM insts GROUP BY 1, 2, 3)"


@query(ctes("insts") + f", {_NEG} SELECT group_id, frame, camera, round(CASE WHEN negative THEN 0.15::DOUBLE ELSE 0.85::DOUBLE END / count(*) OVER (PARTITION BY negative), 9) AS w FROM n")
def tr8_negative_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    views = fixture(spark, sf_dir, "insts").groupBy("group_id", "frame", "camera").agg(F.bool_and(F.col("status") == "absent").alias("negative"))
    return rounded(t.negative_weights(views, 0.15).select("group_id", "frame", "camera", "w"), 9)


@query(ctes("insts", "det") + f", {_NEG}, a AS (SELECT group_id, frame, camera, CASE WHEN negative THEN 0.15::DOUBLE ELSE 0.85::DOUBLE END / count(*) OVER (PARTITION BY negative) * pow(count(*) OVER (PARTITION BY group_id), -0.5::DOUBLE) AS p FROM n) SELECT group_id, frame, camera, round(p / (SELECT sum(p) FROM a), 9) AS w FROM a")
def tr9_combine_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    views = fixture(spark, sf_dir, "insts").groupBy("group_id", "frame", "camera").agg(F.bool_and(F.col("status") == "absent").alias("negative"))
    return rounded(t.combine_weights(t.negative_weights(views, 0.15), t.alpha_weights(views, 0.5), ["group_id", "frame", "camera"]), 9)


@query(ctes("insts") + ", i AS (SELECT concat(group_id, '_', CAST(frame AS STRING)) AS group_id, frame, camera, animal, status FROM insts), a AS (SELECT group_id, count(DISTINCT animal) AS n FROM i GROUP BY 1) SELECT i.group_id, i.frame, i.camera FROM i JOIN a USING (group_id) GROUP BY 1, 2, 3 HAVING bool_and(status = 'absent') AND count(DISTINCT animal) = any_value(n)")
def tr10_absent_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each frame stands for a clip."""
    return t.absent_negatives(fixture(spark, sf_dir, "insts").withColumn("group_id", F.concat_ws("_", "group_id", "frame")))


_TRY = [draw_sql(21 + k, t.GROUP, "CAST(frame AS BIGINT)", "CAST(try AS BIGINT)") for k in (0, 1)]


@query(
    ctes("det", "regions")
    + f", d AS (SELECT r.group_id, r.frame, r.camera, r.x0, r.y0, r.x1, r.y1, t.try FROM regions r SEMI JOIN det v USING (group_id, frame, camera), (SELECT CAST(unnest(range(1, 13)) AS INTEGER) AS try) t), "
    f"c AS (SELECT group_id, frame, camera, try, CAST(floor(x0 + {_TRY[0]} * greatest(x1 - x0 - 24, 0)) AS BIGINT) AS cx, CAST(floor(y0 + {_TRY[1]} * greatest(y1 - y0 - 24, 0)) AS BIGINT) AS cy FROM d WHERE x1 - x0 >= 24 AND y1 - y0 >= 24), "
    "f AS (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM det k WHERE k.group_id = c.group_id AND k.frame = c.frame AND k.camera = c.camera AND sqrt(pow(cx + 12 - (k.x0 + k.x1) / 2, 2) + pow(cy + 12 - (k.y0 + k.y1) / 2, 2)) / ((24 + (k.x1 - k.x0 + k.y1 - k.y0) / 2) / 2) < 2.5::DOUBLE)) "
    "SELECT group_id, frame, camera, min(try) AS try, arg_min(cx, try) AS x0, arg_min(cy, try) AS y0 FROM f GROUP BY 1, 2, 3"
)
def tr11_crop_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    det = fixture(spark, sf_dir, "det")
    return t.crop_negatives(det.select("group_id", "frame", "camera").distinct(), det, fixture(spark, sf_dir, "regions"), 24.0, 21)


_VIEW = (t.GROUP, "CAST(frame AS BIGINT)", "CAST(substr(camera, 2) AS BIGINT)")
_SPOT = ("CAST(floor(cx) AS BIGINT)", "CAST(floor(cy) AS BIGINT)")


@query(
    ctes("det", "regions")
    + ", v AS (SELECT DISTINCT group_id, frame, camera, 1 AS n FROM det), reg AS (SELECT * FROM regions WHERE group_id < 'g6'), two AS (SELECT group_id, frame, camera, x0, y0, x1, y1 FROM reg UNION ALL SELECT group_id, frame, camera, x0 + 100, y0 + 50, x1 + 60, y1 + 20 FROM reg WHERE frame % 5 = 0), "
    + "ranked AS (SELECT *, row_number() OVER (PARTITION BY group_id, frame, camera ORDER BY x0, y0, x1, y1) - 1 AS k, count(*) OVER (PARTITION BY group_id, frame, camera) AS many FROM two), "
    + f"drawn AS (SELECT *, {draw_sql(22, *_VIEW, 'n')} AS ux, {draw_sql(23, *_VIEW, 'n')} AS uy, {draw_sql(26, *_VIEW, 'n')} AS ur FROM v), "
    + "b AS (SELECT group_id, frame, camera, ux * 256 AS cx, uy * 192 AS cy FROM drawn WHERE group_id >= 'g6' UNION ALL SELECT group_id, frame, camera, x0 + ux * (x1 - x0), y0 + uy * (y1 - y0) FROM drawn JOIN ranked USING (group_id, frame, camera) WHERE k = floor(ur * many)), "
    + "a AS (SELECT group_id, frame, camera, 'region' AS kind, (x0 + x1) / 2 AS cx, (y0 + y1) / 2 AS cy FROM two UNION ALL SELECT group_id, frame, camera, 'animal', (x0 + x1) / 2, (y0 + y1) / 2 FROM det WHERE frame % 7 <> 1 UNION ALL SELECT group_id, frame, camera, 'background', cx, cy FROM b), "
    + f"j AS (SELECT *, ({draw_sql(24, *_VIEW, *_SPOT)} - 0.5::DOUBLE) * 32 AS jx, ({draw_sql(25, *_VIEW, *_SPOT)} - 0.5::DOUBLE) * 32 AS jy FROM a) "
    + "SELECT group_id, frame, camera, kind, CAST(floor(greatest(least(cx - 32 + jx, 208), -16)) AS INTEGER) AS x0, CAST(floor(greatest(least(cy - 32 + jy, 144), -16)) AS INTEGER) AS y0 FROM j UNION ALL SELECT group_id, frame, camera, 'empty', 96, 64 FROM v WHERE (group_id, frame, camera) NOT IN (SELECT (group_id, frame, camera) FROM j)"
)
def tr12_tile_origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two groups certify nothing, so their background is anywhere; some views of the others have two regions, some none and no animal either."""
    det, keys = fixture(spark, sf_dir, "det"), ["group_id", "frame", "camera"]
    reg = fixture(spark, sf_dir, "regions").where("group_id < 'g6'").select(*keys, *Box._fields)
    more = reg.where("frame % 5 = 0").select(*keys, (F.col("x0") + 100).alias("x0"), (F.col("y0") + 50).alias("y0"), (F.col("x1") + 60).alias("x1"), (F.col("y1") + 20).alias("y1"))
    centres = det.where("frame % 7 <> 1").select(*keys, ((F.col("x0") + F.col("x1")) / 2).alias("cx"), ((F.col("y0") + F.col("y1")) / 2).alias("cy"))
    return t.tile_origins(det.select(*keys).distinct(), centres, reg.unionByName(more), 64.0, 256.0, 192.0, 22)


@query(ctes("insts") + "SELECT group_id, frame, camera, animal, round(x0 * 0.5 + 16, 6) AS x0, round(y0 * 0.5 + 0, 6) AS y0, round(x1 * 0.5 + 16, 6) AS x1, round(y1 * 0.5 + 0, 6) AS y1 FROM insts WHERE status = 'labeled'")
def tr13_box_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = fixture(spark, sf_dir, "insts").where("status = 'labeled'").select("group_id", "frame", "camera", "animal", *Box._fields)
    return rounded(t.box_targets(own, 256.0, 192.0, 160, 96))


@query(ctes("insts") + "SELECT group_id, frame, camera, CAST(count(*) FILTER (WHERE status <> 'absent') AS BIGINT) AS n_known, CAST(count(*) FILTER (WHERE status = 'present') AS BIGINT) AS n_ignore FROM insts GROUP BY 1, 2, 3")
def tr14_known_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["group_id", "frame", "camera"]
    own = fixture(spark, sf_dir, "insts")
    known = t.known_boxes(own).select(*keys, F.lit(1).alias("k"), F.lit(0).alias("i"))
    ignored = t.ignore_boxes(own).select(*keys, F.lit(0).alias("k"), F.lit(1).alias("i"))
    views = own.select(*keys, F.lit(0).alias("k"), F.lit(0).alias("i"))
    return known.union(ignored).union(views).groupBy(*keys).agg(F.sum("k").alias("n_known"), F.sum("i").alias("n_ignore"))


@query(ctes("det", "regions") + f", {_VIEWS}, r AS (SELECT group_id, frame, camera, count(*) AS n, sum(x0 * 0.5 + 16 + y0 * 0.5 + x1 * 0.5 + 16 + y1 * 0.5) AS total FROM regions WHERE group_id < 'g6' GROUP BY 1, 2, 3) SELECT group_id, frame, camera, CASE WHEN group_id < 'g6' THEN CAST(coalesce(n, 0) AS INTEGER) END AS n_regions, round(total, 6) AS total FROM v LEFT JOIN r USING (group_id, frame, camera)")
def tr14_regions_in_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two groups certify nothing (null); of the others every third frame has no region (an empty list)."""
    own, reg = fixture(spark, sf_dir, "det"), fixture(spark, sf_dir, "regions").where("group_id < 'g6'")
    found = t.regions_in_view(own.select("group_id", "frame", "camera").distinct(), reg, reg, Letterbox.fit(F.lit(256.0), F.lit(192.0), 160, 96))
    total = F.aggregate("rects", F.lit(0.0), lambda s, b: s + b["x0"] + b["y0"] + b["x1"] + b["y1"])
    n = F.when(F.col("rects").isNotNull(), F.size("rects"))
    return rounded(found.select("group_id", "frame", "camera", n.alias("n_regions"), F.when(n > 0, total).alias("total")))


@query(ctes("det") + f", {_VIEWS}, k AS (SELECT *, row_number() OVER (PARTITION BY group_id, frame ORDER BY {draw_sql(31, t.GROUP, 'CAST(frame AS BIGINT)', 'CAST(substr(camera, 2) AS BIGINT)')}, camera) AS r FROM v) SELECT group_id, frame, camera FROM k WHERE r = 1")
def tr15_camera_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.camera_subset(fixture(spark, sf_dir, "det").select("group_id", "frame", "camera").distinct(), 1, 31)


_FRAME = (t.GROUP, "CAST(frame AS BIGINT)")


@query(ctes("inst") + f", v AS (SELECT DISTINCT group_id, frame, 'c' || CAST(animal AS VARCHAR) AS camera FROM inst), k AS (SELECT *, row_number() OVER (PARTITION BY group_id, frame ORDER BY {draw_sql(41, *_FRAME, 'CAST(substr(camera, 2) AS BIGINT)')}, camera) AS r, CASE WHEN {draw_sql(43, *_FRAME)} < 0.2::DOUBLE THEN 1 ELSE 2 + floor({draw_sql(42, *_FRAME)} * 3) END AS most FROM v) SELECT group_id, frame, camera FROM k WHERE r <= most")
def tr15_camera_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two to four cameras a frame (the animals stand for them), and one alone in a fifth of the frames."""
    views = fixture(spark, sf_dir, "inst").select("group_id", "frame", F.concat(F.lit("c"), F.col("animal")).alias("camera")).distinct()
    return t.camera_subset(views, (2, 4), 41, 0.2)


@query(ctes("truth", "sess") + f", {_INDEX} SELECT group_id, animal, round(CASE WHEN split = 'train' THEN 1.0::DOUBLE + {draw_sql(32, t.GROUP, 'CAST(animal AS BIGINT)')} * 0.5::DOUBLE ELSE 1.25::DOUBLE END, 9) AS factor FROM ix")
def tr16_crop_inflate_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = draw(32, t.GROUP, "CAST(animal AS BIGINT)")
    return rounded(_index(spark, sf_dir).select("group_id", "animal", t.crop_inflate_draw(F.col("split"), 1.0, 1.5, u).alias("factor")), 9)


def _first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return w.first_labelled(fixture(spark, sf_dir, "truth").withColumn("win", F.floor(F.col("frame") / 16).cast("int")), "group_id", "animal", "bodypart", "win")


@query(ctes("truth") + f", f AS (SELECT group_id, animal, bodypart, CAST(floor(frame / 16.0) AS INTEGER) AS win, arg_min(x, CASE WHEN x IS NOT NULL THEN frame END) AS x FROM truth GROUP BY 1, 2, 3, 4) SELECT group_id, animal, bodypart, win, {draw_sql(33, t.GROUP, 'CAST(animal AS BIGINT)', 'CAST(win AS BIGINT)')} >= 0.3 AS kept, CASE WHEN {draw_sql(33, t.GROUP, 'CAST(animal AS BIGINT)', 'CAST(win AS BIGINT)')} >= 0.3 THEN x END AS x FROM f")
def tr17_build_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.build_prior(_first(spark, sf_dir), 0.3, 33).select("group_id", "animal", "bodypart", "win", "kept", "x")


_ITEM = (t.GROUP, "CAST(frame AS BIGINT)", "CAST(animal AS BIGINT)")
_NEAREST = "near AS (SELECT group_id, frame, animal, arg_min(other, k) AS neighbour FROM (SELECT a.group_id, a.frame, a.animal, b.animal AS other, row_number() OVER (PARTITION BY a.group_id, a.frame, a.animal ORDER BY round(avg(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2))), 9), b.animal) AS k FROM truth a JOIN (SELECT *, count(x) OVER (PARTITION BY group_id, frame, animal) AS usable FROM truth) b ON a.group_id = b.group_id AND a.frame = b.frame AND a.bodypart = b.bodypart AND a.animal <> b.animal WHERE a.x IS NOT NULL AND b.x IS NOT NULL AND b.usable >= 2 GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3)"
_BESIDE = "LEFT JOIN near m ON p.group_id = m.group_id AND p.frame = m.frame AND p.animal = m.animal LEFT JOIN truth o ON o.group_id = p.group_id AND o.frame = p.frame AND o.animal = m.neighbour AND o.bodypart = p.bodypart"


@query(
    ctes("truth")
    + f", o AS (SELECT *, CAST(floor({draw_sql(34, *_ITEM)} * 4) AS INTEGER) AS delay, row_number() OVER (PARTITION BY group_id, animal, bodypart ORDER BY frame) AS rn, count(*) OVER (PARTITION BY group_id, animal, bodypart) AS n FROM truth) "
    "SELECT o.group_id, o.frame, o.animal, o.bodypart, o.delay, CASE WHEN o.x IS NOT NULL THEN l.x END AS stale_x, CASE WHEN o.x IS NOT NULL THEN l.y END AS stale_y FROM o JOIN o l ON o.group_id = l.group_id AND o.animal = l.animal AND o.bodypart = l.bodypart AND l.rn = least(o.rn + o.delay, o.n)"
)
def tr18_corrupt_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each point's pose one to three rows later, by a draw."""
    own = fixture(spark, sf_dir, "truth")
    keys = ("group_id", "animal", "bodypart")
    d = F.floor(F.expr(draw_sql(34, t.GROUP, "CAST(frame AS BIGINT)", "CAST(animal AS BIGINT)")) * 4)
    for k in (1, 2, 3):
        own = w.stale_prior(own, k, *keys).withColumnsRenamed({"stale_x": f"sx{k}", "stale_y": f"sy{k}"})
    pick = lambda c: F.when(d == 0, F.col(c)).when(d == 1, F.col(f"s{c}1")).when(d == 2, F.col(f"s{c}2")).otherwise(F.col(f"s{c}3"))
    return own.select(*j.POINT, d.cast("int").alias("delay"), pick("x").alias("stale_x"), pick("y").alias("stale_y"))


@query(
    ctes("truth")
    + f", {_NEAREST}, p AS (SELECT *, {draw_sql(35, *_ITEM, t.PART)} AS u FROM truth), s AS (SELECT p.*, o.x AS nx, o.y AS ny, p.u < 0.2::DOUBLE AND o.x IS NOT NULL AS swapped FROM p {_BESIDE}) "
    "SELECT group_id, frame, animal, bodypart, CASE WHEN swapped THEN nx ELSE x END AS x, CASE WHEN swapped THEN ny ELSE y END AS y, swapped FROM s"
)
def tr19_corrupt_swap_animal(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = fixture(spark, sf_dir, "truth").select(*j.POINT, "x", "y")
    return t.corrupt_swap_animal(own, None, 0.2, 35)


@query(
    ctes("truth")
    + f", h AS (SELECT *, row_number() OVER (PARTITION BY group_id, frame, animal ORDER BY bodypart) - 1 AS r, count(*) OVER (PARTITION BY group_id, frame, animal) AS m, {draw_sql(36, *_ITEM, t.PART)} AS u, {draw_sql(37, *_ITEM, t.PART)} AS v FROM truth WHERE x IS NOT NULL), o AS (SELECT *, CASE WHEN u < 0.3::DOUBLE AND m > 1 THEN (r + CAST(floor(v * (m - 1)) AS BIGINT) + 1) % m ELSE r END AS target FROM h) "
    "SELECT o.group_id, o.frame, o.animal, o.bodypart, h.x, h.y, o.target <> o.r AS swapped FROM o JOIN h ON o.group_id = h.group_id AND o.frame = h.frame AND o.animal = h.animal AND h.r = o.target"
)
def tr20_corrupt_swap_keypoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.corrupt_swap_keypoints(fixture(spark, sf_dir, "truth").select(*j.POINT, "x", "y"), 0.3, 36)


def _normal_sql(seed: int, *more: str) -> str:
    return f"(sqrt(ln(greatest({draw_sql(seed, *_ITEM, *more)}, 1e-12::DOUBLE)) * -2) * cos({draw_sql(seed + 1, *_ITEM, *more)} * (2 * pi())))"


@query(
    ctes("truth") + f"SELECT group_id, frame, animal, bodypart, round(x + {_normal_sql(37)} * 4 + {_normal_sql(38, t.PART)}, 6) AS x, round(y + {_normal_sql(47)} * 4 + {_normal_sql(48, t.PART)}, 6) AS y FROM truth"
)
def tr21_corrupt_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = fixture(spark, sf_dir, "truth").select(*j.POINT, "x", "y")
    return rounded(t.corrupt_noise(t.corrupt_noise(own, 4.0, 37, per_item=True), 1.0, 38))


@query(
    ctes("truth") + f", {_NEAREST} SELECT p.group_id, p.frame, p.animal, m.neighbour, p.bodypart, round(coalesce(p.x + (o.x - p.x) * 0.25::DOUBLE, p.x), 6) AS x, round(coalesce(p.y + (o.y - p.y) * 0.25::DOUBLE, p.y), 6) AS y FROM truth p {_BESIDE}"
)
def tr22_oracle_corrupt(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = fixture(spark, sf_dir, "truth").select(*j.POINT, "x", "y")
    return rounded(t.oracle_corrupt_near(own, None, 0.25))


#: The kind of corruption of a clip, and its size.
_KINDS = (("off", 0.25), ("stale", 5), ("other", 0), ("near", 0), ("swap", 1))


@query(
    ctes("truth", "det")
    + f", {_NEAREST}, p AS (SELECT *, {t.GROUP} % 5 AS k FROM truth), items AS (SELECT DISTINCT group_id, frame, animal, k FROM p), a AS (SELECT group_id, animal, coalesce(lead(animal) OVER (PARTITION BY group_id ORDER BY animal), min(animal) OVER (PARTITION BY group_id)) AS after FROM (SELECT DISTINCT group_id, animal FROM truth)), "
    f"turned AS (SELECT group_id, frame, animal, {draw_sql(41, *_ITEM)} * (2 * pi()) AS angle FROM items), "
    "moved AS (SELECT i.group_id, i.frame, i.animal, CASE WHEN k = 1 THEN greatest(i.frame - 5, 0) ELSE i.frame END AS from_frame, CASE WHEN k = 2 THEN a.after WHEN k = 3 THEN coalesce(m.neighbour, i.animal) ELSE i.animal END AS from_animal, k FROM items i LEFT JOIN a USING (group_id, animal) LEFT JOIN near m USING (group_id, frame, animal)), "
    f"h AS (SELECT *, row_number() OVER (PARTITION BY group_id, frame, animal ORDER BY {draw_sql(42, *_ITEM, t.PART)}, bodypart) - 1 AS r, count(*) OVER (PARTITION BY group_id, frame, animal) // 2 * 2 AS m FROM p WHERE k = 4 AND x IS NOT NULL AND y IS NOT NULL), sw AS (SELECT b.group_id, b.frame, b.animal, b.bodypart, o.x, o.y FROM h b JOIN h o ON b.group_id = o.group_id AND b.frame = o.frame AND b.animal = o.animal AND o.r = xor(b.r, 1) WHERE b.r < least(2, b.m)) "
    "SELECT 'off' AS kind, p.group_id, p.frame, p.animal, p.bodypart, round(p.x + coalesce(cos(t.angle) * 0.25::DOUBLE * (x1 - x0 + y1 - y0) / 2, 0), 6) AS x, round(p.y + coalesce(sin(t.angle) * 0.25::DOUBLE * (x1 - x0 + y1 - y0) / 2, 0), 6) AS y FROM p JOIN turned t USING (group_id, frame, animal) LEFT JOIN det d ON d.group_id = p.group_id AND d.frame = p.frame AND d.det = p.animal WHERE k = 0 "
    "UNION ALL SELECT CASE m.k WHEN 1 THEN 'stale' WHEN 2 THEN 'other' ELSE 'near' END, m.group_id, m.frame, m.animal, s.bodypart, round(s.x, 6), round(s.y, 6) FROM moved m JOIN truth s ON s.group_id = m.group_id AND s.frame = m.from_frame AND s.animal = m.from_animal WHERE m.k IN (1, 2, 3) "
    "UNION ALL SELECT 'swap', p.group_id, p.frame, p.animal, p.bodypart, round(coalesce(sw.x, p.x), 6), round(coalesce(sw.y, p.y), 6) FROM p LEFT JOIN sw USING (group_id, frame, animal, bodypart) WHERE k = 4"
)
def tr22_oracle_corrupt_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every clip's poses by one kind: its number modulo five."""
    own = fixture(spark, sf_dir, "truth").select(*j.POINT, "x", "y")
    boxes = fixture(spark, sf_dir, "det").select("group_id", "frame", F.col("det").alias("animal"), *Box._fields)
    out = None
    for k, (kind, amount) in enumerate(_KINDS):
        points = own.where(F.expr(f"{t.GROUP} % {len(_KINDS)} = {k}"))
        one = t.oracle_corrupt(points, kind, amount, 41, boxes=boxes).withColumn("kind", F.lit(kind))
        out = one if out is None else out.unionByName(one)
    return rounded(out)


@query(ctes("truth", "sess") + f", {_INDEX}, r AS (SELECT group_id, animal, row_number() OVER (ORDER BY group_id, animal) - 1 AS row FROM ix), c AS (SELECT *, row // 4 AS chunk FROM r), k AS (SELECT *, dense_rank() OVER (ORDER BY {draw_sql(39, 'chunk')}, chunk) - 1 AS rk FROM c) SELECT group_id, animal, CAST(row_number() OVER (ORDER BY rk // 3, {draw_sql(40, 'row')}, row) - 1 AS INTEGER) AS position FROM k")
def tr23_block_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.block_shuffle(_index(spark, sf_dir), ["group_id", "animal"], 4, 3, 39)


@query(ctes("det") + ", r AS (SELECT *, x0 + (det * 17) % 60 AS rx0, x1 + (det * 17) % 60 AS rx1 FROM det), k AS (SELECT *, bool_and(least(rx1, x1) > greatest(rx0, x0)) OVER (PARTITION BY group_id, frame, det // 2) AS refined FROM r) SELECT group_id, frame, det // 2 AS animal, camera, refined, CASE WHEN refined THEN rx0 ELSE x0 END AS x0, y0, CASE WHEN refined THEN rx1 ELSE x1 END AS x1, y1 FROM k")
def tr24_refined_box_or_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    det = fixture(spark, sf_dir, "det")
    shift = (F.col("det") * 17) % 60
    own = det.withColumns({"animal": F.floor(F.col("det") / 2).cast("int"), "r_x0": F.col("x0") + shift, "r_x1": F.col("x1") + shift, "r_y0": F.col("y0"), "r_y1": F.col("y1")})
    return t.refined_box_or_fallback(own)


@query(ctes("truth") + ", l AS (SELECT group_id, max(frame) AS last FROM truth GROUP BY 1) SELECT group_id, animal, CAST(any_value(last) + 1 AS INTEGER) AS n_frames, round(sum(x), 6) AS sum_x, CAST(count(x) AS BIGINT) AS n FROM truth JOIN l USING (group_id) GROUP BY 1, 2")
def dn1_densify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summed up again from the nested arrays."""
    dense = t.densify(fixture(spark, sf_dir, "truth"), ["nose", "ear_l", "ear_r", "tail"])
    here = F.flatten(F.filter("pose", lambda r: r.isNotNull()))
    each = dense.select("group_id", "animal", F.size("pose").alias("n_frames"), F.aggregate(here, F.lit(0.0), lambda s, p: s + F.coalesce(p["x"], F.lit(0.0))).alias("sum_x"), F.size(F.filter(here, lambda p: p["x"].isNotNull())).alias("n"))
    return rounded(each.groupBy("group_id", "animal").agg(F.sum("n_frames").cast("int").alias("n_frames"), F.sum("sum_x").alias("sum_x"), F.sum("n").alias("n")))
