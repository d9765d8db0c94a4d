"""Set operations on axes, catalogues and rows, and the small string rules."""

from __future__ import annotations

import uuid
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinefold.operators.sampling import numbered
from kinefold.sources.tables import materialize


def union_axis(sessions: DataFrame) -> DataFrame:
    """All names in first-seen order: sessions (session_order, names array)."""
    each = sessions.select("session_order", F.posexplode("names").alias("pos", "name"))
    return each.groupBy("name").agg(F.min(F.struct("session_order", "pos")).alias("seen"))


def axis_diff(sessions: DataFrame, names: list[str]) -> DataFrame:
    """What each session's axis lacks of a reference, and whether it is merely reordered."""
    whole = F.array(*map(F.lit, names))
    missing = F.array_except(whole, F.col("names"))
    return sessions.withColumn("missing", missing).withColumn("reordered", (F.size("missing") == 0) & (F.col("names") != whole))


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of either side that the other lacks, duplicates counted."""
    return a.exceptAll(b).withColumn("side", F.lit("a")).unionByName(b.exceptAll(a).withColumn("side", F.lit("b")))


def union_sessions(catalogs: dict[str, DataFrame]) -> DataFrame:
    """Catalogues together; a session name that several roots have gets __<root> behind it on every side and in every split."""
    out = None
    for root, df in catalogs.items():
        one = df.withColumn("root", F.lit(root))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    roots = out.select("session_id", "root").distinct().groupBy("session_id").agg((F.count(F.lit(1)) > 1).alias("clash"))
    return out.join(roots, "session_id").withColumn("session_id", F.when(F.col("clash"), F.concat_ws("__", "session_id", "root")).otherwise(F.col("session_id"))).drop("clash")


def names_disagree(sessions: DataFrame) -> DataFrame:
    """Sessions (root, split, session_id, names) with other names than the first one has, in any order: what forbids a union of their roots."""
    place = F.struct("root", "split", "session_id")
    first = sessions.where("names is not null").agg(F.min_by(F.array_sort(F.array_distinct("names")), place).alias("_first"))
    return sessions.crossJoin(F.broadcast(first)).where(F.array_sort(F.array_distinct("names")) != F.col("_first")).drop("_first")


def animal_vocab(*tables: DataFrame) -> DataFrame:
    out = None
    for df in tables:
        one = df.select(F.col("animal").cast("string").alias("animal"))
        out = one if out is None else out.union(one)
    return out.distinct()


def repair_axis_order(names: Column) -> Column:
    """The permutation from the order of the names with - as _ (columns) to the order of the names, null if it changes nothing."""
    by_name, by_column = F.array_sort(names), F.array_sort(F.transform(names, lambda n: F.struct(F.replace(n, F.lit("-"), F.lit("_")).alias("k"), n.alias("n"))))
    perm = F.transform(by_name, lambda n: F.array_position(F.transform(by_column, lambda x: x["n"]), n).cast("int") - 1)
    identity = F.sequence(F.lit(0), F.size(names) - 1)
    return F.when(perm != identity, perm)


def split_of(path: Column, test: str, validation: str) -> Column:
    """test, val or train by patterns of the path."""
    return F.when(path.rlike(test), "test").when(path.rlike(validation), "val").otherwise("train")


def session_of(path: Column, plain: str = "movie") -> Column:
    """The file's stem, or its folder's name where the stem says nothing."""
    parts = F.split(path, "/")
    stem = F.regexp_replace(F.element_at(parts, -1), r"\.[^.]*$", "")
    return F.when(stem == plain, F.try_element_at(parts, F.lit(-2))).otherwise(stem)


def created_date(meta: Column, folder: Column) -> Column:
    """An ISO date of the metadata, or the folder's leading digits."""
    digits = F.regexp_extract(folder, r"^(\d{4})[-_]?(\d{2})[-_]?(\d{2})", 0)
    plain = F.regexp_replace(digits, r"[-_]", "")
    dated = F.when(digits != "", F.concat_ws("-", F.substring(plain, 1, 4), F.substring(plain, 5, 2), F.substring(plain, 7, 2)))
    return F.when(meta.rlike(r"^\d{4}-\d{2}-\d{2}"), F.substring(meta, 1, 10)).otherwise(dated)


def frame_key(key: Column) -> Column:
    """trial, frame and variant of <trial>/Frame_<N>[__<variant>]."""
    pattern = r"^(.*)/Frame_(\d+)(?:__(.+))?$"
    variant = F.regexp_extract(key, pattern, 3)
    return F.struct(F.regexp_extract(key, pattern, 1).alias("trial"), F.regexp_extract(key, pattern, 2).cast("int").alias("frame"), F.when(variant != "", variant).alias("variant"))


def local_names(registry: DataFrame) -> DataFrame:
    """Names without their dataset's prefix, if all of the dataset's names carry it."""
    prefix = F.concat("dataset", F.lit("-"))
    all_have = F.bool_and(F.startswith("name", prefix)).over(Window.partitionBy("dataset"))
    return registry.withColumn("local", F.when(all_have, F.expr("substring(name, length(dataset) + 2)")).otherwise(F.col("name")))


def source_frame(start: Column, step: Column, t: Column) -> Column:
    """Frame t of a clip in its source; not valid across cut gaps."""
    return start + t * step


def merge_provenance(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(root, key, value) rows as a map for each root, and the keys with several values, which are errors."""
    values = items.groupBy("root", "key").agg(F.min("value").alias("value"), F.countDistinct("value").alias("n"))
    maps = values.where("n = 1").groupBy("root").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("provenance"))
    return maps, values.where("n > 1").select("root", "key", "n")


def flip_involution(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both directions of each pair (a, b), and the names that break the rule: several partners, or oneself."""
    both = pairs.select("a", "b").union(pairs.select(F.col("b"), F.col("a"))).distinct()
    partners = both.groupBy("a").agg(F.countDistinct("b").alias("n"), F.bool_or(F.col("a") == F.col("b")).alias("self"))
    return both, partners.where("n > 1 or self")


def left_right_pairs(names: Column) -> Column:
    """Names that end in L with those that end in R instead."""
    lefts = F.filter(names, lambda n: F.endswith(n, F.lit("L")) & F.array_contains(names, F.concat(F.substring(n, F.lit(1), F.length(n) - 1), F.lit("R"))))
    return F.transform(lefts, lambda n: F.struct(n.alias("l"), F.concat(F.substring(n, F.lit(1), F.length(n) - 1), F.lit("R")).alias("r")))


class Registry(NamedTuple):
    """ids: dataset, name (as the registry has it), local (the dataset's own name), kpt_id. moved: datasets whose ids would change against the base (dataset, local, kpt_id, new_id), which are refused."""

    ids: DataFrame
    moved: DataFrame


def registry(names: DataFrame, base: DataFrame | None = None) -> Registry:
    """Append-only ids of (dataset, local): what the base has keeps its id, others follow in order.

    With several datasets, here or in the base, names carry the dataset before them. A dataset of the base whose ids would change (a
    prefix that appears, a name more or less) keeps the base's, and moved tells what would have changed.
    """
    spark = names.sparkSession
    empty = spark.createDataFrame([], "dataset string, name string, local string, kpt_id int")
    base = base.select("dataset", "name", "local", "kpt_id") if base is not None else empty
    own = names.select("dataset", "local").distinct()
    facts = own.agg(F.count_distinct("dataset").alias("n")).crossJoin(base.agg(F.count_distinct("dataset").alias("n_base"), F.coalesce(F.max("kpt_id"), F.lit(-1)).alias("top")))
    full = own.crossJoin(F.broadcast(facts)).withColumn("name", F.when((F.col("n") > 1) | (F.col("n_base") > 1), F.concat_ws("-", "dataset", "local")).otherwise(F.col("local")))
    known = base.groupBy("name").agg(F.min("kpt_id").alias("kpt_id"))
    held = full.join(known, "name")
    # Names that several datasets share without a prefix are one id.
    fresh = numbered(full.join(known, "name", "left_anti").groupBy("name").agg(F.min_by("dataset", F.struct("dataset", "local")).alias("by"), F.max("top").alias("top")), ["by", "name"], "place", 1)
    new = full.drop("top").join(fresh.select("name", (F.col("top") + F.col("place")).cast("int").alias("kpt_id")), "name")
    built = held.select("dataset", "name", "local", "kpt_id").unionByName(new.select("dataset", "name", "local", "kpt_id"))
    before = base.join(own.select("dataset").distinct(), "dataset", "left_semi").select("dataset", "local", F.col("kpt_id").alias("old"))
    again = built.join(base.select("dataset").distinct(), "dataset", "left_semi").select("dataset", "local", F.col("kpt_id").alias("new_id"))
    moved = again.join(before, ["dataset", "local"], "full").where("not (new_id <=> old)").select("dataset", "local", F.col("old").alias("kpt_id"), "new_id")
    ids = base.unionByName(built.join(base.select("dataset").distinct(), "dataset", "left_anti"))
    return Registry(ids, materialize(moved, "moved"))


def registry_build(names: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """The ids of registry() as dataset, name, kpt_id; an error where ids of the base would move. A base without local names has its names' own."""
    if base is not None and "local" not in base.columns:
        prefix = F.concat(F.col("dataset"), F.lit("-"))
        base = base.withColumn("local", F.when(F.startswith("name", prefix), F.substr("name", F.length(prefix) + 1)).otherwise(F.col("name")))
    found = registry(names.withColumnRenamed("name", "local"), base)
    wrong = found.moved.orderBy("dataset", "local").limit(3).collect()
    if wrong:
        raise ValueError("ids of the base would move: " + ", ".join(f"{r.dataset}/{r.local} {r.kpt_id} -> {r.new_id}" for r in wrong))
    return found.ids.select("dataset", "name", "kpt_id")


def registry_versions(spark: SparkSession, path: str) -> list[int]:
    """The versions of a registry below a path, oldest first."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [x.getPath().getName() for x in files.listStatus(place)] if files.exists(place) else []
    return sorted(int(x.removeprefix("version=")) for x in found if x.startswith("version="))


def read_registry(spark: SparkSession, path: str, version: int | None = None) -> DataFrame | None:
    """The latest version of a registry, or an older one; None where there is none."""
    found = registry_versions(spark, path)
    if not found:
        return None
    return spark.read.parquet(f"{path}/version={found[-1] if version is None else version}")


def commit_registry(ids: DataFrame, path: str, base: int | None) -> int:
    """Write ids as the version after base (None: the first), which is returned. The folder is written aside and renamed; who comes second finds the version taken and gets an error, nothing is overwritten. A claim without its version is left by a writer that died, and may be deleted."""
    spark = ids.sparkSession
    version = 0 if base is None else base + 1
    aside = f"{path}/_{uuid.uuid4().hex}"
    ids.select("dataset", "name", "local", "kpt_id").coalesce(1).write.parquet(aside)
    jvm, target = spark._jvm.org.apache.hadoop.fs, f"{path}/version={version}"
    files = jvm.Path(aside).getFileSystem(spark._jsc.hadoopConfiguration())
    claim = jvm.Path(f"{path}/_claim-{version}")
    taken = files.exists(jvm.Path(target)) or not files.createNewFile(claim)  # only one creates the claim
    if taken or not files.rename(jvm.Path(aside), jvm.Path(target)):
        files.delete(jvm.Path(aside), True)
        raise FileExistsError(f"{path}: version {version} is taken; read it and build again")
    return version
