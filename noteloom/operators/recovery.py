"""Stored versions, deletion records and what can be recovered. Joins over the listing; bodies are never read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noteloom.functions import keys, text

TOMBSTONE = "protocol int, path string, deletedRemoteETag string, createdAt string, r2AcceptedAt string"
FIELDS = ["version_id", "path", "created_at", "deleted_etag", "content_etag", "content_type", "size", "original_modified", "reason", "state", "original_metadata_json", "original_http_metadata_json", "anomaly"]


def parse_manifest(body: Column) -> Column:
    """Restricted TOML to a map of strings: quoted strings, and a whole number for size. Null if a line is malformed or a field repeats."""
    lines = F.filter(F.split(body, r"\r?\n"), lambda x: (F.trim(x) != "") & ~F.trim(x).startswith("#"))
    name = lambda x: F.regexp_extract(x, r"^([a-z_]+)\s*=\s*(.*)\z", 1)
    raw = lambda x: F.regexp_extract(x, r"^([a-z_]+)\s*=\s*(.*)\z", 2)
    value = lambda x: F.when(raw(x).rlike(r'^"(?:[^"\\]|\\.)*"\s*\z'), F.get_json_object(F.concat(F.lit('{"v":'), raw(x), F.lit("}")), "$.v")).when((name(x) == "size") & raw(x).rlike(r"^(0|[1-9][0-9]*)\z"), raw(x))
    good = F.forall(lines, lambda x: (name(x) != "") & value(x).isNotNull()) & (F.size(F.array_distinct(F.transform(lines, name))) == F.size(lines)) & (F.octet_length(body) <= 128 * 1024)
    return F.when(good, F.map_from_arrays(F.transform(lines, name), F.transform(lines, value)))


def read_manifests(objects: DataFrame) -> DataFrame:
    """(key, etag, m): manifests under versions/, m null where one is malformed or invalid."""
    rows = objects.where(F.col("key").rlike(r"^\.mineral/versions/[^/]+/manifest\.toml\z")).select("key", "etag", parse_manifest(F.col("text")).alias("m"))
    return rows.withColumn("m", F.when(F.col("m").isNotNull() & keys.valid_manifest(F.col("m")), F.col("m")))


def read_tombstones(objects: DataFrame) -> DataFrame:
    """(key, etag, size, modified_ms, t, valid): a malformed record is never taken for a deletion."""
    here = F.col("key").startswith(keys.TOMBSTONES) | F.col("key").startswith(keys.OLD_TOMBSTONES)
    rows = objects.where(here).select("key", "etag", "size", "modified_ms", F.from_json("text", TOMBSTONE).alias("t"))
    named = F.concat(text.tombstone_name(F.col("t.path"), F.col("t.deletedRemoteETag")), F.lit(".json"))
    return rows.withColumn("valid", keys.valid_tombstone(F.col("t")) & F.coalesce(F.substring_index("key", "/", -1) == named, F.lit(False)))


def version_inventory(objects: DataFrame) -> DataFrame:
    """(kind, key, etag, path, created_at, size, reason, state) of every version group.

    Objects under versions/ are grouped by id. Only sums and the two objects of a sound group are kept, so a group of any size is one row.
    """
    under = objects.where(F.col("key").startswith(keys.VERSIONS)).withColumn("id", F.split(F.substring("key", len(keys.VERSIONS) + 1, 1 << 20), "/")[0])
    is_manifest = F.col("key") == F.concat(F.lit(keys.VERSIONS), F.col("id"), F.lit("/manifest.toml"))
    one = F.struct("key", "etag", "size", "modified_ms")
    groups = under.groupBy("id").agg(
        F.count("*").alias("n"), F.sum("size").alias("total"), F.min_by(one, F.when(is_manifest, F.col("key"))).alias("manifest"),
        F.min_by(one, F.when(~is_manifest, F.col("key"))).alias("body"), F.min("modified_ms").alias("modified_ms"),
    )
    groups = groups.withColumn("manifest", F.when(F.col("manifest.key") == F.concat(F.lit(keys.VERSIONS), F.col("id"), F.lit("/manifest.toml")), F.col("manifest")))
    m = read_manifests(objects).select(F.col("key").alias("__k"), "m")
    joined = groups.join(m, F.col("manifest.key") == F.col("__k"), "left")
    path, folder = F.col("m")["path"], F.concat(F.lit(keys.VERSIONS), F.col("id"), F.lit("/"))
    sound = (F.col("m")["version_id"] == F.col("id")) & (
        ((F.col("m")["state"] == "cleanup-pending") & (F.col("n") == 1))
        | ((F.col("n") == 2) & (F.col("body.key") == F.concat(folder, F.lit("content/"), path)) & (F.col("body.etag") == F.col("m")["content_etag"]) & (F.col("body.size") == F.col("m")["size"].try_cast("long")))
    )
    old_path = F.regexp_replace(F.col("body.key"), r"^\.mineral/versions/[^/]+/", "")
    legacy = F.col("manifest").isNull() & (F.col("n") == 1) & ~old_path.startswith("content/") & (old_path != "")
    kind = F.when(F.coalesce(sound, F.lit(False)), "version").when(F.coalesce(legacy, F.lit(False)), "legacy-version").otherwise("invalid")
    why = F.when(F.col("kind") != "invalid", F.lit(None)).when(F.col("manifest").isNull(), F.when(F.col("n") == 1, "content without manifest").otherwise("several objects without manifest")).when(F.col("m").isNull(), "malformed manifest").otherwise("content and manifest differ")
    iso = F.concat(F.date_format(F.timestamp_millis(F.col("modified_ms")), "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("Z"))
    pick = lambda v, o, x: F.when(F.col("kind") == "version", v).when(F.col("kind") == "legacy-version", o).otherwise(x)
    return joined.withColumn("kind", kind).select(
        "kind", pick(F.col("manifest.key"), F.col("body.key"), F.concat(folder, F.lit("manifest.toml"))).alias("key"), F.coalesce(F.when(F.col("kind") == "legacy-version", F.col("body.etag")), F.col("manifest.etag"), F.lit("")).alias("etag"),
        pick(path, old_path, F.col("id")).alias("path"), pick(F.col("m")["created_at"], iso, iso).alias("created_at"), pick(F.col("m")["size"].try_cast("long"), F.col("body.size"), F.col("total")).alias("size"),
        pick(F.col("m")["reason"], F.lit("migration"), F.lit("migration")).alias("reason"), pick(F.col("m")["state"], F.lit("legacy-version"), F.lit("invalid")).alias("state"), F.when(F.col("kind") == "version", F.col("m")["deleted_etag"]).alias("deleted_etag"), why.alias("error"),
    )


def tombstone_inventory(objects: DataFrame) -> DataFrame:
    """(kind, key, etag, path, created_at, size, recoverable, state): size and recovery come from a kept version of that deletion, else from the live object if it still has that etag."""
    rows = read_tombstones(objects)
    v = version_inventory(objects).where("kind = 'version'").groupBy(F.col("path").alias("__p"), F.col("deleted_etag").alias("__e")).agg(F.first("size").alias("__vs"))
    live = objects.select(F.col("key").alias("__lp"), F.col("etag").alias("__le"), F.col("size").alias("__ls"))
    joined = rows.join(v, (F.col("t.path") == F.col("__p")) & (F.col("t.deletedRemoteETag") == F.col("__e")), "left").join(live, (F.col("t.path") == F.col("__lp")) & (F.col("t.deletedRemoteETag") == F.col("__le")), "left")
    ok = F.col("valid")
    state = F.when(~ok, "invalid").when(F.col("key").startswith(keys.TOMBSTONES), "tombstone").otherwise("legacy-read-only")
    return joined.select(
        F.when(ok, "tombstone").otherwise("invalid").alias("kind"), "key", "etag", F.when(ok, F.col("t.path")).otherwise(F.col("key")).alias("path"), F.when(ok, F.col("t.createdAt")).alias("created_at"),
        F.when(ok, F.coalesce("__vs", "__ls", F.lit(-1))).otherwise(F.col("size")).alias("size"), (ok & F.col("__vs").isNull() & F.col("__ls").isNotNull()).alias("recoverable"), state.alias("state"),
    )


def recovery_list(objects: DataFrame) -> DataFrame:
    cols = ["kind", "key", "etag", "path", "created_at", "size", "state"]
    return version_inventory(objects).select(cols).unionByName(tombstone_inventory(objects).select(cols)).orderBy(F.desc("created_at"), "key")


def _retired(objects: DataFrame) -> DataFrame:
    return read_tombstones(objects).where("valid").select(F.col("t.path").alias("__p"), F.col("t.deletedRemoteETag").alias("__e")).distinct()


def logically_deleted(objects: DataFrame) -> DataFrame:
    """Live objects whose exact (path, etag) is retired; a file uploaded anew isn't hidden."""
    return objects.join(_retired(objects), (F.col("key") == F.col("__p")) & (F.col("etag") == F.col("__e")), "left_semi")


def pending_deletes(objects: DataFrame) -> DataFrame:
    m = F.col("m")
    return read_manifests(objects).where((m["reason"] == "delete") & (m["state"] == "delete-pending")).select("key", m["path"].alias("path"), m["deleted_etag"].alias("deleted_etag"))


def delete_outcomes(tasks: DataFrame, objects: DataFrame) -> DataFrame:
    """tasks: (path, etag, modified_ms, backed_up). Adds state: deleted if the object is gone, conflict (anomaly for backed-up deletes) if it changed, else delete-pending.

    Backed-up deletes compare times to the second.
    """
    now = objects.select(F.col("key").alias("__p"), F.col("etag").alias("__e"), F.col("modified_ms").alias("__m"))
    joined = tasks.join(now, F.col("path") == F.col("__p"), "left")
    moved = F.when(F.col("backed_up"), F.floor(F.col("__m") / 1000) != F.floor(F.col("modified_ms") / 1000)).otherwise(F.col("__m") != F.col("modified_ms"))
    state = F.when(F.col("__p").isNull(), "deleted").when((F.col("__e") != F.col("etag")) | moved, F.when(F.col("backed_up"), "anomaly").otherwise("conflict")).otherwise("delete-pending")
    return joined.select(*tasks.columns, state.alias("state"))


def absent_keys(wanted: DataFrame, objects: DataFrame) -> DataFrame:
    return wanted.join(objects.select("key"), "key", "left_anti")
