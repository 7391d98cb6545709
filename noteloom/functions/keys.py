"""Key, path, event and record predicates as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Fixed values of the storage layout and of the protocols.
SYSTEM = [".mineral/", ".mineral-sync/", ".system/", ".history/", ".trash/"]
VERSIONS, OLD_VERSIONS = ".mineral/versions/", [".history/", ".trash/"]
TOMBSTONES, OLD_TOMBSTONES = ".mineral/tombstones/", ".mineral-sync/tombstones/"
SOURCES = ["mcp", "web", "obsidian", "system"]
MIME = {
    "md": "text/markdown", "markdown": "text/markdown", "mdx": "text/markdown", "txt": "text/plain", "json": "application/json", "csv": "text/csv",
    "html": "text/html", "htm": "text/html", "css": "text/css", "js": "text/javascript", "xml": "application/xml", "yaml": "text/yaml", "yml": "text/yaml",
    "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "webp": "image/webp", "svg": "image/svg+xml", "pdf": "application/pdf",
    "zip": "application/zip", "mp3": "audio/mpeg", "mp4": "video/mp4", "wav": "audio/wav",
}


def ascii_fold(x: Column) -> Column:
    """Lower case for A-Z only, the folding of an ASCII-insensitive LIKE."""
    return F.translate(x, UPPER, LOWER)


def has_prefix(key: Column, prefix: str) -> Column:
    """Key starts with the literal prefix, whatever the case of A-Z."""
    return ascii_fold(key).startswith(prefix.translate(str.maketrans(UPPER, LOWER))) if prefix else F.lit(True)


def contains(x: Column, part: str) -> Column:
    """x contains the literal part, whatever the case of A-Z."""
    return ascii_fold(x).contains(part.translate(str.maketrans(UPPER, LOWER)))


def is_text_key(key: Column) -> Column:
    return F.lower(key).rlike(r"\.(md|txt|markdown|mdx)\z")


def is_text_content_type(kind: Column) -> Column:
    base = F.lower(F.trim(F.split(kind, ";")[0]))
    return base.startswith("text/") | base.isin("application/json", "application/javascript", "application/xml") | base.endswith("+json") | base.endswith("+xml")


def is_system_key(key: Column) -> Column:
    found = F.lit(False)
    for p in SYSTEM:
        found = found | key.startswith(p) | (key == p[:-1])
    return found


def is_indexable(key: Column) -> Column:
    """A note: a text key, outside the system folders, and no .ui.md panel."""
    return is_text_key(key) & ~is_system_key(key) & ~key.endswith(".ui.md")


def key_error(key: Column) -> Column:
    """The first rule a key breaks, or null."""
    return (
        F.when(key.isNull() | (F.trim(key) == ""), "blank")
        .when(key.contains(".."), "contains ..")
        .when(key.startswith("/") | key.endswith("/"), "leading or trailing /")
        .when(key.contains("//"), "contains //")
    )


def strip_extension(key: Column) -> Column:
    return F.regexp_replace(key, r"(?i)\.(md|markdown|mdx|txt)\z", "")


def basename(key: Column) -> Column:
    return F.element_at(F.split(key, "/"), -1)


def canonical_path(path: Column) -> Column:
    """Backslashes become slashes and leading slashes go; null if what is left is no canonical path."""
    p = F.regexp_replace(F.translate(path, "\\", "/"), "^/+", "")
    return F.when(_canonical(p), p)


def _canonical(p: Column) -> Column:
    return (p != "") & ~p.contains("\0") & (F.length(p) <= 4096) & ~F.exists(F.split(p, "/"), lambda s: s.isin("", ".", ".."))


def is_canonical_path(path: Column) -> Column:
    return F.coalesce(_canonical(path) & ~path.contains("\\"), F.lit(False))


def normalize_prefix(prefix: Column) -> Column:
    """Empty, or a canonical path with one slash at its end; null if it is neither."""
    p = F.regexp_replace(F.translate(prefix, "\\", "/"), "^/+|/+$", "")
    return F.when(p == "", F.lit("")).when(_canonical(p), F.concat(p, F.lit("/")))


def object_key(prefix: Column, path: Column) -> Column:
    return F.concat(normalize_prefix(prefix), canonical_path(path))


def vault_key(prefix: Column, key: Column) -> Column:
    """The path of an object under the prefix, or null."""
    p = normalize_prefix(prefix)
    return F.when(key.startswith(p), canonical_path(F.substring(key, F.length(p) + 1, F.length(key))))


def version_key(version: Column, path: Column) -> Column:
    return F.concat(F.lit(VERSIONS), version, F.lit("/content/"), path)


def version_source_path(key: Column) -> Column:
    """The path a version object keeps, old layouts included; null for manifests and other keys."""
    old = F.regexp_extract(key, r"^(?:\.history|\.trash)/[^/]+/([\s\S]+)\z", 1)
    new = F.regexp_extract(key, r"^\.mineral/versions/[^/]+/([\s\S]+)\z", 1)
    return F.when(old != "", old).when((new != "") & (new != "manifest.toml"), F.regexp_replace(new, "^content/(?=.)", ""))


def top_folder(key: Column) -> Column:
    return F.when(key.contains("/"), F.substring_index(key, "/", 1)).otherwise("(root)")


def ancestors(key: Column) -> Column:
    """Every folder above a key, from the top: a, a/b for a/b/c.md."""
    parts = F.split(key, "/")
    return F.transform(F.when(F.size(parts) > 1, F.sequence(F.lit(1), F.size(parts) - 1)).otherwise(F.array().cast("array<int>")), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def date_from_key(key: Column) -> Column:
    """The first date in a key, as YYYY-MM-DD, or null."""
    p = r"(\d{4})-?(\d{2})-?(\d{2})"
    return F.when(key.rlike(p), F.concat_ws("-", *(F.regexp_extract(key, p, k) for k in (1, 2, 3))))


def content_type(key: Column) -> Column:
    """By extension; text kinds carry their charset."""
    ext = F.lower(F.regexp_extract(key, r"\.([A-Za-z0-9]+)\z", 1))
    kinds = F.create_map(*[F.lit(x) for k, v in MIME.items() for x in (k, v)])
    found = F.coalesce(F.try_element_at(kinds, ext), F.lit("application/octet-stream"))
    return F.when(is_text_content_type(found), F.concat(found, F.lit("; charset=utf-8"))).otherwise(found)


def normalize_etag(etag: Column) -> Column:
    """Without one pair of quotes around it."""
    return F.when(etag.rlike(r'^"[\s\S]*"\z') & (F.length(etag) >= 2), F.regexp_replace(etag, r'^"([\s\S]*)"\z', "$1")).otherwise(etag)


def event_error(e: dict[str, Column]) -> Column:
    """Why a mutation event is no fact, or null. e: its columns by name."""
    return (
        F.when(e["mutation_id"].isNull() | ~F.length(e["mutation_id"]).between(1, 128), "id")
        .when(~F.coalesce(e["source"].isin(SOURCES), F.lit(False)), "source")
        .when(e["committed_at"].isNull() | (e["committed_at"] < 0), "committed_at")
        .when(key_error(e["path"]).isNotNull(), "path")
        .when(~F.coalesce(e["op"].isin("put", "delete", "rename"), F.lit(False)), "op")
        .when((e["op"] == "put") & ~(F.coalesce(F.length(e["etag"]).between(1, 256), F.lit(False)) & F.coalesce(e["size"] >= 0, F.lit(False))), "revision")
        .when((e["op"] == "rename") & key_error(e["from_path"]).isNotNull(), "from")
    )


def valid_report(e: dict[str, Column]) -> Column:
    """A report has an event's shape, without a source, and is a put or a delete."""
    return event_error(e | {"source": F.lit("web")}).isNull() & e["op"].isin("put", "delete")


def ingress_allowed(source: Column, committed: bool = False) -> Column:
    """Who may report from outside; on the committed path, who may commit."""
    return source.isin(["mcp", "web", "system"] if committed else ["obsidian", "web"])


def valid_tombstone(t: Column) -> Column:
    """t: struct (protocol, path, deletedRemoteETag, createdAt, r2AcceptedAt)."""
    when = lambda x: F.try_to_timestamp(x).isNotNull()
    ok = (t["protocol"] == 1) & is_canonical_path(t["path"]) & ~is_system_key(t["path"]) & (t["deletedRemoteETag"] != "") & when(t["createdAt"]) & (t["r2AcceptedAt"].isNull() | when(t["r2AcceptedAt"]))
    return F.coalesce(ok, F.lit(False))


def valid_manifest(m: Column) -> Column:
    """m: map of the manifest's fields as strings."""
    when = lambda x: F.try_to_timestamp(x).isNotNull()
    ok = (m["content_etag"] != "") & (m["deleted_etag"] != "") & m["size"].rlike(r"^(0|[1-9]\d*)\z") & when(m["created_at"]) & when(m["original_modified"]) & is_canonical_path(m["path"])
    ok = ok & m["reason"].isin("backup", "delete", "migration") & m["state"].isin("backup", "delete-pending", "deleted", "anomaly", "migration", "cleanup-pending")
    return F.coalesce(ok, F.lit(False))


def relative_time(ts: Column, now: Column) -> Column:
    """How long ago, in the largest whole unit. Both are seconds since 1970."""
    age = F.greatest(now - ts, F.lit(0))
    out = F.concat(F.floor(age).cast("string"), F.lit("秒前"))
    for least, unit in ((60, "分钟前"), (3600, "小时前"), (86400, "天前"), (2592000, "个月前"), (31536000, "年前")):
        out = F.when(age >= least, F.concat(F.floor(age / least).cast("string"), F.lit(unit))).otherwise(out)
    return out
