"""Note parsing as column expressions: frontmatter block, links, tags, headings, digests, tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as in ECMAScript; Java's \s is narrower.
WS = "\\t\\n\\x0B\\f\\r\\x20\\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF"
FRONT = r"^---\r?\n([\s\S]*?)\r?\n---\r?\n?"
WIKILINK = r"\[\[([^\]\n|#]+)(?:[#|][^\]\n]*)?\]\]"
BODY_TAG = rf"(?:^|[{WS}])(#[A-Za-z0-9_一-龥/-]+)"
CJK = r"㐀-鿿"
HEADING_TYPE = "array<struct<level:int,text:string,line:int>>"


def trim_ws(x: Column) -> Column:
    return F.regexp_replace(x, rf"^[{WS}]+|[{WS}]+\z", "")


def split_frontmatter(text: Column) -> tuple[Column, Column]:
    """(yaml, body): yaml is null where there is no block, and body the whole text then."""
    block = F.regexp_extract(text, FRONT, 0)
    return F.when(text.rlike(FRONT), F.regexp_extract(text, FRONT, 1)), F.substring(text, F.length(block) + 1, F.length(text))


def extract_wikilinks(text: Column) -> Column:
    """Distinct targets in order of first sight."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(WIKILINK), F.lit(1)), trim_ws))


def normalize_tag(tag: Column) -> Column:
    return F.regexp_replace(trim_ws(tag), "^#+", "")


def extract_body_tags(text: Column) -> Column:
    """Tags of the text with their repeats; fenced code isn't skipped."""
    return F.filter(F.transform(F.regexp_extract_all(text, F.lit(BODY_TAG), F.lit(1)), normalize_tag), lambda t: t != "")


def frontmatter_tags(values: Column) -> Column:
    """values: the strings under `tags`, scalar or list; they are cut at commas."""
    return F.filter(F.flatten(F.transform(values, lambda v: F.transform(F.split(v, ","), normalize_tag))), lambda t: t != "")


def extract_headings(body: Column) -> Column:
    """ATX headings outside fenced code: level, text, line of the body from 1. One fold over the lines."""
    lines = F.transform(F.split(body, r"\r?\n", -1), lambda line, k: F.struct(line.alias("x"), (k + 1).alias("k")))
    fence_re, head_re = rf"^[{WS}]*(`{{3,}}|~{{3,}})", rf"^(#{{1,6}})[{WS}]+(.+?)[{WS}]*#*[{WS}]*\z"
    # only lines that can matter take part in the fold
    lines = F.filter(lines, lambda s: s["x"].contains("#") | s["x"].contains("`") | s["x"].contains("~"))
    start = F.struct(F.lit("").alias("fence"), F.array().cast(HEADING_TYPE).alias("out"))

    def step(acc: Column, s: Column) -> Column:
        marker = F.substring(F.regexp_extract(s["x"], fence_re, 1), 1, 1)
        fence = F.when(marker == "", acc["fence"]).when(acc["fence"] == marker, "").when(acc["fence"] == "", marker).otherwise(acc["fence"])
        is_head = (marker == "") & (acc["fence"] == "") & s["x"].rlike(head_re)
        head = F.struct(F.length(F.regexp_extract(s["x"], head_re, 1)).alias("level"), trim_ws(F.regexp_extract(s["x"], head_re, 2)).alias("text"), s["k"].alias("line"))
        return F.struct(fence.alias("fence"), F.when(is_head, F.concat(acc["out"], F.array(head))).otherwise(acc["out"]).alias("out"))

    return F.when(body.contains("#"), F.aggregate(lines, start, step, lambda acc: acc["out"])).otherwise(F.array().cast(HEADING_TYPE))


def base64url(hexed: Column) -> Column:
    """Of a digest in hex, without padding."""
    return F.rtrim(F.translate(F.base64(F.unhex(hexed)), "+/", "-_"), F.lit("="))


def path_digest(path: Column) -> Column:
    """base64url of the first 8 bytes of the path's SHA-256."""
    return base64url(F.substring(F.sha2(path, 256), 1, 16))


def tombstone_name(path: Column, etag: Column) -> Column:
    """base64url of SHA-256 over path, NUL, etag."""
    return base64url(F.sha2(F.concat(path, F.lit("\0"), etag), 256))


def chunk_id(document_id: Column, sha: Column, chunker: Column, model: Column, version: Column, ordinal: Column) -> Column:
    """First 32 characters of the digest over the length-prefixed identity, whose first part is a fixed value."""
    part = lambda x: F.concat(F.length(x.cast("string")).cast("string"), F.lit(":"), x.cast("string"))
    return F.substring(base64url(F.sha2(F.concat_ws("|", F.lit("mineral-vector-chunk-v1"), *map(part, (document_id, sha, chunker, model, version, ordinal))), 256)), 1, 32)


def accent_map() -> tuple[str, str]:
    """Latin, Greek and Cyrillic letters with one diacritic, and the same without; generated from their decompositions."""
    import unicodedata

    pairs = [(c, d[0]) for k in range(0xC0, 0x2000) if (d := unicodedata.normalize("NFD", c := chr(k))) != c and all(map(unicodedata.combining, d[1:]))]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def tokenize(text: Column) -> Column:
    """Letters and digits, lower-cased, without diacritics, in order."""
    a, b = accent_map()
    return F.filter(F.split(F.translate(F.lower(text), a, b), r"[^\p{L}\p{N}\p{Co}]+"), lambda t: t != "")
