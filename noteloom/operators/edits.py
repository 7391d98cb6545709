"""Bulk writes over a listing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def apply_writes(objects: DataFrame, edits: DataFrame, mode: str, separator: str = "\n\n", create_if_missing: bool = True) -> DataFrame:
    """(key, text, outcome) of every edit. edits: (key, new_text), one row a key.

    create writes new keys only; overwrite replaces or creates; append adds to the end, after the separator unless the old text ends with a
    newline.
    """
    old = objects.select("key", F.coalesce("text", F.lit("")).alias("__old"), F.lit(True).alias("__there"))
    both = edits.join(old, "key", "left")
    there = F.coalesce("__there", F.lit(False))
    if mode == "create":
        text, outcome = F.when(there, F.col("__old")).otherwise(F.col("new_text")), F.when(there, "exists").otherwise("created")
    elif mode == "overwrite":
        text, outcome = F.col("new_text"), F.when(there, "replaced").otherwise("created")
    elif mode == "append":
        joined = F.concat("__old", F.when(F.col("__old").endswith("\n"), "").otherwise(separator), "new_text")
        new = F.col("new_text") if create_if_missing else F.lit(None).cast("string")
        text, outcome = F.when(there, joined).otherwise(new), F.when(there, "appended").otherwise("created" if create_if_missing else "missing")
    else:
        raise ValueError(mode)
    return both.select("key", text.alias("text"), outcome.alias("outcome"))
