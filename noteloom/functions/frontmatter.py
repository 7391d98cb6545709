"""YAML frontmatter to JSON: the one part of note parsing that needs Python, and it sees the YAML blocks alone."""

from __future__ import annotations

import json
import math
import re

import pandas as pd
import yaml
from pyspark.sql import functions as F
from pyspark.sql import types as T

_Base = getattr(yaml, "CSafeLoader", yaml.SafeLoader)


class CoreLoader(_Base):
    """Scalars resolve as in YAML 1.2's core schema; duplicate keys are errors."""

    yaml_implicit_resolvers: dict = {}

    def construct_mapping(self, node, deep=False):
        seen = set()
        for k, _ in node.value:
            key = self.construct_object(k, deep=True)
            if repr(key) in seen:
                raise yaml.YAMLError(f"duplicate key {key!r}")
            seen.add(repr(key))
        return super().construct_mapping(node, deep=True)


def _resolver(tag: str, pattern: str, first: str) -> None:
    CoreLoader.add_implicit_resolver(tag, re.compile(pattern), list(first))


_resolver("tag:yaml.org,2002:null", r"^(?:~|null|Null|NULL|)$", "~nN\0")
CoreLoader.yaml_implicit_resolvers.setdefault("", []).append(("tag:yaml.org,2002:null", re.compile(r"^$")))
_resolver("tag:yaml.org,2002:bool", r"^(?:true|True|TRUE|false|False|FALSE)$", "tTfF")
_resolver("tag:yaml.org,2002:int", r"^(?:[-+]?[0-9]+|0o[0-7]+|0x[0-9a-fA-F]+)$", "-+0123456789")
_resolver("tag:yaml.org,2002:float", r"^(?:[-+]?(?:\.[0-9]+|[0-9]+(?:\.[0-9]*)?)(?:[eE][-+]?[0-9]+)?|[-+]?\.(?:inf|Inf|INF)|\.(?:nan|NaN|NAN))$", "-+0123456789.")
CoreLoader.add_constructor("tag:yaml.org,2002:int", lambda loader, node: int(node.value, 16 if "x" in node.value else 8 if "o" in node.value else 10) if node.value[:2] in ("0x", "0o") else int(node.value))
CoreLoader.add_constructor("tag:yaml.org,2002:float", lambda loader, node: float(node.value.lower().replace(".inf", "inf").replace(".nan", "nan")))


def _plain(x):
    """As JSON would have it: keys are strings, whole floats integers, what is no number null."""
    if isinstance(x, dict):
        return {k if isinstance(k, str) else "" if k is None else json.dumps(_plain(k), ensure_ascii=False): _plain(v) for k, v in x.items()}
    if isinstance(x, (list, tuple, set)):
        return [_plain(v) for v in x]
    if isinstance(x, float):
        return None if not math.isfinite(x) else int(x) if x == int(x) and abs(x) < 1e21 else x
    return x if isinstance(x, (str, int, bool, type(None))) else str(x)


def parse_yaml(text: str | None) -> tuple[str | None, str | None, list[str]]:
    """(JSON object or null, title where it is a string, strings under tags). Errors and other values are null."""
    if text is None:
        return None, None, []
    try:
        value = yaml.load(text, Loader=CoreLoader)  # noqa: S506  (a safe loader)
    except Exception:  # any malformed block means no frontmatter
        return None, None, []
    if not isinstance(value, dict):
        return None, None, []
    value = _plain(value)
    tags = value.get("tags")
    tags = tags if isinstance(tags, list) else [tags]
    title = value.get("title")
    return json.dumps(value, ensure_ascii=False, separators=(",", ":")), title if isinstance(title, str) else None, [t for t in tags if isinstance(t, str)]


FRONT = T.StructType([T.StructField("json", T.StringType()), T.StructField("title", T.StringType()), T.StructField("tags", T.ArrayType(T.StringType()))])


@F.pandas_udf(FRONT)
def parse_frontmatter(block: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([parse_yaml(x) for x in block], columns=["json", "title", "tags"])
