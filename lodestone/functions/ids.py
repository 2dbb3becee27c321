"""Identities: node ids, fingerprints and cache keys."""

from __future__ import annotations

import re
import unicodedata
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

ID_LENGTH = 120


def make_id(*parts: str | None) -> str:
    """An extractor's id of its parts: NFKC, word characters joined by single underscores, casefolded, ID_LENGTH at most."""
    joined = "_".join(p.strip("_.") for p in parts if p)
    words = re.sub(r"_+", "_", re.sub(r"\W+", "_", unicodedata.normalize("NFKC", joined)))
    return words.strip("_").casefold()[:ID_LENGTH]


def file_id(path: str) -> str:
    """The id of a file: its whole path without the extension."""
    head, dot, tail = path.replace("\\", "/").rpartition(".")
    return make_id(head if dot and "/" not in tail and not head.endswith("/") and head else path.replace("\\", "/"))


def normal_id(value: str) -> str:
    """The graph's form of an id; unlike make_id() it keeps any length."""
    text = unicodedata.normalize("NFKC", value)
    text = "".join(c if c.isalnum() or c in "_." else "_" for c in text).strip("_.")
    return re.sub(r"__+", "_", text.replace(".", "_")).casefold()


@F.pandas_udf(StringType())
def _normal_ids(ids: pd.Series) -> pd.Series:
    known: dict[str, str] = {}
    return ids.map(lambda x: None if x is None else known.setdefault(x, normal_id(x)))


def normalize_id(c: Column, ascii_only: bool = False) -> Column:
    """normal_id() of a column. ascii_only: the column holds nothing else, so no Python runs."""
    if not ascii_only:
        return _normal_ids(c)
    clean = F.regexp_replace(F.regexp_replace(c, "[^A-Za-z0-9_.]", "_"), "^[_.]+|[_.]+$", "")
    full = F.lower(F.regexp_replace(F.replace(clean, F.lit("."), F.lit("_")), "__+", "_"))
    # Nearly all ids are in normal form already: one look instead of four passes.
    return F.when(c.rlike("^[a-z0-9]+(?:_[a-z0-9]+)*$"), c).otherwise(full)


def incident_fingerprint(cls: Column, code: Column, subject: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", cls, code, subject), 256), 1, 16)


def cache_key(*parts: str) -> str:
    return sha256("::".join(parts).encode()).hexdigest()


def file_set_digest(paths: Column) -> Column:
    """Of a group's paths, whatever their order."""
    return F.sha2(F.array_join(F.sort_array(F.collect_set(paths)), "\0"), 256)
