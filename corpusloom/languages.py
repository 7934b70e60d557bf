"""The languages an engine knows: name, script, digits, names of splits' files. Others are added by ``register``."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession


class Language(NamedTuple):
    key: str
    name: str
    code: str
    script: str
    digits: str


_KNOWN = {x.key: x for x in (Language("hi", "Hindi", "hin", "Devanagari", "0123456789"), Language("ne", "Nepali", "nep", "Devanagari", "०१२३४५६७८९"))}


def register(language: Language) -> None:
    """Add a language, or replace the one of that key."""
    _KNOWN[language.key] = language


def get(key: str) -> Language:
    """By key, name or code, in any case."""
    for x in _KNOWN.values():
        if key.lower() in (x.key, x.name.lower(), x.code):
            return x
    raise KeyError(f"unknown language {key}; known are {', '.join(_KNOWN)}")


def table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(_KNOWN.values()), "key string, name string, code string, script string, digits string")
