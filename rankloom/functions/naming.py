"""Names of models and configurations, as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# How a word limit shows in a configuration's key, without and with one.
UNFILTERED, FILTERED = "nofilter", "filt%dw"
# Fixed value: what stands for the separator of a model's name where it is one path component.
SEPARATOR = "__"


def model_slug_of(name: Column) -> Column:
    """A model's name as one path component."""
    return F.array_join(F.split(name, "/"), SEPARATOR)


def short_name_of(name: Column) -> Column:
    """The last component of a model's name."""
    return F.substring_index(name, "/", -1)


def cache_key_of(country: Column, version: Column, query_length: Column, doc_length: Column, max_words: Column) -> Column:
    """Key of one configuration, which keeps its results apart from others."""
    limit = F.coalesce(F.format_string(FILTERED, max_words), F.lit(UNFILTERED))
    lengths = F.concat_ws("_", F.concat(F.lit("q"), query_length), F.concat(F.lit("d"), doc_length))
    return F.concat_ws("_", country, F.concat(F.lit("v"), version), lengths, F.when(max_words.isNull(), UNFILTERED).otherwise(limit))
