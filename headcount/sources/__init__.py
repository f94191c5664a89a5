"""Readers and writers."""

from headcount.sources.files import (
    CODEBOOK_SCHEMA,
    LOOKUP_SCHEMA,
    SURVEY_SCHEMA,
    TooManyRejects,
    codebook_levels,
    null_missing,
    read_codebook,
    read_lookup,
    read_survey,
    read_table,
    read_with_rejects,
    reject_counts,
    remove,
    write_result,
)
from headcount.sources.standin import soc_groups, soc_lookup, survey

__all__ = [
    "CODEBOOK_SCHEMA",
    "LOOKUP_SCHEMA",
    "SURVEY_SCHEMA",
    "TooManyRejects",
    "codebook_levels",
    "null_missing",
    "read_codebook",
    "read_lookup",
    "read_survey",
    "read_table",
    "read_with_rejects",
    "reject_counts",
    "remove",
    "soc_groups",
    "soc_lookup",
    "survey",
    "write_result",
]
