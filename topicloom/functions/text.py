"""Tokenising expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: a token is a run of anything but Unicode white space and these ASCII marks. White
#: space is spelt out, since \s means ASCII only to Spark and to other SQL engines.
TOKEN_PATTERN = r"""[^\s\x0b\x1c-\x1f\x85\p{Z}.,;:'"?!<>(){}\[\]\\/`~@#$%^&*|]+"""


def token_list(text: Column, *, pattern: str = TOKEN_PATTERN, lowercase: bool = True) -> Column:
    """array<string>: the tokens of text in order; null for null. Lower case comes after matching."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.transform(found, F.lower) if lowercase else found
