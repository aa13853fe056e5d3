"""Redaction of key/value settings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from twinrun.functions.strings import column

# Words that mark a key as secret, and the texts put in place of its value.
SECRET_WORDS = ("SECRET", "PASSWORD", "TOKEN", "KEY", "CREDENTIAL", "AUTH", "PRIVATE")
REDACTED = "(redacted)"
NOT_SET = "(not set)"


def is_secret(key: Column | str, whole_words: bool = False) -> Column:
    """Whether a key names a secret. Any substring counts (``AUTHOR`` and ``MONKEY`` too) unless ``whole_words``.

    Whole words end at anything but a letter and where camel case begins a word; a plural counts as its word.
    """
    words = "|".join(SECRET_WORDS)
    if not whole_words:
        return F.upper(column(key)).rlike(words)
    # authToken -> auth_Token, APIKey -> API_Key
    split = F.regexp_replace(column(key), r"(?<=\p{Ll})(?=\p{Lu})|(?<=\p{Lu})(?=\p{Lu}\p{Ll})", "_")
    return F.upper(split).rlike(rf"(?<!\p{{L}})(?:{words})S?(?!\p{{L}})")


def redact(key: Column | str, value: Column | str, whole_words: bool = False) -> Column:
    """The value, or a placeholder when the key names a secret."""
    value = column(value)
    hidden = F.when(F.coalesce(value, F.lit("")) == "", NOT_SET).otherwise(REDACTED)
    return F.when(is_secret(key, whole_words), hidden).otherwise(value)


def redact_map(settings: Column | str, whole_words: bool = False) -> Column:
    """``redact`` over every entry of a MAP<STRING, STRING>."""
    return F.transform_values(column(settings), lambda k, v: redact(k, v, whole_words))
