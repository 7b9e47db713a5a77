"""Text: blanks, ASCII folding, patterns, keys and lists."""

from __future__ import annotations

import sys
import unicodedata

from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of the package

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def is_blank(c: Column) -> Column:
    """Null or empty; white space isn't blank."""
    return c.isNull() | (c == "")


def fold(c: Column) -> Column:
    """ASCII letters in lower case, others as they are."""
    return F.translate(c, UPPER, UPPER.lower())


def like(c: Column, pattern: str) -> Column:
    """LIKE that folds ASCII only and has no escape character."""
    folded = "".join(x.lower() if x in UPPER else x for x in pattern)
    return fold(c).like(folded.replace("\\", "\\\\"))


def first_of(*columns: Column) -> Column:
    """The first that is neither null nor empty, else empty."""
    return F.coalesce(*(F.when(~is_blank(c), c) for c in columns), F.lit(""))


def stripped(c: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def collapse(c: Column) -> Column:
    """Trimmed, runs of white space as one space."""
    return F.btrim(F.regexp_replace(c, r"(?U)\s+", " "))


def term_key_of(text: str) -> str:
    return " ".join(text.casefold().split())


def label_key_of(text: str) -> str:
    parts = unicodedata.normalize("NFKD", text.casefold())
    return " ".join("".join(x for x in parts if not unicodedata.combining(x)).split())


def _keys(one):
    """An Arrow UDF of a function on texts."""
    return F.pandas_udf(lambda texts: texts.map(one, na_action="ignore"), T.StringType())


PLAIN = r"^[\x00-\x1b\x20-\x7f]*$"


def label_key(c: Column) -> Column:
    """Label identity: case folded, marks stripped, white space collapsed. ASCII needs no Python; the rest goes
    through an Arrow UDF, as no built-in decomposes characters."""
    return F.when(c.rlike(PLAIN), F.lower(collapse(c))).otherwise(_keys(label_key_of)(F.when(~c.rlike(PLAIN), c)))


def term_key(c: Column) -> Column:
    """Term identity: case folded, white space collapsed; marks count."""
    return F.when(c.rlike(PLAIN), F.lower(collapse(c))).otherwise(_keys(term_key_of)(F.when(~c.rlike(PLAIN), c)))


def bound(value: Column, f) -> Column:
    """f(value), value being computed once a row however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def distinct_by(items: Column, key) -> Column:
    """The array without later elements whose key an earlier one has; order kept."""
    return F.aggregate(
        items, F.slice(items, 1, 0),
        lambda kept, x: F.when(F.exists(kept, lambda k: key(k) == key(x)), kept).otherwise(F.concat(kept, F.array(x))),
    )


def split_terms(c: Column) -> Column:
    """A text list as an array: split at newline, | and ;, trimmed of spaces and commas, first spelling kept."""
    parts = F.filter(F.transform(F.split(c, r"[\n|;]"), lambda x: collapse(F.btrim(x, F.lit(" ,\t\r")))), lambda x: x != "")
    return distinct_by(parts, lambda x: F.lower(x))


def is_email(c: Column) -> Column:
    return email_key(c).rlike(r"^[^@\s]+@[^@\s]+\.[^@\s]+$")


def folder_id(c: Column) -> Column:
    """The folder id of a link, or the text itself where it is no link; null for other links."""
    return (
        F.when(~c.contains("drive.google.com") & ~c.contains("http"), c)
        .when(c.contains("/folders/"), F.regexp_extract(c, r"(?s)/folders/([^?/]*)", 1))
        .when(c.contains("id="), F.regexp_extract(c, r"(?s)id=([^&]*)", 1))
    )


def safe_name(c: Column) -> Column:
    return F.regexp_replace(c, r"[^A-Za-z0-9._-]", "_")


def email_key(c: Column) -> Column:
    """An e-mail address as accounts are told apart by."""
    return F.lower(stripped(c))
