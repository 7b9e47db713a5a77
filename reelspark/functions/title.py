"""Clean titles, speakers and keywords from file names and folders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bound

# Patterns and word lists of the title rules.
SEPARATORS = r"(?U)[_\-.\s]+"
YEAR = r"(?U)\b(19\d{2}|20\d{2})\b"
NOISE = r"(?iU)^(?:final|v\d+|ver\d+|cut|edit|export|render|x264|x265|h264|h265)$"
LOWERED = ["the", "a", "an", "and", "of", "to", "for", "in", "on"]
SMALL = ["and", "or", "the", "a", "an", "of", "to", "for", "in", "on", "with", "by"]
DROPPED_FOLDERS = ["my", "drive", "shared", "with", "me", "videos", "video", "media"]


def base_name(c: Column) -> Column:
    return F.element_at(F.split(c, "/"), -1)


def suffix(c: Column) -> Column:
    """Lower-case extension with its dot; none for names that only begin or end with one."""
    return F.lower(F.regexp_extract(base_name(c), r"(?s)^.+(\.[^.]+)$", 1))


def stem(c: Column) -> Column:
    return F.regexp_replace(base_name(c), r"(?s)(?<=.)\.[^.]+$", "")


def raw_name(c: Column) -> Column:
    return F.replace(stem(c), F.lit("__"), F.lit("_"))


def year(c: Column) -> Column:
    return F.regexp_extract(raw_name(c), YEAR, 1)


def tokens(c: Column) -> Column:
    """A file name's tokens without the noise words."""
    return F.filter(F.split(raw_name(c), SEPARATORS), lambda t: (t != "") & ~t.rlike(NOISE))


def normalized_name(words: Column) -> Column:
    joined = F.array_join(F.transform(words, F.lower), " ")
    return F.substring(F.btrim(F.regexp_replace(joined, "[^a-z0-9]+", " ")), 1, 512)


def speaker(words: Column) -> Column:
    """The first two capitalised words among the first four; one of them alone is split at its capitals."""
    named = F.filter(F.slice(words, 1, 4), lambda t: t.rlike(r"^\p{L}{3,}$") & t.rlike(r"^\p{Lu}"))
    one = F.get(named, F.lit(0))
    humps = F.regexp_extract_all(one, F.lit("[A-Z][a-z]+"), F.lit(0))
    joined = F.array_join(words, " ")
    pair = lambda k: F.regexp_extract(joined, r"(?U)\b([A-Z][a-z]+)([A-Z][a-z]+)\b", k)
    return (
        F.when(F.size(named) >= 2, F.concat_ws(" ", one, F.get(named, F.lit(1))))
        .when((F.size(named) == 1) & (F.size(humps) >= 2), F.array_join(F.slice(humps, 1, 3), " "))
        .when(F.size(named) == 1, one)
        .when(pair(1) != "", F.concat_ws(" ", pair(1), pair(2)))
        .otherwise("")
    )


def title_case(text: Column) -> Column:
    """Every word capitalised, small ones but the first in lower case."""
    words = F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")
    upper = lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substr(w, F.lit(2))))
    return F.array_join(F.transform(words, lambda w, i: F.when((i > 0) & F.lower(w).isin(SMALL), F.lower(w)).otherwise(upper(w))), " ")


def clean_title(name: Column, words: Column, year_: Column, speaker_: Column) -> Column:
    """The tokens left without year and speaker, in title case; the stem if under three letters remain."""
    given = F.struct(year_.alias("year"), F.when(speaker_ != "", F.split(F.lower(speaker_), " ")).otherwise(F.array().cast("array<string>")).alias("said"))
    rest = bound(given, lambda g: F.filter(words, lambda t: ~((g["year"] != "") & (t == g["year"])) & ~F.array_contains(g["said"], F.lower(t))))
    lowered = F.transform(rest, lambda t: F.when(F.lower(t).isin(LOWERED), F.lower(t)).otherwise(t))
    title = F.btrim(F.regexp_replace(F.btrim(title_case(F.array_join(lowered, " ")), F.lit(" -_")), r"(?U)\s{2,}", " "))
    plain = title_case(F.btrim(F.translate(stem(name), "_-", "  ")))
    return bound(title, lambda t: F.when(F.length(t) < 3, plain).otherwise(t))


def folder_keywords(folder: Column) -> Column:
    parts = F.transform(F.split(F.replace(folder, F.lit("/"), F.lit(" ")), SEPARATORS), F.lower)
    return F.slice(F.filter(parts, lambda t: ~t.isin(DROPPED_FOLDERS) & (F.length(t) >= 4)), 1, 10)


def keywords(words: Column, folder: Column) -> Column:
    long = F.filter(F.transform(words, F.lower), lambda t: F.length(t) >= 4)
    return F.slice(F.array_sort(F.array_union(folder_keywords(folder), long)), 1, 25)
