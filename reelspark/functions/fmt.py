"""Sizes, durations and media fields for people."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DASH = "—"
UNITS = ["B", "KB", "MB", "GB", "TB"]


def bytes_text(c: Column, least: str = "B", largest: str = "TB", null: str | None = DASH) -> Column:
    """Size with a binary unit and one decimal, halves to even; bytes whole; a dash for null. Sizes below the least unit
    and beyond the largest are given in that unit."""
    x, out = c.cast("double"), F.when(c.isNull(), null)
    for power in range(UNITS.index(least), UNITS.index(largest)):
        out = out.when(x < 1024.0 ** (power + 1), _in_unit(x, power))
    return out.otherwise(_in_unit(x, UNITS.index(largest)))


def _in_unit(x: Column, power: int) -> Column:
    if power == 0:
        return F.concat(F.format_string("%d", x.cast("long")), F.lit(" B"))
    return F.format_string(f"%.1f {UNITS[power]}", _even(x / 1024.0**power))


def _even(x: Column) -> Column:
    """One decimal, halves to even. A double less its whole part is exact, so large numbers have no false halves."""
    whole = F.floor(x)
    return (whole * 10 + F.rint((x - whole) * 10)) / 10


def duration_text(c: Column) -> Column:
    """h:mm:ss or m:ss of whole seconds; a dash for null."""
    s = c.cast("long")
    h, m = F.floor(s / 3600), F.floor(s % 3600 / 60)
    long = F.format_string("%d:%02d:%02d", h, m, s % 60)
    return F.when(c.isNull(), DASH).when(h > 0, long).otherwise(F.format_string("%d:%02d", m, s % 60))


def gcd(a: Column, b: Column) -> Column:
    """Greatest common divisor of two positive longs by Euclid: in 24 steps for numbers of 16 bits, as sizes of pictures
    are, else in the 92 that 63 bits need."""
    start = F.struct(a.alias("a"), b.alias("b"))
    steps = F.when(F.greatest(a, b) < 1 << 16, 24).otherwise(92)
    step = lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), (s["a"] % s["b"]).alias("b")))
    return F.aggregate(F.sequence(F.lit(1), steps), start, step, lambda s: s["a"])


PROBE = (
    "streams array<struct<codec_type string, codec_name string, width bigint, height bigint, avg_frame_rate string, r_frame_rate string>>, "
    "format struct<duration string, bit_rate string, format_name string>"
)


def parsed(rows: DataFrame, json: Column, name: str = "media") -> DataFrame:
    """rows with the catalogue's media columns of a probe document, as a struct. Parsing and arithmetic stand in
    generators over one element, which no projection is pushed through, so each is done once a row."""
    of = lambda doc, kind: F.get(F.filter(F.coalesce(doc["streams"], F.array()), lambda s: s["codec_type"] == kind), F.lit(0))
    parts = F.transform(F.array(F.from_json(json, PROBE)), lambda doc: F.struct(of(doc, "video").alias("video"), of(doc, "audio").alias("audio"), doc["format"].alias("format")))
    once = rows.select("*", F.explode(parts).alias(name))
    fields = F.transform(F.array(F.col(name)), media_fields)
    return once.select(*rows.columns, F.explode(fields).alias(name))


def media_fields(doc: Column) -> Column:
    """The media columns of (video, audio, format), as a struct."""
    video, audio, form = doc["video"], doc["audio"], doc["format"]
    w, h = video["width"], video["height"]
    sized = (w > 0) & (h > 0)
    rate = F.when(F.coalesce(video["avg_frame_rate"], F.lit("")) != "", video["avg_frame_rate"]).otherwise(video["r_frame_rate"])
    den = F.try_element_at(F.split(rate, "/", 2), F.lit(2)).try_cast("double")
    fps = F.when(rate.contains("/") & (den != 0), F.bround(F.split(rate, "/", 2)[0].try_cast("double") / den, 2))
    text = lambda c: F.coalesce(c, F.lit(""))
    ratio = F.transform(F.array(gcd(w, h)), lambda g: F.concat_ws(":", (w / g).cast("long").cast("string"), (h / g).cast("long").cast("string")))
    return F.struct(
        form["duration"].try_cast("double").alias("duration_seconds"), w.alias("width"), h.alias("height"),
        F.when(sized, F.concat_ws("x", w.cast("string"), h.cast("string"))).otherwise("").alias("resolution"),
        fps.alias("fps"), text(video["codec_name"]).alias("video_codec"), text(audio["codec_name"]).alias("audio_codec"),
        form["bit_rate"].try_cast("long").alias("bitrate"),
        F.when(sized, F.get(ratio, F.lit(0))).otherwise("").alias("aspect_ratio"),
        F.when(sized, F.when(h > w, "portrait").otherwise("landscape")).otherwise("").alias("orientation"),
        audio.isNotNull().alias("has_audio"), text(form["format_name"]).alias("container_format"),
    )
