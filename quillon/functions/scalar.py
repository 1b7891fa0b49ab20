"""Scalar functions of the library: hashes, media types, value scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Decay per second for half-lives of 7 hours, 70 days and 2 years.
DECAY = {"fast": 0.6931471805599453 / (7 * 3600), "normal": 0.6931471805599453 / (70 * 86400), "slow": 0.6931471805599453 / (2 * 365 * 86400)}
#: Media type by file extension.
MEDIA = {
    "jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "gif": "image/gif", "webp": "image/webp", "svg": "image/svg+xml",
    "mp4": "video/mp4", "webm": "video/webm", "avi": "video/x-msvideo", "mov": "video/quicktime", "mp3": "audio/mpeg", "wav": "audio/wav", "ogg": "audio/ogg",
    "flac": "audio/flac", "pdf": "application/pdf", "txt": "text/plain", "html": "text/html", "json": "application/json", "csv": "text/csv",
}


def content_hash(c: Column | str) -> Column:
    return F.sha2(c, 256)


def media_type(path: Column | str) -> Column:
    p = F.col(path) if isinstance(path, str) else path
    ext = F.lower(F.regexp_extract(p, r"\.([A-Za-z0-9]+)$", 1))
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in MEDIA.items() for x in kv]), ext), F.lit("application/octet-stream"))


def current_score(score: Column, decay: Column | float, last_us: Column, as_of_us: Column | int) -> Column:
    """score * exp(-decay * seconds since the last activation), within 0 and 1."""
    age = F.greatest((F.lit(as_of_us) - last_us) / 1e6, F.lit(0.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score * F.exp(-F.lit(decay) * age)))


def activated(score: Column, delta: float) -> Column:
    return F.least(F.lit(1.0), score + delta)


def assessed(df: DataFrame, has_class: bool = True) -> Column:
    """0.5, and 0.2 if any text is longer than 20 characters, a tenth of the share of filled columns, 0.1 if the row as
    JSON has 50 to 50,000 characters (ends excluded), and 0.1 if the row has a class."""
    texts = [c for c, t in df.dtypes if t == "string"]
    long = F.greatest(*[F.coalesce(F.length(c), F.lit(0)) for c in texts], F.lit(0)) > 20
    filled = sum((F.when(F.col(c).isNotNull(), 1.0).otherwise(0.0) for c in df.columns), F.lit(0.0)) / len(df.columns)
    size = F.length(F.to_json(F.struct("*")))
    return F.lit(0.5) + F.when(long, 0.2).otherwise(0.0) + 0.1 * filled + F.when((size > 50) & (size < 50_000), 0.1).otherwise(0.0) + (0.1 if has_class else 0.0)
