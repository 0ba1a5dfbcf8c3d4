"""Recognised pages kept as a table, keyed by the PDF's hash, the profile's hash and the page."""

from __future__ import annotations

import hashlib
import json
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def profile_key(profile: dict) -> str:
    """Name and hash of a recognition profile; the name keeps letters, digits, points, dashes."""
    body = json.dumps(profile, sort_keys=True, separators=(",", ":"))
    name = re.sub(r"[^A-Za-z0-9._-]", "-", str(profile.get("name", "profile")))
    return f"{name}/{hashlib.sha256(body.encode()).hexdigest()}"


def cached_pages(requests: DataFrame, cache: DataFrame, profile: dict, trusted: bool) -> DataFrame:
    """Requests (pdf_sha256, page) with their kept text, null on a miss.  A cache within the corpus is read only if trusted."""
    key = F.lit(profile_key(profile))
    kept = cache.where(F.col("profile") == key).select("pdf_sha256", "page", "text", F.lit(True).alias("hit"))
    if not trusted:
        kept = kept.limit(0)
    return requests.join(kept, ["pdf_sha256", "page"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def store_pages(pages: DataFrame, profile: dict, path: str) -> None:
    """Append recognised pages (pdf_sha256, page, text) under a profile."""
    pages.select("pdf_sha256", "page", "text").withColumn("profile", F.lit(profile_key(profile))).write.mode("append").partitionBy("profile").parquet(path)
