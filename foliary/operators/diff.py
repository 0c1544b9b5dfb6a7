"""Comparison of two versions of a file set."""

from __future__ import annotations

import difflib
import fnmatch

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def digests(files: DataFrame) -> DataFrame:
    """`files` (path, content) with size and sha256 instead of the content."""
    raw = F.col("content").cast("binary")
    return files.select(*(c for c in files.columns if c != "content"), F.octet_length(raw).cast("long").alias("size"), F.sha2(raw, 256).alias("sha256"))


def compare(old: DataFrame, new: DataFrame, key: list[str] = ["path"]) -> DataFrame:  # noqa: B006
    """key, status: added, removed, modified or same."""
    a, b = old.select(*key, F.col("sha256").alias("old_sha")), new.select(*key, F.col("sha256").alias("new_sha"))
    status = F.when(F.col("old_sha").isNull(), "added").when(F.col("new_sha").isNull(), "removed").when(F.col("old_sha") != F.col("new_sha"), "modified").otherwise("same")
    return a.join(b, key, "full_outer").select(*key, status.alias("status"))


def counts(compared: DataFrame) -> DataFrame:
    return compared.groupBy("status").agg(F.count("*").alias("n"))


def ignored(files: DataFrame, globs: list[str]) -> DataFrame:
    """Files whose path matches none of the globs."""
    pattern = "|".join(fnmatch.translate(g).replace(r"\Z", "$").replace(r"\z", "$").replace("(?s:", "(?s:^") for g in globs)
    return files.where(~F.col("path").rlike(pattern)) if globs else files


#: Bytes that are looked at.
_SNIFFED = 8192


def is_text(content):
    """Whether a file counts as text: no zero byte in the first 8 KiB, which are valid UTF-8 but for a character that is cut at their end."""
    head = F.substring(content, 1, _SNIFFED)
    # A cut character is a lead byte with fewer bytes after it than it asks for.
    tail = F.hex(F.substring(head, F.greatest(F.octet_length(head) - 2, F.lit(1)), F.lit(3)))
    cut = F.when(F.octet_length(content) > _SNIFFED, F.length(F.regexp_extract(tail, "(?:[CDEF][0-9A-F]|E[0-9A-F](?:[89AB][0-9A-F])|F[0-9A-F](?:[89AB][0-9A-F]){1,2})$", 0)) / 2).otherwise(0).cast("int")
    whole = F.substring(head, F.lit(1), F.octet_length(head) - cut)
    zero = F.hex(head).rlike("^(?:[0-9A-F]{2})*?00")
    return ~zero & (F.is_valid_utf8(head) | F.is_valid_utf8(whole))


def unified(pairs: DataFrame, context: int = 3) -> DataFrame:
    """`pairs` (path, old, new) with diff, in the unified format. Line matching has no built-in form, hence Arrow batches."""

    @F.pandas_udf("string")
    def diff(path: pd.Series, old: pd.Series, new: pd.Series) -> pd.Series:
        made = [
            "\n".join(difflib.unified_diff((a or "").split("\n"), (b or "").split("\n"), f"old/{p}", f"new/{p}", lineterm="", n=context))
            for p, a, b in zip(path, old, new, strict=True)
        ]
        return pd.Series(made)

    return pairs.withColumn("diff", diff("path", "old", "new"))
