"""Which files are indexed, decided on metadata alone: contents aren't read for it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions.text import extension, filename

TEMP, COMPRESSED, OVERSIZED, UNSUPPORTED = "TEMP_FILE", "COMPRESSED_FILE", "OVERSIZED_FILE", "UNSUPPORTED"


def skip_reason(name: Column, length: Column, config: Config = Config()) -> Column:
    """The first reason to skip a file, or null: temporary, compressed, too large, no extractor."""
    low = F.lower(name)
    temporary = F.lit(False)
    for mark in config.temporary:
        temporary = temporary | low.startswith(mark) | low.endswith(mark)
    ext = extension(name)
    return (
        F.when(temporary, TEMP)
        .when(ext.isin(*config.compressed), COMPRESSED)
        .when(length > config.max_bytes, OVERSIZED)
        .when(~ext.isin(*config.supported), UNSUPPORTED)
    )


def admit(files: DataFrame, config: Config = Config()) -> DataFrame:
    """Adds ``filename``, ``extension`` and ``skip_reason`` to files with ``path`` and ``length``."""
    name = filename(F.col("path"))
    return files.withColumns({"filename": name, "extension": extension(name), "skip_reason": skip_reason(name, F.col("length"), config)})
