"""Recognition models as batch functions, and the cache in front of them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def content_key(*columns: str):
    """Identity of an item's content; the item's own name is no part of it."""
    return F.left(F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns]), 256), F.lit(32))


def cached(items: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hits with their outputs, misses) by content key. The cache is joined once each way."""
    keys = cache.groupBy("key").agg(F.max("output").alias("output"))
    return items.join(keys, "key"), items.join(keys.select("key"), "key", "left_anti")


def run_model(items: DataFrame, model: Callable[[list[dict]], list[str]], chunk: int = 128) -> DataFrame:
    """(key, output) of a model that is loaded once per Python worker and called on chunks. Every item
    must be answered, else the task fails."""

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for pdf in batches:
            for a in range(0, len(pdf), chunk):
                part = pdf.iloc[a:a + chunk]
                got = model(part.to_dict("records"))
                if len(got) != len(part):
                    raise ValueError(f"{len(part)} items, {len(got)} answers")
                yield pd.DataFrame({"key": part["key"].to_numpy(), "output": got})

    return items.mapInPandas(run, "key string, output string")
