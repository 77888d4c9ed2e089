"""A change feed over landed files: keyed state holds each entity's last version, so batch borders change nothing."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from ..operators.changes import diffed, latest, normal

FEED = "change_type string, field string, old_value string, new_value string"


def changes(versions: DataFrame, key: str, order: str, fields: list[str]) -> DataFrame:
    """(key, order, change_type, field, old_value, new_value) of a stream of versions, appended as they come.

    Within a batch an entity's versions are taken in their order; between batches the last one is state.
    """
    kinds = dict(versions.dtypes)
    flat = versions.select(key, order, *[normal(c).alias(c) for c in fields])

    def step(name: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(order, kind="stable")
        last = state.get if state.exists else None
        out = []
        for row in rows.itertuples(index=False):
            now = tuple(None if (v := getattr(row, c)) is None or v != v else v for c in fields)
            if last is None:
                out.append((name[0], getattr(row, order), "appeared", None, None, None))
            else:
                out += [(name[0], getattr(row, order), "changed", f, a, b) for f, a, b in zip(fields, last, now) if a != b]
            last = now
        state.update(last)
        yield pd.DataFrame(out, columns=[key, order, "change_type", "field", "old_value", "new_value"])

    schema, memory = f"{key} {kinds[key]}, {order} {kinds[order]}, {FEED}", ", ".join(f"f{i} string" for i in range(len(fields)))
    return flat.groupBy(key).applyInPandasWithState(step, schema, memory, "append", GroupStateTimeout.NoTimeout)


def mirror(versions: DataFrame, table: str, feed: str, key: str, order: list[str], fields: list[str], checkpoint: str):
    """Keeps a snapshot and a feed in step: each batch's newest versions are diffed against the stored snapshot.

    A batch writes its own folder of the feed and its own numbered snapshot, so a replayed batch replaces what it wrote.
    """

    def batch(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        new = latest(df, key, order)
        if number:
            old = spark.read.parquet(f"{table}/v={number - 1}")
            known = old.join(new.select(key), key, "left_semi")
            moved = diffed(known, new, key, fields)
            whole = old.join(new.select(key), key, "left_anti").unionByName(new)
        else:
            moved = diffed(new.limit(0), new, key, fields)
            whole = new
        moved.write.mode("overwrite").parquet(f"{feed}/batch_id={number}")
        whole.write.mode("overwrite").parquet(f"{table}/v={number}")

    return versions.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)


def per_window(feed: DataFrame, at: str, field: str, length: str = "1 hour", slide: str | None = None, late: str = "1 day") -> DataFrame:
    """(start, field, changes) by tumbling or sliding windows of event time; rows later than ``late`` are left out."""
    w = F.window(at, length, slide) if slide else F.window(at, length)
    marked = feed.withWatermark(at, late) if feed.isStreaming else feed
    return marked.groupBy(w.alias("w"), field).agg(F.count("*").alias("changes")).select(F.col("w.start").alias("start"), field, "changes")
