"""Change events coalesced into bursts, and a stream that refreshes an index from them."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def coalesce(events: DataFrame, ts: str, keys: list[str], item: str, gap: str = "1500 milliseconds", late: str | None = None) -> DataFrame:
    """keys, first_ts, last_ts, n and items (distinct) of each burst: events of a key less than the gap apart. Works
    on streams, then with a watermark of late, and on tables."""
    rows = events if late is None else events.withWatermark(ts, late)
    out = rows.groupBy(*keys, F.session_window(ts, gap)).agg(F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.count(F.lit(1)).alias("n"), F.collect_set(item).alias("items"))
    return out.drop("session_window")


def changed_paths(events: DataFrame, root: str, ignored: tuple[str, ...] = (".git", ".index")) -> DataFrame:
    """path of every file event below the root; a move counts for both its ends. Directories, paths outside and
    ignored folders drop out."""
    both = events.filter("NOT is_directory").select(F.explode(F.array_compact(F.array("src_path", "dest_path"))).alias("path"))
    inside = both.filter(F.startswith("path", F.lit(root.rstrip("/") + "/"))).select(F.substring("path", len(root.rstrip("/")) + 2, 1 << 20).alias("path"))
    return inside.filter(~F.arrays_overlap(F.split("path", "/"), F.array(*(F.lit(x) for x in ignored))))


def refresh(changes: DataFrame, index_paths: Callable[[DataFrame, int], None], checkpoint: str, interval: str = "1500 milliseconds", log: logging.Logger | None = None, once: bool = False) -> StreamingQuery:
    """Feeds each batch's distinct paths to index_paths(paths, batch). A failing batch is logged, and the stream
    goes on."""
    log = log or logging.getLogger(__name__)

    def batch(df: DataFrame, number: int) -> None:
        try:
            index_paths(df.select("path").distinct(), number)
        except Exception:
            log.exception("batch %s could not be indexed", number)

    writer = changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)).start()
