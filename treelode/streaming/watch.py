"""Watching a workspace with Structured Streaming.

Spark's file source reports neither deletions nor in-place edits.  The stream of what moved in a
tree comes from ``sources.directories`` instead: each trigger compares the kept listing with the
tree, bucket by bucket, and only directories that moved are listed again.  Edit notifications
arrive as small text files of paths in a folder and are indexed at once.  Both queries write
through ``foreachBatch``, one at a time (the workspace admits one writer); a failed batch is simply
run again, because what it left undone still differs from the kept listing.  Each query keeps its
progress beside the workspace, so a restart does not index old notifications again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from treelode.plans.workspace import Workspace

POLL = "2 seconds"


class Watcher:
    def __init__(self, ws: Workspace, notify_dir: str | None = None, poll: str = POLL):
        self.ws, self.notify_dir, self.poll = ws, notify_dir, poll
        self.queries: list[StreamingQuery] = []

    def start(self) -> "Watcher":
        spark = self.ws.spark
        self.queries.append(
            self.ws.directories.signal_stream().writeStream.foreachBatch(self.on_tick)
            .option("checkpointLocation", self.ws.stream_folder("moved"))
            .trigger(processingTime=self.poll).queryName("treelode-watch").start()
        )
        if self.notify_dir:
            names = spark.readStream.schema("value STRING").text(self.notify_dir)
            self.queries.append(
                names.writeStream.foreachBatch(self.on_notify)
                .option("checkpointLocation", self.ws.stream_folder("notify"))
                .trigger(processingTime=self.poll).queryName("treelode-notify").start()
            )
        self.ws.watching = True
        return self

    def on_tick(self, batch: DataFrame, epoch: int) -> None:
        self.ws.refresh(signals=batch)

    def on_notify(self, batch: DataFrame, epoch: int) -> None:
        self.ws.notify_frame(batch.selectExpr("value AS path"))

    def stop(self) -> None:
        for query in self.queries:
            query.stop()
        self.queries = []
        self.ws.watching = False
