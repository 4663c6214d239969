"""Watch mode: update the index again and again. Serial micro-batches, each a full listing, because
deletions and changes in place are part of the difference; file streams do not report them."""

from __future__ import annotations

import json
import threading
from collections.abc import Callable, Iterator


def watch(update: Callable[[bool], dict], interval: float, stop: threading.Event | None = None, rebuild: bool = False, cycles: int | None = None) -> Iterator[str]:
    """JSON lines indexed, error and stopped. The interval starts when a cycle ends; a failure of the first
    cycle is raised, later ones are reported and tried again. Only the first cycle rebuilds."""
    stop = stop or threading.Event()
    done = 0
    while not stop.is_set() and (cycles is None or done < cycles):
        try:
            report = update(rebuild and done == 0)
            yield json.dumps({"event": "indexed", **report})
        except Exception as e:
            if done == 0:
                raise
            yield json.dumps({"event": "error", "message": str(e)})
        done += 1
        if cycles is None or done < cycles:
            stop.wait(interval)
    yield json.dumps({"event": "stopped", "cycles": done})


def watch_stream(spark, folder: str, update: Callable[[bool], dict], checkpoint: str, schema: str = "value string"):
    """The same update as the sink of a Structured Streaming query on the listing folder, for schedulers that run streams."""
    source = spark.readStream.schema(schema).option("recursiveFileLookup", "true").text(folder)
    return source.writeStream.foreachBatch(lambda _df, _epoch: update(False)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
