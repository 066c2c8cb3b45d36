"""Streams of sources: stateless parsing, and putting lines of a session together until they parse.

The second is an addition: an interactive reader as a stateful stream, keyed by session.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.grammar import parse
from ..plans.syntax import syntax


def parse_stream(sources: DataFrame, columns=("status",)) -> DataFrame:
    """As the batch plan; it keeps no state."""
    return syntax(sources, columns)


def read_back(stream: DataFrame, folder: str | None = None) -> DataFrame:
    """Run a stream over what is there now, and read what it wrote; ``folder`` is fresh, below the shared one by default."""
    spark = stream.sparkSession
    if folder is None:
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            local = spark.sparkContext.master.startswith("local")
            root = "file://" + tempfile.mkdtemp(prefix="quillspark-") if local else spark.conf.get("spark.sql.warehouse.dir")
        folder = f"{root.rstrip('/')}/stream-{uuid.uuid4().hex}"
    done = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start()
    done.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def complete_inputs(lines: DataFrame, timeout_ms: int | None = None) -> DataFrame:
    """session, n, status, text: inputs of (session, seq, line) rows, each given out once it needs no more lines.

    Lines of a batch are taken in the order of ``seq``. With ``timeout_ms``, a session without lines
    for so long gives out what it holds; such a query keeps triggering, as it must watch the clock.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, n = state.get if state.exists else ("", 0)
        out = []
        if state.hasTimedOut:
            if held:
                out.append((key[0], n, parse(held, entry="interactive").status, held))
            state.remove()
        else:
            frames = [b for b in batches]
            rows = pd.concat(frames).sort_values("seq") if frames else pd.DataFrame(columns=["line"])
            for line in rows["line"]:
                held += f"{line}\n"
                p = parse(held, entry="interactive")
                if not p.needs_more_input:
                    if p.status != "Empty":
                        out.append((key[0], n, p.status, held))
                        n += 1
                    held = ""
            state.update((held, n))
            if timeout_ms:
                state.setTimeoutDuration(timeout_ms)
        yield pd.DataFrame(out, columns=["session", "n", "status", "text"])

    return lines.groupBy("session").applyInPandasWithState(step, "session string, n long, status string, text string", "held string, n long", "append", GroupStateTimeout.ProcessingTimeTimeout if timeout_ms else GroupStateTimeout.NoTimeout)
