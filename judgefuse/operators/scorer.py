"""B18 with an outside scorer: a bounded number of calls, each with a time limit, each answer kept."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from judgefuse.operators.assembly import Scorer
from judgefuse.sources.sinks import append_batches, read_appended


def answers_of(texts: list[str], ask: Callable[[str], str], in_flight: int, timeout: float) -> Iterator[str | None]:
    """The answer to each text, in order; None where ``ask`` fails or takes over ``timeout`` seconds.

    ``in_flight`` calls start together and are awaited together.  A call over
    its time is left to itself (its thread ends with the worker).
    """
    for low in range(0, len(texts), in_flight):
        wave = texts[low:low + in_flight]
        got: list[str | None] = [None] * len(wave)

        def call(k: int, text: str, into: list[str | None]) -> None:
            try:
                into[k] = ask(text)
            except Exception:  # noqa: BLE001 - whatever the scorer raises, the row gets the default
                into[k] = None

        threads = [threading.Thread(target=call, args=(k, t, got), daemon=True) for k, t in enumerate(wave)]
        for t in threads:
            t.start()
        end = time.monotonic() + timeout
        for t in threads:
            t.join(max(0.0, end - time.monotonic()))
        yield from list(got)


def bounded_scorer(ask: Callable[[str], str], folder: str, in_flight: int = 8, parts: int = 4, timeout: float = 30.0,
                   default: str = "No", batches: int = 8) -> Scorer:
    """A B18 scorer that calls ``ask`` once for every different evidence text.

    At most ``parts`` tasks run at a time with ``in_flight`` calls each.  Answers
    are appended to ``folder`` (shared storage) in ``batches``, and used from
    there: a later run, or one after an interruption, asks only for new texts.  A
    call that fails or takes too long gives ``default``, and that is kept too.
    Null evidence is not asked and gives ``default``.
    """
    import pyarrow as pa

    def run(batch_iter: Iterable) -> Iterator:
        for batch in batch_iter:
            got = list(answers_of(batch.column(0).to_pylist(), ask, in_flight, timeout))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([default if a is None else a for a in got], pa.string()),
                 pa.array([a is not None for a in got], pa.bool_())], names=["evidence", "_answer", "_answered"])

    def scorer(df: DataFrame) -> DataFrame:
        texts = df.select("evidence").filter(F.col("evidence").isNotNull()).distinct()
        append_batches(texts, lambda part: part.repartition(parts).mapInArrow(
            run, "evidence string, _answer string, _answered boolean"), folder, "evidence", batches)
        answers = read_appended(df.sparkSession, folder).select("evidence", "_answer")
        return (df.join(answers, "evidence", "left")
                .withColumn("agent_noresp", F.coalesce("_answer", F.lit(default))).select(*df.columns, "agent_noresp"))

    return scorer
