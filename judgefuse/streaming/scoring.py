"""Case scoring on a stream of step files (Structured Streaming).

The reference appends per-task evidence records to JSONL files as they are
produced.  Here the same case aggregation (E8) and threshold rule (H9) run
unchanged on a streaming DataFrame: the per-case partial aggregates
(last verdict, last label, products) live in the state store, each trigger
emits the cases it touched (update mode), and ``foreachBatch`` writes them to
shared storage in a folder of the batch id.  The latest row per case is the current
answer (``upsert_latest``).  Restarting from the checkpoint resumes exactly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from judgefuse.operators import cases as C
from judgefuse.operators.model import RUN_WEIGHTS, ChannelWeights, EMParams
from judgefuse.operators.steps import normalise

STEP_SCHEMA = T.StructType([
    T.StructField("test_case_id", T.StringType()), T.StructField("ord", T.LongType()),
    T.StructField("step", T.StringType()), T.StructField("phi", T.IntegerType()),
    T.StructField("E1_gui", T.DoubleType()), T.StructField("E2_code", T.DoubleType()),
    T.StructField("E4_noresp", T.DoubleType()), T.StructField("M_gui", T.DoubleType()),
    T.StructField("M_code", T.DoubleType()), T.StructField("M_noresp", T.DoubleType()),
    T.StructField("weight", T.DoubleType()), T.StructField("agent_testcase_score", T.DoubleType()),
    T.StructField("delta_label", T.DoubleType()),
])


def streaming_cases(raw_steps: DataFrame, params: EMParams, weights: ChannelWeights = RUN_WEIGHTS,
                    alpha: float = 0.75, tau_agentfail: float = 0.75, tau_envfail: float = 0.75) -> DataFrame:
    """E8 + H9 over a streaming step table (columns as ``STEP_SCHEMA``)."""
    steps = normalise(raw_steps)
    return C.correct_threshold(C.case_noisy_or(steps, params, weights, alpha),
                               tau_agentfail, tau_envfail, tau_envfail)


def start_case_scoring(spark: SparkSession, source_dir: str, sink_dir: str, checkpoint: str,
                       params: EMParams, fmt: str = "parquet", available_now: bool = False,
                       max_files_per_trigger: int = 1000) -> StreamingQuery:
    """Run ``streaming_cases`` over new step files in ``source_dir``."""
    raw = (spark.readStream.schema(STEP_SCHEMA).option("maxFilesPerTrigger", max_files_per_trigger)
           .format(fmt).load(source_dir))
    cases = streaming_cases(raw, params)

    def sink(batch: DataFrame, batch_id: int) -> None:
        # a folder per batch: a batch that is replayed after a failure replaces itself
        batch.write.mode("overwrite").parquet(f"{sink_dir}/batch_id={batch_id}")

    w = cases.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(sink)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()
