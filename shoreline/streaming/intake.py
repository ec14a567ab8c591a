"""Stateless streaming intake: clean action reports as files arrive."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from shoreline.plans.beaches import clean_actions
from shoreline.sources.readers import clean_names, csv_options, typed
from shoreline.sources.schemas import ACTIONS_TYPES


def clean_actions_stream(spark: SparkSession, in_dir: str, out_dir: str,
                         header_schema: T.StructType, checkpoint_location: str | None = None,
                         available_now: bool = True, multiline: bool = True) -> StreamingQuery:
    """Append cleaned rows of every new report file in ``in_dir`` to Parquet.

    ``header_schema`` lists the report's columns in file order (a stream
    needs its schema up front).  The cleaning is row-local (recode, exclude),
    so the query keeps no state; the file sink and the checkpoint make it
    exactly-once across restarts.  ``available_now`` processes what is there
    and stops, in as many micro-batches as needed.

    The checkpoint must stay the same across restarts: by default it is the
    ``_checkpoint`` folder inside ``out_dir`` (next to the sink's own
    ``_spark_metadata`` log; readers skip folders starting with ``_``).
    ``multiline`` as in ``read_report``: quoted fields may hold newlines.
    """
    # a file whose header differs from the schema fails instead of being mixed up
    raw = (csv_options(spark.readStream.schema(header_schema), multiline)
           .option("enforceSchema", False).csv(in_dir))
    df = clean_names(raw)
    df = df.select(*typed(df, ACTIONS_TYPES))
    location = checkpoint_location or f"{out_dir.rstrip('/')}/_checkpoint"
    writer = (clean_actions(df).writeStream.format("parquet").option("path", out_dir)
              .option("checkpointLocation", location).outputMode("append"))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()
