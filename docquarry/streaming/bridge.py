"""Requests and responses over Structured Streaming.

Requests come as rows (seq, topic, payload).  A batch's requests run in order of ``seq``,
each seeing what those before it wrote; responses are appended as rows (request_id, msg_seq,
payload).  Every request is answered, one that comes again too, so the stream keeps no state; a
repeated batch writes its responses to the same place, and one that has run is left alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docquarry.sources.store import Database
from docquarry.streaming.commands import Commands, responses_frame

REQUEST = "seq long, topic string, payload string"
REQUEST_TOPIC, RESPONSE_TOPIC = "quarry/request", "quarry/response"


def request_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Requests from JSON lines that arrive as files in a folder."""
    return spark.readStream.schema(REQUEST).option("maxFilesPerTrigger", 100).json(folder)


def requests_on(requests: DataFrame, topic: str = REQUEST_TOPIC) -> DataFrame:
    """Requests on the topic that aren't empty."""
    return requests.where((F.col("topic") == topic) & (F.trim(F.coalesce("payload", F.lit(""))) != ""))


def answer_batch(database: Database, batch: DataFrame) -> DataFrame:
    """Runs one batch of requests, in order, and returns their responses."""
    commands = Commands(database)
    rows = batch.orderBy("seq").select("payload").toLocalIterator()
    return responses_frame(batch.sparkSession, [commands.handle_text(r.payload) for r in rows])


def start_bridge(database: Database, requests: DataFrame, responses: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Answers a stream of requests.  The database must be open.

    A batch first writes its responses under its number; a batch whose folder is
    complete has run and is left alone when it comes again.
    """
    if not database.is_open:
        database.open()

    def run(batch: DataFrame, number: int) -> None:
        target = f"{responses}/batch={number}"
        if not database.files.exists(f"{target}/_SUCCESS"):
            answer_batch(database, batch).write.mode("overwrite").parquet(target)

    writer = requests_on(requests).writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def read_responses(spark: SparkSession, responses: str) -> DataFrame:
    return spark.read.schema("request_id string, msg_seq int, payload string, batch long").parquet(responses)
