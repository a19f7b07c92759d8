"""What an executor's Python workers hold beside the JVM."""

import pyarrow as pa
from pyspark.sql import functions as F

from docquarry.llm import toxicity
from docquarry.llm.common import prepare_workers


def test_workers_give_back_what_they_free(spark):
    """A worker stays after its task, so what a batch took mustn't stay with it."""
    prepare_workers(spark)

    def held() -> int:
        with open("/proc/self/smaps_rollup") as f:
            return sum(int(line.split()[1]) for line in f if line.startswith("Pss_Anon:")) // 1024

    def run(batches):
        import numpy as np

        for batch in batches:
            before = held()
            for size in (1_500_000, 6_000_000):  # pieces as large as the columns of a batch
                arrow = [pa.allocate_buffer(size) for _ in range(20)]
                for b in arrow:
                    np.frombuffer(b, np.uint8)[:] = 1
                arrays = [np.ones(size, np.uint8) for _ in range(20)]
                del arrow, arrays, b
            yield pa.RecordBatch.from_arrays([pa.array([held() - before] * batch.num_rows, pa.int64()), pa.array([pa.default_memory_pool().backend_name] * batch.num_rows)], names=["kept", "pool"])

    row = spark.range(1).coalesce(1).mapInArrow(run, "kept long, pool string").first()
    assert row.pool == "system"
    assert row.kept < 20


def test_fit_rows_takes_no_python_workers(spark, frame, monkeypatch):
    """Rows made of Python's would take a second daemon, of another environment, on every executor."""
    docs = frame([f"text {k}" for k in range(40)]).localCheckpoint()
    labels = docs.select("doc_id", (F.col("doc_id") % 2).alias("quality")).localCheckpoint()
    want = [f"text {r.doc_id}" for r in labels.where(~toxicity.held_out(F.col("doc_id"))).collect()]
    monkeypatch.setattr(spark.sparkContext, "pythonExec", "/no/such/python")
    texts, y = toxicity.fit_rows(docs, labels, "quality", 40)
    assert sorted(texts) == sorted(want)
    assert [int(t.split()[1]) % 2 for t in texts] == y.tolist()


def test_fit_rows_by_ids_of_other_kinds(spark, frame):
    docs = frame([f"text {k}" for k in range(20)])
    for kind in ("int", "string", "smallint", "decimal(12,0)"):
        own = docs.withColumn("doc_id", F.col("doc_id").cast(kind))
        labels = own.select("doc_id", F.lit(1).alias("quality"))
        assert len(toxicity.fit_rows(own, labels, "quality", 20)[0]) == own.where(~toxicity.held_out(F.col("doc_id"))).count() > 0
