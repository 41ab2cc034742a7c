"""Memory outside the heap that reading leaves."""

from __future__ import annotations

from plumbline.llm.common import small_batches, written


def test_tables_are_read_without_buffers_that_threads_keep(spark):
    key = "parquet.hadoop.vectored.io.enabled"
    for use in (lambda: written(spark.range(3), "three").count(), lambda: small_batches(spark)):
        spark.conf.unset(key)
        use()
        assert spark.conf.get(key) == "false"
