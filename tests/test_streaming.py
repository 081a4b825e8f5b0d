from cellweave.operators.blocks import entries
from cellweave.streaming import ingest
from tests.fixtures import BLOCK_SCHEMA, block


def test_blocks_that_arrive_and_are_written_again(spark, tmp_path):
    src, dst, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    spark.createDataFrame([block(0, [[(1, 5)], [(2, 1)]], at=0), block(2, [[(3, 3)]], at=1)], BLOCK_SCHEMA).coalesce(1).write.parquet(src)
    ingest.append_blocks(ingest.block_stream(spark, src), dst, mark).awaitTermination()
    spark.createDataFrame([block(0, [[(1, 9)], []], at=9)], BLOCK_SCHEMA).coalesce(1).write.mode("append").parquet(src)
    ingest.append_blocks(ingest.block_stream(spark, src), dst, mark).awaitTermination()
    got = sorted((r.row_id, r.col_id, r.val) for r in entries(ingest.current_blocks(spark, dst)).collect())
    assert got == [(0, 1, 9), (2, 3, 3)]
    q = ingest.write_counts(ingest.block_stream(spark, src)).writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r.blocks, r.entries) for r in spark.table("counts").collect()] == [(3, 4)]
