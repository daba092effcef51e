"""What a token file and the batches of texts take at once."""

import public_tokenizers
import pyarrow as pa
from pyspark.sql import functions as F

from tickflow.llm import tokens
from tickflow.llm.common import bounded_batches


def test_a_page_holds_few_rows_of_ids(spark, tmp_path):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.expr("concat_ws(' ', transform(sequence(1, 600), i -> hex(xxhash64(id, i))))").alias("text"))
    path = f"{tmp_path}/tokens"
    tokens.write_token_files(docs, path, public_tokenizers.path("byte_bpe_50k.json"), partitions=1)
    (file,) = tmp_path.glob("tokens/*.parquet")
    jvm = spark._jvm.org.apache
    opened = jvm.parquet.hadoop.ParquetFileReader.open(jvm.parquet.hadoop.util.HadoopInputFile.fromPath(jvm.hadoop.fs.Path(str(file)), spark._jsc.hadoopConfiguration()))
    (data,) = [c for block in opened.getFooter().getBlocks() for c in block.getColumns() if c.getPath().toDotString() == "data"]
    pages = opened.readOffsetIndex(data).getPageCount()
    opened.close()
    assert data.getTotalUncompressedSize() > 10 << 20 and data.getTotalUncompressedSize() / pages < 3 << 20
    assert tokens.read_token_files(spark, path).count() == 4000


def test_batches_are_bounded_by_bytes(spark):
    bounded_batches(spark)

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([b.nbytes], pa.int64())})

    rows = spark.range(0, 400, 1, 1).select(F.expr("repeat('x', 100000)").alias("text"))
    found = [r.n for r in rows.mapInArrow(sizes, "n bigint").collect()]
    assert sum(found) >= 40_000_000 and max(found) < 9_000_000
