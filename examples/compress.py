"""Write a table as a folder of record files, in an order, and read a range of it: python examples/compress.py TABLE.parquet FOLDER COLUMN"""

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from recframe.operators.read import open_records  # noqa: E402
from recframe.operators.write import write_folder  # noqa: E402

table, folder, column = sys.argv[1:]
spark = SparkSession.builder.master("local[4]").getOrCreate()
rows = spark.read.parquet(table)
record = F.concat(F.to_json(F.struct(*rows.columns)).cast("binary"), F.lit(b"\n"))
write_folder(rows.select(column, record.alias("record")), folder, column, mode="overwrite", extension="jsonl")
handle = open_records(spark, folder)
print(handle.total(), "records")
handle.values(100, 5).select("record_index", F.col("value").cast("string")).show(truncate=False)
spark.stop()
