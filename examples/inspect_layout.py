"""The frames of a record file, and whether they all hold equally many records: python examples/inspect_layout.py FILE"""

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from pyspark.sql import SparkSession  # noqa: E402

from recframe.operators.read import open_records  # noqa: E402

spark = SparkSession.builder.master("local[4]").getOrCreate()
handle = open_records(spark, sys.argv[1])
handle.frame_rows(fast=False).orderBy("index").show()
broken = handle.verify()
if broken.isEmpty():
    print("all frames but the last hold", handle.field("records_per_frame"), "records")
else:
    print("records are misplaced from here on:")
    broken.orderBy("frame").show()
spark.stop()
