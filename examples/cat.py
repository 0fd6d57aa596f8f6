"""Print some records of a record file: python examples/cat.py FILE [FROM [COUNT]]"""

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from pyspark.sql import SparkSession  # noqa: E402

from recframe.operators.read import open_records  # noqa: E402

path, start, count = [*sys.argv[1:], *("", "0", "10")[len(sys.argv) - 1 :]][:3]
spark = SparkSession.builder.master("local[2]").getOrCreate()
open_records(spark, path).write_to(sys.stdout.buffer, int(start), int(count))
spark.stop()
