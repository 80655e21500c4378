"""spark-submit entry: python -m cohortlens DATA_FOLDER OUTPUT_FOLDER [csv|parquet]"""

import sys

from pyspark.sql import SparkSession

from cohortlens.plans.batch import run

if __name__ == "__main__":
    run(SparkSession.builder.appName("cohortlens").getOrCreate(), *sys.argv[1:4]).show(truncate=False)
