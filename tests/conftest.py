import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from studyloom import tune

    s = (SparkSession.builder.master("local[8]").appName("tests").config("spark.sql.shuffle.partitions", "4")
         .config("spark.ui.enabled", "false").config("spark.driver.memory", "8g").getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    yield tune(s)
    s.stop()


@pytest.fixture(scope="session")
def value(spark):
    """Evaluate a column function on literal arguments."""
    from pyspark.sql import functions as F

    def run(fn, *args):
        cols = [F.col(f"c{i}") if not isinstance(a, (list, tuple)) else F.col(f"c{i}") for i, a in enumerate(args)]
        df = spark.createDataFrame([tuple(args)], ", ".join(
            f"c{i} {'array<string>' if isinstance(a, (list, tuple)) else 'long' if isinstance(a, int) else 'double' if isinstance(a, float) else 'string'}"
            for i, a in enumerate(args)))
        return df.select(fn(*cols).alias("v")).first()["v"]

    return run
