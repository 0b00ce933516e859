"""Run queries where the workers cannot import the package: ``python shipping.py repo folder name ...``."""

import sys

sys.path.insert(0, sys.argv[1])

import __spark_entry__ as entry  # noqa: E402
from marketloom.session import local_session  # noqa: E402


def probe(_):
    import importlib.util

    yield importlib.util.find_spec("marketloom") is None


if __name__ == "__main__":
    spark = local_session("2", shuffle_partitions=2)
    assert all(spark.sparkContext.parallelize([0], 1).mapPartitions(probe).collect()), "workers see the package"
    queries = entry.queries()
    for name in sys.argv[3:]:
        queries[name](spark, sys.argv[2]).write.format("noop").mode("overwrite").save()
        print("ran", name, flush=True)
