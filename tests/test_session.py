import gc
import time
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import functions as F

from wordloom.session import garbage_collected, written

SETTING = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shuffle_files(spark):
    found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks().mkString(" ")
    return {x for x in found.split() if x.startswith("shuffle_")}


def test_written_leaves_no_shuffle_files(spark):
    before, setting = shuffle_files(spark), spark.conf.get(SETTING)

    def one(k):
        return written(spark.range(5_000).groupBy((F.col("id") % 100 + k).alias("k")).count().orderBy("k"))

    with ThreadPoolExecutor(2) as threads:
        tables = list(threads.map(one, range(3)))
    assert spark.conf.get(SETTING) == setting
    for _ in range(50):  # they go in the background
        own = shuffle_files(spark) - before
        if not own:
            break
        time.sleep(0.1)
    assert not own
    assert [t.agg(F.count("*"), F.sum("count")).first()[:] for t in tables] == [(100, 5_000)] * 3


def test_shuffle_files_of_past_jobs_go_meanwhile(spark):
    before = shuffle_files(spark)
    with garbage_collected(spark, 0.2):
        for _ in range(3):
            spark.range(1_000).groupBy(F.col("id") % 10).count().collect()
        for _ in range(100):
            gc.collect()
            own = shuffle_files(spark) - before
            if not own:
                break
            time.sleep(0.1)
        assert not own
