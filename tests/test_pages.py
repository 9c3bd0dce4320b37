"""The page source: chains of cursors, in batch and as a stream that is stopped and started."""

import pytest
from pyspark.errors import PySparkException

from evigrain.sources.pages import PageSource


@pytest.fixture
def folder(spark, tmp_path):
    spark.dataSource.register(PageSource)
    path = str(tmp_path / "pages")
    add(spark, path, [(None, "c1", "zero"), ("c1", "c2", "one"), ("c2", "c3", "two"), ("elsewhere", None, "not in the chain")])
    return path


def add(spark, path, rows):
    spark.createDataFrame(rows, "cursor string, next_cursor string, payload string").coalesce(1).write.mode("append").parquet(path)


def read(spark, folder, **options):
    return [(r.page, r.cursor, r.payload) for r in spark.read.format("provider_pages").options(**options).load(folder).orderBy("page").collect()]


def test_batch_follows_the_chain(spark, folder):
    assert read(spark, folder, max_pages=2) == [(0, None, "zero"), (1, "c1", "one")]
    assert read(spark, folder, start="c1", max_pages=2) == [(0, "c1", "one"), (1, "c2", "two")]
    add(spark, folder, [("c3", None, "three")])
    assert read(spark, folder) == [(0, None, "zero"), (1, "c1", "one"), (2, "c2", "two"), (3, "c3", "three")]
    assert read(spark, folder, start="elsewhere") == [(0, "elsewhere", "not in the chain")]


def test_missing_repeated_and_circular_cursors_are_errors(spark, folder, tmp_path):
    with pytest.raises(PySparkException, match="0 pages for cursor 'c3'"):
        read(spark, folder)
    add(spark, folder, [("c3", "c1", "back"), ("c9", None, "x"), ("c9", None, "y")])
    with pytest.raises(PySparkException, match="comes again"):
        read(spark, folder)
    with pytest.raises(PySparkException, match="2 pages for cursor 'c9'"):
        read(spark, folder, start="c9")
    with pytest.raises(PySparkException, match="max_pages"):
        read(spark, folder, max_pages=0)


def run(spark, folder, tmp_path, **options):
    q = spark.readStream.format("provider_pages").options(**options).load(folder).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    if q.exception():
        raise q.exception()
    return sorted((r.page, r.payload) for r in spark.read.parquet(str(tmp_path / "out")).collect())


def test_a_restarted_stream_delivers_each_page_once(spark, folder, tmp_path):
    add(spark, folder, [("c3", "c4", "three")])
    assert run(spark, folder, tmp_path, max_pages=2) == [(0, "zero"), (1, "one")]
    assert run(spark, folder, tmp_path, max_pages=2) == [(0, "zero"), (1, "one")]
    with pytest.raises(PySparkException, match="0 pages for cursor 'c4'"):
        run(spark, folder, tmp_path)
    add(spark, folder, [("c4", None, "four")])
    want = [(0, "zero"), (1, "one"), (2, "two"), (3, "three"), (4, "four")]
    assert run(spark, folder, tmp_path) == want
    assert run(spark, folder, tmp_path) == want
