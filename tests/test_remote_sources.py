"""The data source over a fake provider: batch, stream with admission and restart, errors as rows."""

import os
import uuid

import pytest

from tessera.sources import remote as M


@pytest.fixture(scope="module")
def source(spark):
    spark.dataSource.register(M.RemoteSources)
    return lambda reader, folder, **options: reader.format("evidence_sources").option("provider", "tests.fake_provider:download").option("wait_s", "0").options(**options).load(str(folder))


URLS = ["https://v/x=3", "https://v/private", "# a note", "", "https://v/login", "https://v/down", "https://v/empty", "https://v/y=2"]


def put(folder, name, urls, end="\n"):
    with open(os.path.join(folder, name), "w") as f:
        f.write("\n".join(urls) + end)


def test_batch_and_errors_as_rows(spark, source, tmp_path):
    flaky = f"https://v/flaky-{uuid.uuid4().hex}"
    put(tmp_path, "a.txt", URLS)
    put(tmp_path, "b.txt", [flaky, "https://v/z=1"], end="")
    df = source(spark.read, tmp_path, partition_size="3")
    rows = {r["url"]: r for r in df.collect()}
    assert len(rows) == 8 and df.rdd.getNumPartitions() == 3
    said = {u.rsplit("/", 1)[-1].split("-")[0]: (r["status"], r["error_class"], r["attempts"]) for u, r in rows.items()}
    assert said == {"x=3": ("succeeded", None, 1), "private": ("failed", "unavailable", 1), "login": ("failed", "auth", 1), "down": ("failed", "network", 3), "empty": ("succeeded", None, 1), "y=2": ("succeeded", None, 1), "flaky": ("succeeded", None, 2), "z=1": ("succeeded", None, 1)}
    assert rows["https://v/private"]["error"] == "this video is private" and rows["https://v/empty"]["items"] == []
    assert rows["https://v/x=3"]["duration_s"] == 29.0 and rows["https://v/x=3"]["video_id"] == M.source_id("https://v/x=3")
    items = M.items_of(df.where("url = 'https://v/x=3'")).orderBy("item_ord").collect()
    assert [(r["item_ord"], r["start_s"], r["text"]) for r in items] == [(i, 10.0 * i, f"item {i} of 3") for i in range(3)]


def test_empty_lists_and_options(spark, source, tmp_path):
    assert source(spark.read, tmp_path).count() == 0
    put(tmp_path, "a.txt", ["https://v/x=1"])
    assert source(spark.read, tmp_path / "a.txt").count() == 1
    with pytest.raises(Exception, match="needs a path and a provider"):
        spark.read.format("evidence_sources").load(str(tmp_path)).count()


def test_stream(spark, source, tmp_path):
    lists, out = tmp_path / "lists", str(tmp_path / "out")
    lists.mkdir()
    put(lists, "a.txt", [*(f"https://v/a{i}=1" for i in range(7)), "https://v/not-yet-who"], end="")
    batches = []

    def store(df, number):
        batches.append((number, df.count()))
        df.write.mode("overwrite").parquet(f"{out}/batch={number}")

    def run():
        df = source(spark.readStream, lists, per_trigger="3", partition_size="2")
        q = df.writeStream.foreachBatch(store).option("checkpointLocation", f"{tmp_path}/c").start()
        q.processAllAvailable()
        q.stop()

    run()
    assert [n for _, n in batches] == [3, 3, 1]
    put(lists, "b.txt", ["https://v/private", "https://v/b=1"])
    run()
    assert sum(n for _, n in batches) == 9 and batches[-1][0] == len(batches) - 1
    before = len(batches)
    run()  # nothing new: a restart reads nothing again
    assert [n for _, n in batches[before:]] == []
    rows = spark.read.parquet(out).collect()
    assert len({r["url"] for r in rows}) == 9 == len(rows) and sum(r["status"] == "failed" for r in rows) == 1
