"""Each stream over micro-batches gives what its batch twin gives on the same rows."""

import datetime

import pytest
from pyspark.sql import functions as F

from cardloom.operators import history, ranking
from cardloom.streaming import jobs

SCHEMA = "user_id long, card_id long, ts timestamp, event_type string"


def at(day, minute=0):
    return datetime.datetime(2024, 1, day, 12, minute)


def run(spark, tmp_path, batches, build, mode):
    """Feeds one file after another and returns all rows that the sink got, each with its batch."""
    source, got = tmp_path / "in", []
    source.mkdir()
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(source))

    def keep(df, n):
        got.extend((n, r) for r in df.collect())

    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / f"b{k}"))
        part = next((tmp_path / f"b{k}").glob("*.parquet"))
        part.rename(source / f"{k}.parquet")
        q = build(stream).writeStream.outputMode(mode).option("checkpointLocation", str(tmp_path / "cp")).foreachBatch(keep).trigger(availableNow=True).start()
        q.awaitTermination()
    return got


def test_engagement_days_roll_up_to_months(spark, tmp_path):
    batches = [[(1, 5, at(1), "view"), (1, 5, at(1, 3), "click")], [(1, 5, at(2), "view"), (2, 6, at(9), "view")], [(1, 5, at(1), "view"), (1, 7, at(20), "view")]]
    got = run(spark, tmp_path, batches, jobs.engagement_stream, "append")
    rows = [r for _, r in got]
    assert {(r.day.day, r.card_id, r.views, r.clicks) for r in rows} == {(1, 5, 1, 1), (2, 5, 1, 0), (9, 6, 1, 0)}  # the late view of day 1 is dropped
    months = jobs.monthly_from_days(spark.createDataFrame(rows)).collect()
    on_time = spark.createDataFrame([x for b in batches[:2] for x in b], SCHEMA)
    assert {tuple(r) for r in months} == {tuple(r) for r in ranking.engagement_monthly(on_time).collect()}


def test_replayed_batches_change_nothing(spark, tmp_path):
    """A batch that comes twice, and one that comes again after later ones, leave the table as it was."""
    table = jobs.DayTable(spark, str(tmp_path / "days"))
    day, of = datetime.date(2024, 1, 1), "day date, card_id long, views long, clicks long"
    first, second = spark.createDataFrame([(day, 5, 1, 0), (day, 6, 2, 2)], of), spark.createDataFrame([(day, 5, 4, 1), (datetime.date(2024, 2, 1), 5, 1, 1)], of)
    want = {(day, 5, 4, 1), (day, 6, 2, 2), (datetime.date(2024, 2, 1), 5, 1, 1)}
    for k in (0, 0, 1, 1, 0):
        table.upsert((first, second)[k], k)
    assert {tuple(r) for r in table.days().collect()} == want
    assert {(r.month.month, r.card_id, r.views, r.clicks) for r in table.months().collect()} == {(1, 5, 4, 1), (1, 6, 2, 2), (2, 5, 1, 1)}


def test_stream_into_the_table_is_its_batch_twin(spark, tmp_path):
    """Files come one after another and the stream is stopped in between; each run goes on from its checkpoint."""
    source, table = tmp_path / "in", jobs.DayTable(spark, str(tmp_path / "days"))
    rows = [(u, c % 5, at(1 + c % 3, c), ("view", "click")[c % 2]) for u in (1, 2) for c in range(24)]
    for k in range(3):
        spark.createDataFrame(rows[k * 16 : k * 16 + 16], SCHEMA).coalesce(1).write.mode("append").parquet(str(source))
        jobs.engagement_into(spark.readStream.schema(SCHEMA).parquet(str(source)), table, str(tmp_path / "cp"), "30 days")
    want = {tuple(r) for r in ranking.engagement_monthly(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert {tuple(r) for r in table.months().collect()} == want


@pytest.fixture
def rocksdb(spark):
    named = {"spark.sql.streaming.stateStore.providerClass": jobs.ROCKSDB, "spark.sql.streaming.noDataMicroBatches.enabled": "false"}
    for k, v in named.items():
        spark.conf.set(k, v)
    yield
    for k in named:
        spark.conf.unset(k)


def test_recent_views(spark, tmp_path, rocksdb):
    rows = [(u, c, at(1 + (c * 7) % 28, (c * 11 + u) % 60), "view") for u in (1, 2) for c in range(14)] + [(1, 3, at(29), "view")]
    odd = [(None, 1, at(3), "view"), (1, None, at(30), "view"), (2, 1, None, "view")]
    got = run(spark, tmp_path, [rows[:9], rows[9:20] + odd, rows[20:]], jobs.recent_views_stream, "update")
    last = {u: max(n for n, r in got if r.user_id == u) for u in (1, 2)}
    assert {r.user_id for _, r in got} == {1, 2}
    live = {(r.user_id, r.card_id, r.place) for n, r in got if n == last[r.user_id]}
    assert live == {tuple(r) for r in history.recent_views(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_idle_views_end(spark, tmp_path, rocksdb):
    """A user's old views are gone in the batch after their time, those of a user within it are not."""
    brief = lambda s: jobs.recent_views_stream(s, idle_ms=1)
    batches = [[(1, c, at(1, c), "view") for c in range(3)], [(1, 9, at(2), "view")]]
    assert [r.card_id for n, r in run(spark, tmp_path, batches, brief, "update") if n == 1] == [9]
    (tmp_path / "long").mkdir()
    assert [r.card_id for n, r in run(spark, tmp_path / "long", batches, jobs.recent_views_stream, "update") if n == 1] == [9, 2, 1, 0]


def test_favourites(spark, tmp_path):
    rows = [(1, 1, at(1), "x"), (1, 1, at(2), "x"), (1, 2, at(3), "x"), (2, 1, at(4), "x"), (1, 1, at(5), "x")]
    got = run(spark, tmp_path, [rows[:2], rows[2:]], jobs.favourites_stream, "update")
    last = {(r.user_id, r.card_id): r.favourite for _, r in got}
    assert {k for k, v in last.items() if v} == {tuple(r) for r in history.favourites(spark.createDataFrame(rows, SCHEMA).withColumn("event_id", F.lit(1))).collect()}
