"""The streaming forms, fed by files, against what their batches must give."""

import datetime as dt

import pytest

from paceline.operators import linking
from paceline.streaming import buffered, streams


def at(second):
    return dt.datetime(2026, 1, 1) + dt.timedelta(seconds=second)


@pytest.fixture
def feed(spark, tmp_path):
    """Rows as a stream that takes a file at a time, in the order of the lists given."""

    def make(batches, schema):
        folder = tmp_path / "in"
        for k, rows in enumerate(batches):
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(folder))

    return make


def run(df, name, tmp_path, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return df.sparkSession.table(name).collect()


def test_session_visits(feed, tmp_path):
    events = [[(at(0), 1, "a"), (at(5), 1, "a"), (at(9), 2, "a")], [(at(30), 1, "a"), (at(31), 1, "b")], [(at(500), 9, "z")]]
    got = run(streams.session_visits(feed(events, "event_time timestamp, global_id long, zone string"), "10 seconds", "20 seconds"), "visits", tmp_path)
    want = {(1, "a", at(0), at(5), 2), (2, "a", at(9), at(9), 1), (1, "a", at(30), at(30), 1), (1, "b", at(31), at(31), 1)}
    assert {(r.global_id, r.zone, r.t_start.replace(tzinfo=None), r.t_end.replace(tzinfo=None), r.n_dets) for r in got} == want


def test_chunk_counts(feed, tmp_path):
    events = [[(at(0), 0, 1), (at(5), 0, 1), (at(9), 0, 2)], [(at(12), 0, 1), (at(3), 1, 4)], [(at(500), 0, 9)]]
    got = run(streams.chunk_counts(feed(events, "event_time timestamp, cam_id int, global_id long"), "10 seconds", "20 seconds"), "chunks", tmp_path)
    assert {(r.cam_id, r.start.replace(tzinfo=None), r.n_dets, r.n_gids) for r in got} == {(0, at(0), 3, 2), (0, at(10), 1, 1), (1, at(0), 1, 1)}


def test_rolling_counts(feed, tmp_path):
    """A window over the last two chunks; more persons than an approximate count gets right are counted exactly."""
    events = [[(at(k % 10), 0, k) for k in range(3000)], [(at(12), 0, 1), (at(13), 0, 7000)], [(at(500), 0, 9)]]
    got = run(streams.chunk_counts(feed(events, "event_time timestamp, cam_id int, global_id long"), "20 seconds", "20 seconds", "10 seconds"), "rolling", tmp_path)
    assert {(r.start.replace(tzinfo=None), r.n_dets, r.n_gids) for r in got} == {(at(-10), 3000, 3000), (at(0), 3002, 3001), (at(10), 2, 2)}


def test_drain(spark, feed, tmp_path):
    stream = feed([[(1,), (2,)], [(3,)]], "a long")
    for _ in range(2):  # what has been written once is not written again
        assert streams.drain(stream, "parquet", str(tmp_path / "out"), str(tmp_path / "state"), 120)
        assert sorted(r.a for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2, 3]


def test_delayed_remap(spark, feed, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    schema = "event_time timestamp, cam_group long, det_id long, global_id long, source long, target long"
    n = None
    rows = [
        [(at(0), 1, 10, 3, n, n), (at(1), 1, 11, 4, n, n), (at(1), 2, 12, 3, n, n)],
        [(at(4), 1, n, n, 3, 2), (at(4), 1, n, n, 2, 1)],
        [(at(30), 1, 13, 4, n, n), (at(30), 2, 14, 3, n, n)],
        [(at(40), 1, n, n, 4, 9)],
        [(at(900), 1, 15, 1, n, n)],
        [(at(901), 1, 16, 1, n, n)],
    ]
    events = feed(rows, schema)
    got = run(streams.delayed_remap(events.where("det_id is not null"), events.where("source is not null"), 15_000, "1 second"), "remapped", tmp_path)
    assert {(r.cam_group, r.det_id): r.global_id for r in got} == {(1, 10): 1, (1, 11): 4, (2, 12): 3, (1, 13): 9, (2, 14): 3}


def test_buffered_stream(spark, feed, tmp_path):
    """Boxes that come in pieces, out of order within a chunk, get the ids of the batch form."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    looks = [[1.0, 0.0, 0.1], [0.0, 1.0, 0.1], [0.1, 0.0, 1.0]]
    rows, start = [], int(at(0).replace(tzinfo=dt.timezone.utc).timestamp())
    for f in range(50):
        for group in (0, 1):
            for k in range(3):
                if not (k == 2 and 10 <= f < 30) and not (k == 1 and f < 20):
                    v = [x + 0.02 * ((f * 7 + k * 3 + i) % 5) for i, x in enumerate(looks[k])]
                    n = sum(x * x for x in v) ** 0.5
                    rows.append((at(f), group, 0, start + f, len(rows), k, [x / n for x in v]))
    schema = "event_time timestamp, group long, cam_id int, frame_no long, det_id long, local_track_id long, v array<double>"
    last = [(at(5000), g, 0, start + 5000, 10_000 + g, 0, looks[0]) for g in (0, 1)]
    pieces = [rows[:70][::-1], rows[70:150], rows[150:], last, [(at(9000), *last[0][1:4], 20_000, 0, looks[0])]]
    got = {r.det_id: r.global_id for r in run(buffered.live_buffered(feed(pieces, schema), 10_000, "1 second", 0.3, chunks=2, vote=3), "buffered", tmp_path)}
    batch = spark.createDataFrame(rows, schema)
    want = {r.det_id: r.global_id for r in linking.buffered_ids(batch, 10, 0.3, chunks=2, vote=3).collect()}
    assert len(want) == len(rows) and len(set(want.values())) == 3
    assert {k: got.get(k) for k in want} == want
