"""Ratings kept as keyed state, and folds of the epochs they are stored in."""

import json
from datetime import timedelta

from folioscope.streaming import live


def line(event, rating, ts, kind="feedback"):
    return json.dumps({"kind": kind, "event_id": event, "rating": rating, "ts": ts}) + "\n"


class Ratings:
    """A log folder, the stream over it, and the table it keeps."""

    def __init__(self, spark, tmp, late="1 hour", keep=timedelta(hours=2)):
        self.spark, self.src, self.out, self.state, self.n = spark, tmp / "log", str(tmp / "rated"), str(tmp / "state"), 0
        self.late, self.keep = late, keep
        self.src.mkdir()

    def run(self, *lines):
        """One more file, read by a stream that is started anew; returns what the run left in state."""
        self.n += 1
        (self.src / f"{self.n}.jsonl").write_text("".join(lines))
        changes = live.rating_changes(live.read_log(self.spark, str(self.src), 1), self.late, self.keep)
        query = live.keep_updates(changes, self.out, self.state).trigger(availableNow=True).start()
        query.awaitTermination()
        return query.lastProgress["stateOperators"][0]["numRowsTotal"]

    def now(self):
        rows = live.latest(self.spark, self.out, ["event_id"], ["at", "epoch"]).collect()
        assert len({r.event_id for r in rows}) == len(rows)
        return {r.event_id: r.rating for r in rows}

    def fold(self):
        return live.fold_epochs(self.spark, self.out, ["event_id"], ["at", "epoch"])


def test_log_order_counts_whatever_arrives_first(spark, tmp_path):
    log = Ratings(spark, tmp_path)
    log.run(line("a", "up", "2024-01-01T03:00:00"), line("b", "up", "2024-01-01T01:00:00"), line("q", None, "2024-01-01T03:00:00", "query"))
    log.run(line("a", "down", "2024-01-01T02:30:00"), line("b", "down", "2024-01-01T02:50:00"), "not json\n")
    assert log.now() == {"a": "up", "b": "down"}
    log.run(line("a", "down", "2024-01-01T03:00:00"), line("c", "up", "2024-01-01T03:00:00"), line("c", "down", "2024-01-01T03:00:00"))
    assert log.now() == {"a": "down", "b": "down", "c": "up"}


def test_rows_without_event_rating_or_time_are_ignored(spark, tmp_path):
    log = Ratings(spark, tmp_path)
    log.run(line(None, "up", "2024-01-01T03:00:00"), line("a", None, "2024-01-01T03:00:00"), line("a", "up", "some day"), line("a", "up", None))
    assert log.now() == {}


def test_state_is_freed_and_no_older_rating_returns(spark, tmp_path):
    log = Ratings(spark, tmp_path)
    assert log.run(line("a", "up", "2024-01-01T00:00:00")) == 1
    log.run(line("b", "up", "2024-01-02T00:00:00"))
    assert log.run(line("b", "down", "2024-01-02T00:10:00")) == 1  # a is gone, b stays
    log.run(line("a", "down", "2023-12-31T00:00:00"))  # older than what was freed: behind the watermark
    assert log.now() == {"a": "up", "b": "down"}
    log.run(line("a", "down", "2024-01-02T00:20:00"))
    assert log.now() == {"a": "down", "b": "down"}


def test_folds_stand_for_the_epochs_before_them(spark, tmp_path):
    log = Ratings(spark, tmp_path)
    log.run(line("a", "up", "2024-01-01T03:00:00"), line("b", "up", "2024-01-01T03:00:00"))
    first = log.fold()
    assert log.now() == {"a": "up", "b": "up"} and log.fold() is None
    log.run(line("a", "down", "2024-01-01T03:10:00"))
    assert log.now() == {"a": "down", "b": "up"}
    second = log.fold()
    assert second > first and log.now() == {"a": "down", "b": "up"}
    assert live.remove_folded(spark, log.out) > 0 and live.remove_folded(spark, log.out) == 0
    log.run(line("c", "up", "2024-01-01T03:20:00"))
    assert log.now() == {"a": "down", "b": "up", "c": "up"}


def test_a_fold_that_stopped_halfway_is_not_read(spark, tmp_path):
    log = Ratings(spark, tmp_path)
    log.run(line("a", "up", "2024-01-01T03:00:00"))
    done = log.fold()
    broken = tmp_path / "rated" / f"upto={done + 5}"
    broken.mkdir()
    (broken / "part-0.parquet").write_bytes(b"half")
    log.run(line("a", "down", "2024-01-01T03:30:00"))
    assert log.now() == {"a": "down"}
