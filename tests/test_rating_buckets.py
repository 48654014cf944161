"""The state of ratings is dealt to buckets; a bucket's events are settled together."""

import random
from datetime import datetime, timedelta

from test_rating_state import Ratings, line

from folioscope.streaming import live


def test_events_that_share_a_bucket_are_told_apart(spark, tmp_path, monkeypatch):
    whole = live.rating_changes
    monkeypatch.setattr(live, "rating_changes", lambda events, late, keep: whole(events, late, keep, buckets=2))
    log = Ratings(spark, tmp_path, late="100 hours", keep=timedelta(hours=200))
    draw, begun = random.Random(3), datetime(2024, 1, 1)
    newest = {}
    for number in range(3):
        rows = [(f"e{draw.randrange(40)}", draw.choice(["up", "down", "none"]), draw.randrange(30)) for _ in range(150)]
        left = log.run(*[line(e, r, (begun + timedelta(hours=h)).isoformat()) for e, r, h in rows])
        for event, rating, hour in rows:
            newest[event] = max(newest.get(event, (-1, 0, "")), (hour, number, rating))
        assert left <= 2  # a row of state a bucket, not an event
        assert log.now() == {event: rating for event, (_, _, rating) in newest.items()}


def test_a_bucket_frees_each_event_in_its_time(spark, tmp_path, monkeypatch):
    whole = live.rating_changes
    monkeypatch.setattr(live, "rating_changes", lambda events, late, keep: whole(events, late, keep, buckets=1))
    log = Ratings(spark, tmp_path)
    log.run(line("a", "up", "2024-01-01T00:00:00"))
    assert log.run(line("b", "up", "2024-01-02T00:00:00")) == 1
    assert log.run(line("b", "down", "2024-01-02T00:10:00")) == 1  # a is gone, b stays
    log.run(line("a", "down", "2023-12-31T00:00:00"))  # behind the watermark
    assert log.now() == {"a": "up", "b": "down"}
    assert log.run(line("c", "up", "2024-01-09T00:00:00")) == 1
    assert log.run(line("c", "up", "2024-01-09T00:00:00")) == 1
    assert log.now() == {"a": "up", "b": "down", "c": "up"}
