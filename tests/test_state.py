"""The stream of keyed states against one pass over all events, also over a restart."""

import random
from datetime import datetime, timedelta

from reelspark.streaming import state


def plain(events):
    last, out = {}, []
    for i, ts, key, kind in sorted(e for e in events if e[2] is not None):
        held = last.get(key)
        if held and (ts - held[0]).total_seconds() > state.LIFETIME:
            held = None
        attempts = 0 if kind != "error" else 1 + (held[2] if held else 0)
        wait = max(0, state.COOLDOWN - int((ts - held[0]).total_seconds())) if held else 0
        out.append((i, key, held is None or held[1] != kind, attempts, wait))
        last[key] = (ts, kind, attempts)
    return sorted(out)


def test_states_go_on_after_a_restart(spark, tmp_path):
    rng, at, events = random.Random(1), datetime(2024, 1, 1), []
    for i in range(300):
        at += timedelta(seconds=rng.choice([1, 20, 59, 60, 61, 500, 9000]))
        events.append((i, at, rng.choice([1, 2, 3, None]), rng.choice(["error", "error", "view"])))
    form = "event_id long, ts timestamp, user_id long, event_type string"
    stream = lambda: spark.readStream.schema(form).parquet(f"file://{tmp_path}/in")
    for part in (events[:130], events[130:140], events[140:]):  # a run each, with the state of the one before
        spark.createDataFrame(part, form).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        query = state.follow(stream(), f"file://{tmp_path}/out", f"file://{tmp_path}/state")
        assert query.awaitTermination(240)
    got = spark.read.parquet(f"file://{tmp_path}/out").collect()
    assert sorted(map(tuple, got)) == plain(events)
    assert max(r.attempts for r in got) > 3 and any(r.wait_seconds for r in got) and not all(r.changed for r in got)
