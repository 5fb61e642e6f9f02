"""Frames of passes are not broadcast: an estimate does not see how many a video comes to."""

import random

from docketlake.operators import records as R


def test_new_frames_are_found_without_a_broadcast(spark):
    r = random.Random(5)
    old = [(v, r.randrange(5000)) for v in range(3) for _ in range(12)] + [(0, 0), (0, 1010)]
    new = [(v, t) for v in range(4) for t in sorted(r.sample(range(5200), 400))]
    got = R.new_frames(spark.createDataFrame(new, "video_id long, ts_ms long"), spark.createDataFrame(old, "video_id long, ts_ms long"), 101)
    assert "BroadcastHashJoin" not in got._jdf.queryExecution().executedPlan().toString()
    want = [(v, t) for v, t in new if all(v != w or abs(t - e) >= 101 for w, e in old)]
    assert sorted(map(tuple, got.collect())) == sorted(want)
