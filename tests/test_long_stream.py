"""A long recording in a stream does not wait for one task."""

from __future__ import annotations

from pyspark.sql import functions as F
from test_streaming import base, feed

from spanloom.streaming.intervals import stream_before
from spanloom.streaming.run import drain


def test_a_long_recording_spreads(spark, tmp_path):
    """Starts on, before and behind the edges of buckets, tolerance included, each pair once, from several tasks."""
    width = 8 * (15 + 2 * 2 + 1)
    ends = [b * width + d for b in range(40) for d in (-1, 0, 1)]
    starts = [b * width + d for b in range(40) for d in (-19, -3, -2, -1, 0, 1, 2, 15, 17, 18, 19)]
    left, right = [(1, e - 5, e) for e in ends] + [(1, None, None)], [(1, s, s + 9) for s in starts] + [(1, None, None)]
    got = drain(spark, stream_before(
        feed(spark, tmp_path, left, "analysis_id int, r_sf long, r_ef long", 2, "l"),
        feed(spark, tmp_path, right, "analysis_id int, s_sf long, s_ef long", 2, "r"), 15, rho=2,
        left_started=base(), right_started=base(), fps=25, lateness="1000 seconds"))
    want = sorted((e, s) for e in ends for s in starts if -2 <= s - e <= 17)
    assert sorted((x.r_ef, x.s_sf) for x in got.collect()) == want
    assert got.select(F.input_file_name()).distinct().count() > 2
