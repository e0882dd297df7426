"""Interval-event analytics on Spark DataFrames.

Observations become labelled intervals, intervals are combined with
parametrised temporal joins, and the detections are scored.  Every public
function takes and returns lazy DataFrames (or Columns), so Catalyst plans the
whole of a job at once.
"""

import sys

from pyspark import cloudpickle

from spanloom.operators.temporal import Temporal, temporal_join

# The few functions that run in Python workers travel with the job, so executors
# need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["Temporal", "temporal_join"]
