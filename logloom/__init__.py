"""logloom - DataFrame operators for machine logs and telemetry on Spark.

Sub-packages
------------
``functions``   Column -> Column helpers (text, time, conditions, search text)
``operators``   DataFrame -> DataFrame operators (filters, joins, windows, statistics)
``sources``     readers and writers for log, event, signal and bundle files
``plans``       compositions of operators that answer one investigation question
``streaming``   the operators that also run on Structured Streaming
"""

import sys

from pyspark import cloudpickle

from logloom.session import build_session, scratch_dir

__all__ = ["build_session", "scratch_dir"]

# Python functions travel to the executors with the job, so a cluster needs no
# installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
