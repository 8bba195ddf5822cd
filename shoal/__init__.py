"""shoal: Spark-first operators for event logs, telemetry, rankings and log text."""

import sys

from pyspark import cloudpickle

# Python workers get the library's functions with the task, so executors need no copy of it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
