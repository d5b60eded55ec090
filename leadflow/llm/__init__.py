"""Operators of a training-data pipeline, one module each."""

import sys

from pyspark import cloudpickle

# Executors need not have this repository: functions of this package travel with their tasks.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
