"""Network-threat analytics expressed as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

from wirelens.plans.traffic import Traffic

# Functions that run in Python workers travel with the plan, so executors need no installation.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["Traffic"]
