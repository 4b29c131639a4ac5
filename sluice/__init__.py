"""Sluice: two-stage detector triage analytics as Spark DataFrame jobs.

A cheap router scores every text, rows at or below a threshold skip an expensive
judge, and this package measures, calibrates and guards that decision.
"""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with the job, so executors need no install.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
