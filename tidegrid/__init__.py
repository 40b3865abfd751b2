"""Spark-first analytics over interval-priced time series."""

import sys

from pyspark import cloudpickle

from tidegrid.params import BatteryParams, TariffPlan
from tidegrid.session import build_session

# Functions that run on the workers travel with their code: the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["BatteryParams", "TariffPlan", "build_session"]
