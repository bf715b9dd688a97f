"""Panel time-series regression as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# The small numeric helpers travel inside the serialised UDFs, so executors need no install.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

from periodica.errors import (
    FrequencyError,
    ImportFailed,
    IntersectionError,
    InvariantError,
    OverspecifiedError,
)
from periodica.operators.align import PanelDataset, align
from periodica.plans.models import (
    AutoARIMARegression,
    BruteForceARIMARegression,
    SARIMARegression,
    make_model,
)
from periodica.plans.run import RunConfig, run_all

__all__ = [
    "AutoARIMARegression",
    "BruteForceARIMARegression",
    "FrequencyError",
    "ImportFailed",
    "IntersectionError",
    "InvariantError",
    "OverspecifiedError",
    "PanelDataset",
    "RunConfig",
    "SARIMARegression",
    "align",
    "make_model",
    "run_all",
]
