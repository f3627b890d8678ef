"""Discovery of structure in numeric tables with Spark."""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# functions sent to executors carry their code along, so a cluster needs no install of this package
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])

from .operators.combine import get_column_combinations  # noqa: E402
from .plans.complexity import complexity  # noqa: E402
from .plans.predictability import (  # noqa: E402
    predictability_plot, refine_predictability, run_predictability, tuple_selection)
from .plans.relevance import relevance  # noqa: E402

__all__ = ["complexity", "get_column_combinations", "predictability_plot", "refine_predictability", "relevance",
           "run_predictability", "tuple_selection"]
