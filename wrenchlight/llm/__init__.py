"""Operators of a training-data pipeline; one module each, over documents(doc_id, text, …), pages and conversations."""

import os
import sys

from pyspark import cloudpickle

# Workers import this package where it is installed or on PYTHONPATH; elsewhere its functions travel with each task.
if os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))) not in os.environ.get("PYTHONPATH", ""):
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
