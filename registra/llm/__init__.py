"""Operators of a training-data pipeline over documents; nothing else in the library imports this package."""

from pyspark import cloudpickle

import registra

# Python workers get the functions themselves, so the package need not be installed on executors.
cloudpickle.register_pickle_by_value(registra)
