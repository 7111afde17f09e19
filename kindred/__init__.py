"""Kindred: catalog similarity and content-based recommendation on PySpark.

Every operator is a ``DataFrame -> DataFrame`` (or ``Column -> Column``)
function; the three jobs in :mod:`kindred.plans` compose them.
"""

import sys

from pyspark import cloudpickle

# Arrow functions run in Python workers. Shipping this package by value means a
# cluster needs no separate install or ``--py-files`` for them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
