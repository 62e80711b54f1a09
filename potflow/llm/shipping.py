"""Objects of this package for tasks."""

from __future__ import annotations

import pickle

from pyspark import cloudpickle


class Shipped:
    """An object as a broadcast of its bytes. Its class goes with it, so executors need no copy of the package; a broadcast
    of the object itself would name the class only."""

    def __init__(self, spark, value):
        self.bytes = spark.sparkContext.broadcast(cloudpickle.dumps(value))

    def load(self):
        """The object, made anew: once in a task."""
        return pickle.loads(self.bytes.value)
