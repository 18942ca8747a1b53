"""Fleet vulnerability and exposure analytics as Spark DataFrame jobs."""

from vulnspark.params import Params

__all__ = ["Params"]
