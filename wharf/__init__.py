"""wharf — warehouse pipeline operators for PySpark.

Every public operator is a function from DataFrame(s) to DataFrame (or from
Column to Column) built only from Spark SQL expressions, so Catalyst can push
filters and prune columns through it and whole-stage codegen covers it.
"""

__version__ = "0.1.0"
