"""Repository, document and usage-log analytics on Spark.

Operators are functions from DataFrames to DataFrames. Nothing here holds a session of its own; see
``loomfield.session`` for the settings that the queries expect.
"""

__version__ = "0.1.0"
