"""tidewater: batch reports, log-stream extraction and run-history analytics on PySpark.

Everything is expressed with the DataFrame API, Spark SQL functions and
Structured Streaming so Catalyst and Tungsten plan the work.
"""

__all__ = ["session"]
