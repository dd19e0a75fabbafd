"""loadshape: household interval-meter analytics and tariff-adoption study on Spark.

Every public function takes and returns lazy ``pyspark.sql.DataFrame`` objects
built from built-in Spark SQL expressions; nothing runs until a sink or an
action is called by the caller.
"""

__all__ = ["schemas", "session"]
