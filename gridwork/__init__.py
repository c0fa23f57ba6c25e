"""gridwork: everyday table analytics as Spark DataFrame operators.

Layout
------
sources/    readers for the driver tables, CSV with an explicit schema, inline tables
functions/  Column -> Column helpers with Python/NumPy semantics pinned down
operators/  DataFrame -> DataFrame operators (filters, joins, aggregates, nulls, ...)
plans/      the named analysis queries built from the operators, with oracle SQL
streaming/  running the Column-level functions on a streaming source
"""

from gridwork.session import get_session

__all__ = ["get_session"]
