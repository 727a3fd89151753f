"""Daily-series analytics as Spark jobs.

Every operator is a function ``DataFrame(s) + parameters -> DataFrame``.  The
canonical table is long: one row per ``(line, date)`` with a ``value``.
"""
