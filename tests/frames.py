"""Small hand frames."""

import datetime as dt

START = dt.date(2025, 1, 1)


def day(k):
    return START + dt.timedelta(days=k)


def series(spark, columns, start=START):
    """``{line: [values]}`` as the daily table; ``None`` is a null."""
    rows = [(start + dt.timedelta(days=k), line, None if v is None else float(v))
            for line, values in columns.items() for k, v in enumerate(values)]
    return spark.createDataFrame(rows, "date date, line string, value double")


def by_key(df, *columns):
    """Collected rows as ``{first columns: last column}``."""
    rows = df.select(*columns).collect()
    return {r[0] if len(columns) == 2 else tuple(r[:-1]): r[-1] for r in rows}
