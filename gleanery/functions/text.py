"""Small text helpers."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(text: Column) -> Column:
    """Trim blanks, tabs and line ends, not only spaces."""
    return F.btrim(text, F.lit(" \t\n\r\f\x0b"))


def blank_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))
