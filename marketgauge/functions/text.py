"""String columns: pack content, labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The two shapes a pack content may have.
NUMERIC_CONTENT = r"^\d+(\.\d+)?$"
MULTIPLIER_CONTENT = r"^\d+(\.\d+)?([Xx]\d+(\.\d+)?)+$"


# Fixed value: how a number may be written. Forms that only one engine reads (10D, inf) are none.
NUMBER = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"


def parse_number(c: Column) -> Column:
    """A double from plain decimal text, else NULL."""
    text = F.trim(c)
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


def parse_content(c, mode: str = "int") -> Column:
    """Pack size as a double: "10" is 10, "5X10" is 50, anything else NULL.

    mode "int" cuts each factor of a product to a whole number first ("30X0.6" is 0);
    mode "float" keeps it (18.0).
    """
    text = F.upper(F.trim(F.col(c) if isinstance(c, str) else c))
    factors = F.transform(F.split(text, "X"), parse_number)
    if mode == "int":
        factors = F.transform(factors, lambda p: F.when(p >= 0, F.floor(p)).otherwise(F.ceil(p))
                              .cast("double"))
    product = F.aggregate(factors, F.lit(1.0), lambda acc, p: acc * p)
    return F.when(text.contains("X"), product).otherwise(parse_number(text))


def classify_content(c) -> Column:
    """missing, numeric, multiplier or unknown."""
    c = F.col(c) if isinstance(c, str) else c
    text = F.trim(c)
    return (F.when(c.isNull(), "missing")
            .when(text.rlike(NUMERIC_CONTENT), "numeric")
            .when(text.rlike(MULTIPLIER_CONTENT), "multiplier")
            .otherwise("unknown"))


def normalize_text(c, missing: str = "UNKNOWN") -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.upper(F.trim(c)), F.lit(missing))
