"""Three-valued truth as 0 (false), 1 (unknown), 2 (true), and columns built on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

F_, U_, T_ = 0, 1, 2


def known(condition: Column, missing: int = U_) -> Column:
    """2 or 0 by a condition, `missing` where it is null."""
    return F.when(condition.isNull(), missing).when(condition, T_).otherwise(F_).cast("int")


#: Operators of features.
OPERATORS = "truthy eq ne in not_in gt gte lt lte contains".split()
_ORDER = {"gt": Column.__gt__, "gte": Column.__ge__, "lt": Column.__lt__, "lte": Column.__le__}


def _family(x: object) -> str:
    """number, text, list or other: values of two families are never equal and have no order."""
    if isinstance(x, T.StringType | str | T.DateType | T.TimestampType | T.TimestampNTZType | T.CharType | T.VarcharType):
        return "text"
    if isinstance(x, T.NumericType | T.BooleanType | int | float):
        return "number"
    return "list" if isinstance(x, T.ArrayType | list | tuple) else "other"


def feature(column: Column, op: str, value: object = None, missing: int = U_, kind: T.DataType | None = None) -> Column:
    """Truth of a field under an operator; `missing` where the field is null or has no order with the value.

    kind is the column's type (feature_of takes it from the table); without it the type must fit the value, and truthy
    expects a boolean.
    """
    if op not in OPERATORS:
        raise ValueError(f"unknown operator {op}")
    return known(_condition(column, op, value, kind), missing)


def feature_of(df: DataFrame, field: str, op: str, value: object = None, missing: int = U_) -> Column:
    """Truth of a field of df by its type; a field that df lacks is missing in all rows."""
    if field not in df.columns:
        feature(F.lit(None), op, value, missing, T.BooleanType())  # an unknown operator is an error all the same
        return F.lit(missing).cast("int")
    return feature(F.col("`" + field.replace("`", "``") + "`"), op, value, missing, df.schema[field].dataType)


def _condition(c: Column, op: str, value: object, kind: T.DataType | None) -> Column:
    """The condition; null where the field is null or the comparison makes no sense."""
    own = _family(kind) if kind is not None else None
    never = F.lit(None).cast("boolean")
    if own == "text" and not isinstance(kind, T.StringType):
        c = c.cast("string")
    if isinstance(kind, T.BooleanType) and op != "truthy":
        c = c.cast("int")
        value = [int(x) if isinstance(x, bool) else x for x in value] if op in ("in", "not_in") else int(value) if isinstance(value, bool) else value
    always = lambda truth: F.when(c.isNotNull(), F.lit(truth))
    if op == "truthy":
        return c if own is None or isinstance(kind, T.BooleanType) else c != 0 if own == "number" else F.length(c) > 0 if own == "text" else F.size(c) > 0 if isinstance(kind, T.ArrayType | T.MapType) else always(True)
    if op in ("in", "not_in"):
        fit = [x for x in value if own is None or _family(x) == own]
        found = c.isin(*fit) if fit else always(False)
        return found if op == "in" else ~found
    if op == "contains":
        if own == "list":
            fits = _family(kind.elementType) == _family(value)
            return F.array_contains(c, F.lit(value)) if fits else always(False)
        return c.contains(value) if own in (None, "text") and isinstance(value, str) else never
    fits = own is None or own == _family(value)
    if op in _ORDER:
        found = _ORDER[op](c, F.lit(value)) if fits and own not in ("list", "other") else never
    else:
        found = (c == F.lit(value)) if fits and own != "list" else always(False)
        found = found if op == "eq" else ~found
    if isinstance(kind, T.DoubleType | T.FloatType):  # not-a-number equals nothing and has no order
        found = F.when(F.isnan(c), F.lit(op == "ne")).otherwise(found)
    return found


def all_of(*truths: Column) -> Column:
    return F.least(*truths) if len(truths) > 1 else truths[0]


def any_of(*truths: Column) -> Column:
    return F.greatest(*truths) if len(truths) > 1 else truths[0]


def negate(truth: Column) -> Column:
    return (F.lit(2) - truth).cast("int")


def noisy_or(*p: Column) -> Column:
    """1 - (1 - p1)(1 - p2)..."""
    rest = F.lit(1.0)
    for x in p:
        rest = rest * (F.lit(1.0) - F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)))
    return F.lit(1.0) - rest


def noisy_or_of(p: Column) -> Column:
    """Noisy-OR as an aggregate over rows; partial products are combined before the shuffle."""
    return 1 - F.product(1 - F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0)))


def first_match(cases: list[tuple[Column, object]], otherwise: object) -> Column:
    """Value of the first condition that holds; a null condition does not."""
    out = F.lit(otherwise)
    for condition, value in reversed(cases):
        out = F.when(F.coalesce(condition, F.lit(False)), F.lit(value)).otherwise(out)
    return out


def posterior(successes: Column, failures: Column) -> Column:
    return (1 + successes) / (2 + successes + failures)


def beta_doubt(successes: Column, failures: Column, target: float | Column) -> Column:
    """P(accuracy < target) under Beta(1 + successes, 1 + failures): a binomial tail.

    The terms follow each other by a running logarithm, so nothing underflows and the work grows with the observations.
    """
    x = F.lit(float(target)) if not isinstance(target, Column) else target.cast("double")
    n = (successes + failures + 1).cast("int")
    odds = F.log(x) - F.log(1 - x)
    start = F.struct((n * F.log(1 - x)).alias("term"), F.lit(0.0).alias("total"))

    def step(acc: Column, j: Column) -> Column:
        total = acc["total"] + F.when(j > successes, F.exp(acc["term"])).otherwise(0.0)
        term = acc["term"] + odds + F.log((n - j).cast("double")) - F.log((j + 1).cast("double"))
        return F.struct(F.when(j < n, term).otherwise(0.0).alias("term"), total.alias("total"))

    return F.aggregate(F.sequence(F.lit(0), n), start, step, lambda a: F.least(a["total"], F.lit(1.0)))


def draw(salt: str, entity: Column) -> Column:
    """Reproducible number in [0, 1) from the first eight bytes of SHA-256."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit(f"{salt}:"), entity.cast("string")), 256), 1, 16), 16, 10).cast("decimal(20,0)").cast("double") / F.lit(2.0**64)
