"""Value rules in which the graph language differs from SQL.

Each function takes Columns and their Spark types where a rule depends on them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

INTS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FLOATS = (T.FloatType, T.DoubleType)
LONG_MIN, LONG_MAX = -(1 << 63), (1 << 63) - 1


def is_int(t) -> bool:
    return isinstance(t, INTS)


def is_float(t) -> bool:
    return isinstance(t, FLOATS)


def is_num(t) -> bool:
    return is_int(t) or is_float(t)


def is_text(t) -> bool:
    return isinstance(t, T.StringType)


def is_list(t) -> bool:
    return isinstance(t, T.ArrayType)


def null() -> Column:
    return F.lit(None)


def add(a: Column, b: Column, ta, tb) -> Column:
    """Saturating on integers; joins texts and lists; NULL for other kinds."""
    if is_list(ta) and is_list(tb):
        return F.concat(a, b)
    if is_list(ta):
        return F.array_append(a, b)
    if is_list(tb):
        return F.array_prepend(b, a)
    if is_text(ta) and is_text(tb):
        return F.concat(a, b)
    if is_int(ta) and is_int(tb):
        a, b = a.cast("long"), b.cast("long")
        bound = F.when(a > 0, F.lit(LONG_MAX)).otherwise(F.lit(LONG_MIN))
        return F.coalesce(F.try_add(a, b), F.when(a.isNotNull() & b.isNotNull(), bound))
    return a + b if is_num(ta) and is_num(tb) else null()


def subtract(a: Column, b: Column, ta, tb) -> Column:
    if is_int(ta) and is_int(tb):
        a, b = a.cast("long"), b.cast("long")
        bound = F.when(b < 0, F.lit(LONG_MAX)).otherwise(F.lit(LONG_MIN))
        return F.coalesce(F.try_subtract(a, b), F.when(a.isNotNull() & b.isNotNull(), bound))
    return a - b if is_num(ta) and is_num(tb) else null()


def multiply(a: Column, b: Column, ta, tb) -> Column:
    if is_int(ta) and is_int(tb):
        a, b = a.cast("long"), b.cast("long")
        bound = F.when((a > 0) == (b > 0), F.lit(LONG_MAX)).otherwise(F.lit(LONG_MIN))
        return F.coalesce(F.try_multiply(a, b), F.when(a.isNotNull() & b.isNotNull(), bound))
    return a * b if is_num(ta) and is_num(tb) else null()


def divide(a: Column, b: Column, ta, tb) -> Column:
    """Integers truncate; by zero is NULL."""
    if is_int(ta) and is_int(tb):
        a, b = a.cast("long"), b.cast("long")
        safe = F.when((b != 0) & ~((a == LONG_MIN) & (b == -1)), b)
        whole = F.call_function("div", a, safe)
        return F.coalesce(whole, F.when((a == LONG_MIN) & (b == -1), F.lit(LONG_MAX)))
    return F.try_divide(a.cast("double"), b.cast("double")) if is_num(ta) and is_num(tb) else null()


def modulo(a: Column, b: Column, ta, tb) -> Column:
    """Integers only; by zero is NULL."""
    return F.when(b != 0, a) % F.when(b != 0, b) if is_int(ta) and is_int(tb) else null()


def negate(a: Column, ta) -> Column:
    if is_int(ta):
        a = a.cast("long")
        return F.when(a == LONG_MIN, F.lit(LONG_MAX)).otherwise(-F.when(a != LONG_MIN, a))
    return -a if is_float(ta) else null()


def comparable(ta, tb) -> bool:
    return is_num(ta) and is_num(tb) or type(ta) is type(tb) or isinstance(ta, T.NullType) or isinstance(tb, T.NullType)


def equal(a: Column, b: Column, ta, tb, strict: bool = False) -> Column:
    """strict: an integer never equals a float."""
    if not comparable(ta, tb) or strict and is_num(ta) and is_num(tb) and is_int(ta) != is_int(tb):
        return F.when(a.isNotNull() & b.isNotNull(), F.lit(False))
    return a == b


def order(op: str, a: Column, b: Column, ta, tb) -> Column:
    """Values of kinds that do not compare are neither less nor greater."""
    if not comparable(ta, tb):
        return F.lit(False)
    return {"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]


def both(op: str, a: Column, b: Column) -> Column:
    """AND, OR, XOR: NULL if either side is."""
    value = {"AND": a & b, "OR": a | b, "XOR": a != b}[op]
    return F.when(a.isNotNull() & b.isNotNull(), value)


def truth(a: Column, t) -> Column:
    """What WHERE keeps: true, and any value that is no boolean."""
    return F.coalesce(a, F.lit(False)) if isinstance(t, (T.BooleanType, T.NullType)) else a.isNotNull()


def contained(x: Column, items: Column, t) -> Column:
    """Never NULL for a list: NULL is found in a list that holds it."""
    return F.when(items.isNotNull(), F.exists(items, lambda e: e.eqNullSafe(x))) if is_list(t) else F.lit(None).cast("boolean")


def subscript(a: Column, i: Column, t) -> Column:
    """Negative positions count from the end; outside is NULL."""
    if is_list(t):
        return F.get(a, F.when(i < 0, i + F.size(a)).otherwise(i).cast("int"))
    if isinstance(t, T.MapType):
        return F.try_element_at(a, i)
    return null()


def list_slice(a: Column, start: Column | None, stop: Column | None) -> Column:
    n = F.size(a)
    fit = lambda x, d: F.lit(d) if x is None else F.least(F.greatest(F.when(x < 0, x + n).otherwise(x), F.lit(0)), n)
    lo, hi = fit(start, 0).cast("int"), (n if stop is None else fit(stop, 0)).cast("int")
    return F.slice(a, lo + 1, F.greatest(hi - lo, F.lit(0)))
