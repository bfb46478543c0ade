"""Scalar functions of the graph language, by name.

An entry takes (columns, types) and gives a Column. Wrong kinds give NULL, never an error.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import vector
from .semantics import is_float, is_int, is_list, is_num, is_text

EARTH = 6_371_000.0  # metres


def _string(c: Column, t) -> Column:
    if is_float(t):
        text = c.cast("double").cast("string")
        return F.regexp_replace(text, r"\.0$", "")
    if is_int(t) or is_text(t) or isinstance(t, T.BooleanType):
        return c.cast("string")
    return F.lit(None).cast("string")


def _text(f):
    return lambda c, t: f(*c) if is_text(t[0]) or isinstance(t[0], T.NullType) else F.lit(None).cast("string")


def _float(f):
    return lambda c, t: f(*(x.cast("double") for x in c)).cast("double") if all(is_num(x) for x in t) else F.lit(None).cast("double")


def to_integer(c: Column, t) -> Column:
    if is_text(t):
        return F.coalesce(c.try_cast("long"), F.expr("null").cast("long"), c.try_cast("double").try_cast("long"))
    return c.try_cast("long") if is_num(t) or isinstance(t, T.BooleanType) else F.lit(None).cast("long")


def to_float(c: Column, t) -> Column:
    return c.try_cast("double") if is_num(t) or is_text(t) else F.lit(None).cast("double")


def to_boolean(c: Column, t) -> Column:
    if is_text(t):
        low = F.lower(c)
        return F.when(low == "true", F.lit(True)).when(low == "false", F.lit(False))
    if is_int(t):
        return c != 0
    return c if isinstance(t, T.BooleanType) else F.lit(None).cast("boolean")


def _each(f):
    return lambda c, t: F.transform(c[0], lambda x: f(x, t[0].elementType)) if is_list(t[0]) else F.lit(None)


def _size(c, t):
    if is_text(t[0]):
        return F.octet_length(c[0]).cast("long")
    return F.when(c[0].isNotNull(), F.size(c[0])).cast("long") if is_list(t[0]) or isinstance(t[0], T.MapType) else F.lit(None).cast("long")


def _substring(c, t):
    start = c[1] + 1
    n = c[2] if len(c) > 2 else F.char_length(c[0])
    return F.when((c[1] >= 0) & (n >= 0), F.substring(c[0], start.cast("int"), n.cast("int")))


def _split(c, t):
    quote = lambda d: F.concat(F.lit("\\Q"), d, F.lit("\\E"))
    if is_list(t[1]):
        d = F.array_join(F.transform(F.filter(c[1], lambda x: x != ""), quote), "|")
    else:
        d = F.when(c[1] != "", quote(c[1])).otherwise(F.lit(""))
    return F.when(d == "", F.array(c[0])).otherwise(F.split(c[0], F.when(d != "", d).otherwise(F.lit(" ")), -1))


def _range(c, t):
    a, b = c[0].cast("long"), c[1].cast("long")
    s = c[2].cast("long") if len(c) > 2 else F.lit(1).cast("long")
    fits = ((s > 0) & (a <= b)) | ((s < 0) & (a >= b))
    some = F.sequence(F.when(fits, a).otherwise(F.lit(0)), F.when(fits, b).otherwise(F.lit(0)), F.when(fits, s).otherwise(F.lit(1)))
    return F.when(s != 0, F.when(fits, some).otherwise(F.array().cast("array<bigint>")))


def _is_empty(c, t):
    return F.char_length(c[0]) == 0 if is_text(t[0]) else F.size(c[0]) == 0


def _reverse(c, t):
    return F.reverse(c[0]) if is_text(t[0]) or is_list(t[0]) else F.lit(None)


def _null_if(c, t):
    return F.when(~c[0].eqNullSafe(c[1]), c[0])


def _normal_form(text: Column, form: Column) -> Column:
    @F.pandas_udf("string")
    def normal(texts, forms):
        import unicodedata

        known = {"NFC", "NFD", "NFKC", "NFKD"}
        pairs = zip(texts, forms.str.upper(), strict=True)
        return texts.__class__([unicodedata.normalize(f, x) if isinstance(x, str) and f in known else None for x, f in pairs], dtype=object)

    return normal(text, form)


def _normalize(c, t):
    """A Unicode normal form, NFC unless named; Spark has no such function, so it runs in Arrow batches. A form of another type counts as none."""
    if not is_text(t[0]):
        return F.lit(None).cast("string")
    form = F.coalesce(c[1], F.lit("NFC")) if len(c) > 1 and is_text(t[1]) else F.lit("NFC")
    return _normal_form(c[0], form)


def value_type(t) -> str:
    for kinds, name in (((T.BooleanType,), "BOOLEAN"), ((T.StringType,), "STRING"), ((T.ArrayType,), "LIST"), ((T.MapType, T.StructType), "MAP"), ((T.TimestampType, T.TimestampNTZType), "TIMESTAMP"), ((T.BinaryType,), "BINARY"), ((T.NullType,), "NULL")):
        if isinstance(t, kinds):
            return name
    return "INTEGER" if is_int(t) else "FLOAT" if is_float(t) else "ANY"


def point_distance(a: Column, b: Column) -> Column:
    """Great-circle metres between structs of latitude and longitude in degrees."""
    la, lb = F.radians(a["latitude"]), F.radians(b["latitude"])
    dlat, dlon = lb - la, F.radians(b["longitude"]) - F.radians(a["longitude"])
    h = F.pow(F.sin(dlat / 2), 2) + F.cos(la) * F.cos(lb) * F.pow(F.sin(dlon / 2), 2)
    return 2 * EARTH * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def active_at(valid_from: Column, valid_to: Column, t: Column) -> Column:
    """Half-open [from, to); false, not NULL, for a NULL instant."""
    return F.coalesce((valid_from <= t) & (valid_to.isNull() | (valid_to > t)), F.lit(False))


def overlaps(valid_from: Column, valid_to: Column, a: Column, b: Column) -> Column:
    return F.coalesce((valid_from < b) & (valid_to.isNull() | (valid_to > a)), F.lit(False))


CROCKFORD = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"


def element_id(i: Column) -> Column:
    """13 base-32 characters of a 64-bit id."""
    digit = lambda k: F.substring(F.lit(CROCKFORD), (F.shiftrightunsigned(i, 5 * k).bitwiseAND(F.lit(31 if k < 12 else 15)) + 1).cast("int"), F.lit(1))
    return F.concat(*[digit(k) for k in range(12, -1, -1)])


SPACE_L, SPACE_R = r"(?U)^\s+", r"(?U)\s+$"

SCALAR = {
    "coalesce": lambda c, t: F.coalesce(*c),
    "tostring": lambda c, t: _string(c[0], t[0]),
    "tostringornull": lambda c, t: _string(c[0], t[0]),
    "tostringlist": _each(_string),
    "size": _size,
    "nullif": _null_if,
    "timestamp": lambda c, t: F.unix_millis(F.current_timestamp()),
    "now": lambda c, t: F.unix_micros(F.current_timestamp()),
    "randomuuid": lambda c, t: F.uuid(),
    "rand": lambda c, t: F.rand(),
    "valuetype": lambda c, t: F.lit(value_type(t[0])),
    "tolower": _text(F.lower), "lower": _text(F.lower), "toupper": _text(F.upper), "upper": _text(F.upper),
    "trim": _text(lambda s: F.regexp_replace(F.regexp_replace(s, SPACE_L, ""), SPACE_R, "")),
    "btrim": _text(lambda s: F.regexp_replace(F.regexp_replace(s, SPACE_L, ""), SPACE_R, "")),
    "ltrim": _text(lambda s: F.regexp_replace(s, SPACE_L, "")),
    "rtrim": _text(lambda s: F.regexp_replace(s, SPACE_R, "")),
    "left": _text(lambda s, n: F.when(n >= 0, F.left(s, n))),
    "right": _text(lambda s, n: F.when(n >= 0, F.right(s, n))),
    "substring": _substring,
    "replace": _text(lambda s, a, b: F.replace(s, a, b)),
    "reverse": _reverse,
    "split": _split,
    "normalize": _normalize,
    "charlength": _text(lambda s: F.char_length(s).cast("long")),
    "character_length": _text(lambda s: F.char_length(s).cast("long")),
    "pi": lambda c, t: F.lit(3.141592653589793), "e": lambda c, t: F.lit(2.718281828459045),
    "abs": lambda c, t: F.abs(c[0]) if is_num(t[0]) else F.lit(None),
    "ceil": _float(F.ceil), "floor": _float(F.floor), "round": _float(F.round),
    "sign": lambda c, t: F.sign(c[0].cast("double")).cast("long") if is_num(t[0]) else F.lit(None).cast("long"),
    "sqrt": _float(F.sqrt), "exp": _float(F.exp),
    "log": _float(lambda x: F.when(x > 0, F.ln(x)).when(x == 0, F.lit(float("-inf"))).when(x < 0, F.lit(float("nan")))),
    "log10": _float(lambda x: F.when(x > 0, F.log10(x)).when(x == 0, F.lit(float("-inf"))).when(x < 0, F.lit(float("nan")))),
    "isnan": lambda c, t: F.isnan(c[0]) if is_float(t[0]) else F.when(c[0].isNotNull(), F.lit(False)),
    "tointeger": lambda c, t: to_integer(c[0], t[0]), "tointegerornull": lambda c, t: to_integer(c[0], t[0]), "tointegerlist": _each(to_integer),
    "tofloat": lambda c, t: to_float(c[0], t[0]), "tofloatornull": lambda c, t: to_float(c[0], t[0]), "tofloatlist": _each(to_float),
    "toboolean": lambda c, t: to_boolean(c[0], t[0]), "tobooleanornull": lambda c, t: to_boolean(c[0], t[0]), "tobooleanlist": _each(to_boolean),
    "sin": _float(F.sin), "cos": _float(F.cos), "tan": _float(F.tan), "cot": _float(F.cot), "asin": _float(F.asin), "acos": _float(F.acos), "atan": _float(F.atan), "atan2": _float(F.atan2), "degrees": _float(F.degrees), "radians": _float(F.radians),
    "haversin": _float(lambda x: (1 - F.cos(x)) / 2),
    "head": lambda c, t: F.try_element_at(c[0], F.lit(1)), "last": lambda c, t: F.try_element_at(c[0], F.lit(-1)),
    "tail": lambda c, t: F.slice(c[0], 2, F.greatest(F.size(c[0]), F.lit(1))),
    "isempty": _is_empty,
    "range": _range,
    "point": lambda c, t: c[0],
    "point.distance": lambda c, t: point_distance(*c),
    "maxsim_score": lambda c, t: vector.maxsim_score(*c),
}
SCALAR["ln"] = SCALAR["log"]
SCALAR["char_length"] = SCALAR["charlength"]
for _name, _measure in vector.MEASURES.items():
    SCALAR[_name] = lambda c, t, f=_measure: f(*c)
