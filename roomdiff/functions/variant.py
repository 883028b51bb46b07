"""Reading JSON whose shape is not trusted: a value of another type than asked for is null, never coerced."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBERS = ("BIGINT", "DOUBLE", "FLOAT", "DECIMAL")


def kind(v: Column) -> Column:
    """OBJECT, ARRAY, STRING, BOOLEAN, VOID or one of NUMBERS; null where there is nothing."""
    return F.regexp_extract(F.schema_of_variant(v), r"^[A-Z]+", 0)


def part(v: Column, path: str) -> Column:
    return F.variant_get(v, path, "variant")


def is_number(v: Column) -> Column:
    return F.coalesce(kind(v).isin(*NUMBERS), F.lit(False))


def is_kind(v: Column, name: str) -> Column:
    return F.coalesce(kind(v) == name, F.lit(False))


def is_null(v: Column) -> Column:
    """Absent, or a JSON null."""
    return v.isNull() | is_kind(v, "VOID")


def number(v: Column, path: str = "$", to: str = "double") -> Column:
    return F.when(is_number(part(v, path)), F.try_variant_get(v, path, to))


def text(v: Column, path: str = "$") -> Column:
    return F.when(is_kind(part(v, path), "STRING"), F.try_variant_get(v, path, "string"))


def items(v: Column, path: str = "$") -> Column:
    return F.when(is_kind(part(v, path), "ARRAY"), F.try_variant_get(v, path, "array<variant>"))


def fields(v: Column, path: str = "$") -> Column:
    return F.when(is_kind(part(v, path), "OBJECT"), F.try_variant_get(v, path, "map<string,variant>"))


def numbers(v: Column, path: str = "$", length: int | None = None) -> Column:
    """An array of numbers (of the given length), or null when any entry is something else."""
    got = items(v, path)
    ok = F.forall(got, lambda e: is_number(e))
    if length is not None:
        ok = ok & (F.size(got) == length)
    return F.when(ok, F.transform(got, lambda e: number(e)))


def rule(broken: Column, path: Column | str, message: Column | str) -> Column:
    """One checked rule: STRUCT<path, message> where it is broken, null where it holds."""
    lit = lambda c: c if isinstance(c, Column) else F.lit(c)
    return F.when(F.coalesce(broken, F.lit(False)), F.struct(lit(path).alias("path"), lit(message).alias("message")))


def broken_rules(df, rules: list[Column]):
    """(set_id, path, message) of every rule broken."""
    kept = F.filter(F.array(*rules), lambda r: r.isNotNull())
    return df.select("set_id", F.inline(kept))
