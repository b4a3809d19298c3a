"""Dotted paths over typed columns, nested structs or VARIANT documents.

A field knows where its value is present, null, a number, a text or a truth value. In typed columns SQL's NULL stands for
an absent field or, where a binding says so, for a null. VARIANT documents tell the two apart.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NO, YES = F.lit, F.lit


@dataclass(frozen=True)
class Field:
    value: Column
    type: T.DataType | None  # None: absent everywhere
    present: Column
    null: Column

    @property
    def family(self) -> str:
        t = self.type
        if t is None:
            return "absent"
        for kind, name in ((T.NumericType, "number"), (T.StringType, "text"), (T.BooleanType, "bool"), (T.ArrayType, "array"), (T.StructType, "object"), (T.VariantType, "variant"), (T.TimestampType, "time"), (T.TimestampNTZType, "time"), (T.DateType, "time")):
            if isinstance(t, kind):
                return name
        return "other"

    def tag(self) -> Column:
        return F.schema_of_variant(self.value)

    def number(self) -> Column:
        """As a double; null where the value isn't a number."""
        if self.family == "variant":
            return F.when(self.tag().rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), F.try_variant_get(self.value, "$", "double"))
        return self.value.cast("double") if self.family == "number" else F.lit(None).cast("double")

    def text(self) -> Column:
        if self.family == "variant":
            return F.when(self.tag() == "STRING", F.try_variant_get(self.value, "$", "string"))
        return self.value if self.family == "text" else F.lit(None).cast("string")

    def truth(self) -> Column:
        if self.family == "variant":
            return F.when(self.tag() == "BOOLEAN", F.try_variant_get(self.value, "$", "boolean"))
        return self.value if self.family == "bool" else F.lit(None).cast("boolean")

    def aggregable(self) -> Column:
        """Numbers and decimal texts as finite doubles; null for anything else."""
        if self.family == "number":
            x = self.value.cast("double")
            return x if isinstance(self.type, (T.IntegralType, T.DecimalType)) else F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)
        text = self.text()
        x = F.coalesce(self.number(), F.when(F.trim(text).rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), F.trim(text).try_cast("double")))
        return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)

    def canonical(self) -> Column:
        """A comparable form: typed values as they are, variants as text with a tag of their family."""
        if self.family != "variant":
            return self.value
        return F.when(self.null, "null").otherwise(F.coalesce(F.concat(F.lit("n:"), self.number().cast("string")), F.concat(F.lit("s:"), self.text()), F.concat(F.lit("j:"), F.to_json(self.value))))


def absent() -> Field:
    return Field(F.lit(None).cast("string"), None, F.lit(False), F.lit(False))


@dataclass(frozen=True)
class Scope:
    """Where paths start: a row's columns, an array's element or a VARIANT document."""

    schema: T.StructType | None
    get: Callable[[str], Column]
    nulls_present: bool = False
    variant: Column | None = None
    key: Column | None = None

    def field(self, path: str) -> Field:
        if path in ("_key", "$key") and self.key is not None:
            return Field(self.key, T.StringType(), self.key.isNotNull(), F.lit(False))
        if self.variant is not None and (self.schema is None or path.split(".")[0] not in self.schema.names):
            found = F.try_variant_get(self.variant, "$" + "".join(f"['{p}']" for p in path.split(".")), "variant")
            null = F.coalesce(F.is_variant_null(found), F.lit(False))
            return Field(found, T.VariantType(), found.isNotNull(), null)
        first, *rest = path.split(".")
        if self.schema is None or first not in self.schema.names:
            return absent()
        value, kind, parent = self.get(first), self.schema[first].dataType, None
        for i, step in enumerate(rest):
            if isinstance(kind, T.VariantType):
                return Scope(None, self.get, self.nulls_present, value).field(".".join(rest[i:]))
            if not isinstance(kind, T.StructType) or step not in kind.names:
                return absent()
            parent, value, kind = value, value.getField(step), kind[step].dataType
        if isinstance(kind, T.VariantType):
            return Field(value, kind, value.isNotNull(), F.coalesce(F.is_variant_null(value), F.lit(False)))
        if self.nulls_present:
            there = F.lit(True) if parent is None else parent.isNotNull()
            return Field(value, kind, there, there & value.isNull())
        return Field(value, kind, value.isNotNull(), F.lit(False))


def row_scope(df, nulls_present: bool = False, variant: str | None = None) -> Scope:
    quoted = lambda n: F.col(f"`{n}`")
    key = quoted("_key") if "_key" in df.columns else None
    return Scope(df.schema, quoted, nulls_present, quoted(variant) if variant else None, key)


def element_scope(element: Column, kind: T.StructType, nulls_present: bool = False) -> Scope:
    return Scope(kind, element.getField, nulls_present, None, element.getField("_key") if "_key" in kind.names else None)
