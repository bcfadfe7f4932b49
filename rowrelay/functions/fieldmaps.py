"""Expressions on maps: the field map of a row and the attributes of a batch."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

from rowrelay.schema import FIELD_MAP, FIELD_META, READY

_TENSOR_TYPES = (T.NumericType, T.BooleanType)


def merge_right(left: Column, right: Column) -> Column:
    """Union of two maps; where both have a key the right one wins."""
    kept = F.map_filter(left, lambda k, _: ~F.map_contains_key(right, k))
    return F.map_concat(kept, right)


def field_meta(dtype: Column, shape: Column, status: Column) -> Column:
    return F.struct(
        dtype.cast("string").alias("dtype"),
        shape.cast("array<int>").alias("shape"),
        status.cast("tinyint").alias("production_status"),
    ).cast(FIELD_META)


def empty_fields() -> Column:
    return F.map_from_arrays(F.array().cast("array<string>"), F.array().cast(T.ArrayType(FIELD_META))).cast(FIELD_MAP)


def constant_fields(names: list[str], status: int) -> Column:
    """The same field map for every row, without dtype and shape."""
    names = list(dict.fromkeys(names))
    if not names:
        return empty_fields()
    null = F.lit(None)
    pairs = [part for n in names for part in (F.lit(n), field_meta(null, null, F.lit(status)))]
    return F.create_map(*pairs).cast(FIELD_MAP)


def is_ndarray(kind: T.DataType) -> bool:
    """STRUCT<shape ARRAY<INT>, data ...>: the form of a tensor of rank two and more."""
    return isinstance(kind, T.StructType) and kind.fieldNames() == ["shape", "data"]


def _element_type(kind: T.DataType) -> T.DataType:
    return kind.elementType if isinstance(kind, T.ArrayType) else kind


def is_tensor(kind: T.DataType) -> bool:
    if is_ndarray(kind):
        data = kind["data"].dataType
        return isinstance(data, T.BinaryType) or isinstance(_element_type(data), _TENSOR_TYPES)
    return isinstance(_element_type(kind), _TENSOR_TYPES)


def cell_dtype(column: Column, kind: T.DataType) -> Column:
    """Element type of a tensor cell, NULL for text, objects and unset cells."""
    if not is_tensor(kind):
        return F.lit(None).cast("string")
    element = _element_type(kind["data"].dataType if is_ndarray(kind) else kind)
    name = "uint8" if isinstance(element, T.BinaryType) else element.simpleString()
    return F.when(column.isNotNull(), F.lit(name))


def cell_shape(column: Column, kind: T.DataType) -> Column:
    """Shape of a tensor cell: empty for a scalar, NULL when it has no dtype."""
    if not is_tensor(kind):
        return F.lit(None).cast("array<int>")
    if is_ndarray(kind):
        return column.getField("shape").cast("array<int>")
    if isinstance(kind, T.ArrayType):
        return F.when(column.isNotNull(), F.array(F.size(column)))
    return F.when(column.isNotNull(), F.array().cast("array<int>"))


def extract_fields(schema: T.StructType, names: list[str], status: int = READY) -> Column:
    """One field map per row with the dtype and shape of each named column."""
    if not names:
        return empty_fields()
    pairs = []
    for n in names:
        c, kind = F.col(f"`{n}`"), schema[n].dataType
        pairs += [F.lit(n), field_meta(cell_dtype(c, kind), cell_shape(c, kind), F.lit(status))]
    return F.create_map(*pairs).cast(FIELD_MAP)


# --- tests and look-ups on one row -------------------------------------------------


def field_names(fields: Column) -> Column:
    return F.map_keys(fields)


def get_field(fields: Column, name: str) -> Column:
    return F.try_element_at(fields, F.lit(name))


def has_field(fields: Column, name: str) -> Column:
    return F.map_contains_key(fields, name)


def is_field_ready(fields: Column, name: str) -> Column:
    return F.coalesce(get_field(fields, name)["production_status"] == READY, F.lit(False))


def is_row_ready(fields: Column) -> Column:
    """All fields ready; a row without fields is ready."""
    return F.forall(F.map_values(fields), lambda f: F.coalesce(f["production_status"] == READY, F.lit(False)))


def production_status(fields: Column) -> Column:
    return F.transform_values(fields, lambda _, f: f["production_status"])


def render_fields(fields: Column) -> Column:
    """Field map as text ``name:dtype:shape:status,...`` in name order, for reports."""

    def one(e):
        meta = e["value"]
        return F.concat_ws(
            ":",
            e["key"],
            F.coalesce(meta["dtype"], F.lit("-")),
            F.coalesce(F.concat(F.lit("["), F.array_join(meta["shape"].cast("array<string>"), "x"), F.lit("]")), F.lit("-")),
            meta["production_status"].cast("string"),
        )

    names = F.array_sort(F.map_keys(fields))
    return F.array_join(
        F.transform(names, lambda n: one(F.struct(n.alias("key"), F.element_at(fields, n).alias("value")))), ","
    )
