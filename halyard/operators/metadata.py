"""Metadata of ids, and boolean filters over it.

Metadata is a table (id, field, kind, int_val, float_val, str_val, bool_val), one row for each field of an id. A filter
is an expression tree that compiles to one boolean Column over a map of an id's fields. Filters are two-valued: a
missing field or a wrong type is false, its negation true; an id without any metadata never matches.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

METADATA = "id long, field string, kind string, int_val long, float_val double, str_val string, bool_val boolean"
Value = int | float | str | bool


def tagged(value: Value) -> tuple:
    """(kind, int, float, string, bool) of a value; bool comes before int, of which it is a subclass."""
    if isinstance(value, bool):
        return ("bool", None, None, None, value)
    if isinstance(value, int):
        return ("int", value, None, None, None)
    if isinstance(value, float):
        return ("float", None, value, None, None)
    if isinstance(value, str):
        return ("str", None, None, value, None)
    raise TypeError(f"unsupported metadata value type {type(value).__name__}: expected int, float, str or bool")


class Filter:
    """A filter expression; compile() gives the Column over `meta`, a map from field to tagged value."""

    def compile(self, meta: Column) -> Column:
        raise NotImplementedError

    def fields(self) -> set[str]:
        """The fields that the expression reads."""
        found = set()
        for part in self.__dict__.values():
            found |= part.fields() if isinstance(part, Filter) else set()
        return found | ({self.field} if "field" in self.__dict__ else set())

    def __and__(self, other: Filter) -> Filter:
        return And(self, other)

    def __or__(self, other: Filter) -> Filter:
        return Or(self, other)

    def __invert__(self) -> Filter:
        return Not(self)


def _number(v: Column) -> Column:
    """The value as a double, null unless it is a number."""
    return F.when(v["kind"] == "int", v["int_val"].cast("double")).when(v["kind"] == "float", v["float_val"])


@dataclass(frozen=True)
class Eq(Filter):
    field: str
    value: Value

    def compile(self, meta: Column) -> Column:
        v = F.try_element_at(meta, F.lit(self.field))
        kind, i, f, s, b = tagged(self.value)
        if kind == "int":
            same = ((v["kind"] == "int") & (v["int_val"] == i)) | ((v["kind"] == "float") & ~F.isnan(v["float_val"]) & (v["float_val"] == float(i)))
        elif kind == "float":
            same = F.lit(False) if f != f else ~F.isnan(_number(v)) & (_number(v) == f)
        elif kind == "str":
            same = (v["kind"] == "str") & (v["str_val"] == s)
        else:
            same = (v["kind"] == "bool") & (v["bool_val"] == b)
        return F.coalesce(same, F.lit(False))


@dataclass(frozen=True)
class _Order(Filter):
    field: str
    value: Value

    def compile(self, meta: Column) -> Column:
        kind, i, f, _, _ = tagged(self.value)
        if kind not in ("int", "float") or f != f:
            return F.lit(False)
        x, bound = _number(F.try_element_at(meta, F.lit(self.field))), F.lit(float(self.value))
        return F.coalesce(~F.isnan(x) & (x > bound if isinstance(self, Gt) else x < bound), F.lit(False))


class Gt(_Order):
    """Greater, for numbers, as doubles."""


class Lt(_Order):
    """Less, for numbers, as doubles."""


@dataclass(frozen=True)
class And(Filter):
    left: Filter
    right: Filter

    def compile(self, meta: Column) -> Column:
        return self.left.compile(meta) & self.right.compile(meta)


@dataclass(frozen=True)
class Or(Filter):
    left: Filter
    right: Filter

    def compile(self, meta: Column) -> Column:
        return self.left.compile(meta) | self.right.compile(meta)


@dataclass(frozen=True)
class Not(Filter):
    inner: Filter

    def compile(self, meta: Column) -> Column:
        return ~self.inner.compile(meta)


#: Operators of the tuple notation: their node, and how many elements the tuple has.
_NODES = {"eq": (Eq, 3), "gt": (Gt, 3), "lt": (Lt, 3), "and": (And, 3), "or": (Or, 3), "not": (Not, 2)}
_SHAPES = {"eq": "('eq', field_name, value)", "gt": "('gt', field_name, value)", "lt": "('lt', field_name, value)", "and": "('and', filter_a, filter_b)", "or": "('or', filter_a, filter_b)", "not": "('not', filter_expr)"}


def parse_filter(expr: tuple | Filter) -> Filter:
    """A filter from nested tuples such as ("and", ("eq", "lang", "en"), ("gt", "n", 5))."""
    if isinstance(expr, Filter):
        return expr
    if not isinstance(expr, tuple):
        raise ValueError("filter must be a tuple")
    if not expr:
        raise ValueError("filter tuple cannot be empty")
    name = expr[0].lower() if isinstance(expr[0], str) else expr[0]
    if name not in _NODES:
        raise ValueError(f"unknown filter operator '{expr[0]}': expected 'eq', 'gt', 'lt', 'and', 'or', or 'not'")
    node, size = _NODES[name]
    if len(expr) != size:
        raise ValueError(f"'{name}' filter expects {size} elements {_SHAPES[name]}, got {len(expr)}")
    if name in ("and", "or", "not"):
        return node(*map(parse_filter, expr[1:]))
    if not isinstance(expr[1], str):
        raise ValueError("filter field name must be a string")
    tagged(expr[2])
    return node(expr[1], expr[2])


def _value() -> Column:
    """A tagged value as one struct."""
    return F.struct("kind", "int_val", "float_val", "str_val", "bool_val")


@dataclass(frozen=True)
class MetadataStore:
    """A table of metadata; changes return a new store. Of repeated fields of an id, the row of the highest seq counts."""

    rows: DataFrame  # METADATA and seq

    @staticmethod
    def create(spark: SparkSession) -> MetadataStore:
        return MetadataStore(spark.createDataFrame([], METADATA + ", seq long"))

    @staticmethod
    def from_columns(df: DataFrame, id_col: str, fields: list[str]) -> MetadataStore:
        """Each column of fields becomes a field; nulls are missing fields."""
        kinds, entries = dict(df.dtypes), []
        held = {"int": ("int_val", "long"), "float": ("float_val", "double"), "str": ("str_val", "string"), "bool": ("bool_val", "boolean")}
        for f in fields:
            t = kinds[f]
            kind = "bool" if t == "boolean" else "int" if t in ("tinyint", "smallint", "int", "bigint") else "str" if t == "string" else "float"
            values = [(F.col(f) if k == kind else F.lit(None)).cast(kt).alias(n) for k, (n, kt) in held.items()]
            entries.append(F.when(F.col(f).isNotNull(), F.struct(F.lit(f).alias("field"), F.lit(kind).alias("kind"), *values)))
        # One pass over the table, whatever the number of fields.
        rows = df.select(F.col(id_col).cast("long").alias("id"), F.explode(F.array_compact(F.array(*entries))).alias("e"))
        return MetadataStore(rows.select("id", "e.*", F.lit(0).cast("long").alias("seq")))

    def set(self, id: int, field: str, value: Value) -> MetadataStore:
        top = self.rows.agg(F.max("seq")).first()[0]
        row = self.rows.sparkSession.createDataFrame([(id, field, *tagged(value), (top or 0) + 1)], METADATA + ", seq long")
        return MetadataStore(self.rows.unionByName(row))

    def latest(self) -> DataFrame:
        """The last value of each field of each id: a grouped maximum with map-side partial results."""
        last = self.rows.groupBy("id", "field").agg(F.max_by(_value(), "seq").alias("v"))
        return last.select("id", "field", "v.*")

    def maps(self) -> DataFrame:
        """(id, meta): the fields of each id as a map from name to tagged value."""
        value = _value()
        return self.latest().groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct(F.col("field").alias("key"), value.alias("value")))).alias("meta"))

    def get_all(self, id: int) -> dict[str, Value] | None:
        rows = self.latest().where(F.col("id") == id).collect()
        return {r.field: {"int": r.int_val, "float": r.float_val, "str": r.str_val, "bool": r.bool_val}[r.kind] for r in rows} or None

    def get(self, id: int, field: str) -> Value | None:
        return (self.get_all(id) or {}).get(field)

    def remove(self, id: int) -> MetadataStore:
        return MetadataStore(self.rows.where(F.col("id") != id))

    def __len__(self) -> int:
        return self.rows.select("id").distinct().count()

    def is_empty(self) -> bool:
        return self.rows.isEmpty()

    def matching(self, expr: tuple | Filter) -> DataFrame:
        """The ids that match; those without metadata are not among them, even under `not`.

        One grouped pass that carries the last values of the filter's own fields only.
        """
        tree = parse_filter(expr)
        names = sorted(tree.fields())
        last = [F.max_by(_value(), F.when(F.col("field") == f, F.col("seq"))).alias(f"v{i}") for i, f in enumerate(names)]
        meta = F.create_map(*(x for i, f in enumerate(names) for x in (F.lit(f), F.col(f"v{i}"))))
        return self.rows.groupBy("id").agg(*last).where(tree.compile(meta)).select("id")

    def matches(self, id: int, expr: tuple | Filter) -> bool:
        return not self.matching(expr).where(F.col("id") == id).isEmpty()


def filtered_top_k(results: DataFrame, store: MetadataStore, expr: tuple | Filter, k: int) -> DataFrame:
    """Of results([qid,] rank, id, score), the first k of each query whose ids match; order is kept and ranks are new.

    This is a filter after the search: it may leave fewer than k. prefiltered() filters the points instead.
    """
    keys = ["qid"] if "qid" in results.columns else []
    left = results.join(store.matching(expr), "id", "left_semi")
    window = Window.partitionBy(*keys).orderBy("rank") if keys else Window.orderBy("rank")
    return left.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= max(k, 0)).select(*keys, "rank", "id", "score")


def prefiltered(points: DataFrame, store: MetadataStore, expr: tuple | Filter) -> DataFrame:
    """The points whose ids match, for a search that fills k."""
    return points.join(store.matching(expr), "id", "left_semi")
