"""Frame: a Spark DataFrame with column roles. Every operator gives a new, lazy Frame."""

from __future__ import annotations

import json
from dataclasses import asdict, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .names import free, quoted
from .operators import bins, encode, kv, quantile, stat
from .roles import RoleSchema

ROLES = ("sample_id", "match_id", "label", "weight")
#: Numeric types from narrow to wide.
WIDTH = ["tinyint", "smallint", "int", "bigint", "float", "double"]


class Frame:
    """Cells are expressions over one base table, so frames made from each other cell by cell meet in a projection.

    Frames of different tables are joined on their sample ids, which must not repeat in the right one.
    """

    def __init__(self, df: DataFrame, roles: RoleSchema, cells: dict[str, Column] | None = None):
        if cells is None:
            missing = [c for c in roles.all_columns() if c not in df.columns]
            if missing:
                raise ValueError(f"columns not found: {missing}")
            cells = {c: F.col(quoted(c)) for c in roles.all_columns()}
        self.base, self.roles, self.cells = df, roles, {c: cells[c] for c in roles.all_columns()}

    @property
    def df(self) -> DataFrame:
        return self.base.select(*[x.alias(c) for c, x in self.cells.items()])

    @classmethod
    def from_spark(cls, df: DataFrame, sample_id: str, match_id=None, label=None, weight=None, features=None, site="local") -> Frame:
        """NaN in floating-point columns becomes NULL, so that aggregates skip it."""
        own = {sample_id, match_id, label, weight}
        features = [c for c in df.columns if c not in own] if features is None else features
        floats = {c for c, t in df.dtypes if t in ("double", "float")}
        df = df.withColumns({c: F.nanvl(F.col(quoted(c)), F.lit(None)) for c in df.columns if c in floats})
        return cls(df, RoleSchema(sample_id, match_id, label, weight, tuple(features), site))

    def _row(self, cells: dict[str, Column], roles: RoleSchema | None = None) -> Frame:
        """The same rows with these cells."""
        return Frame(self.base, roles or self.roles, self.cells | cells)

    def _kept(self, condition: Column) -> Frame:
        """Rows of the same table for which the condition holds."""
        return Frame(self.base.where(condition), self.roles, self.cells)

    def _met(self, other: Frame, columns: list[str]) -> tuple[Frame, list[Column]]:
        """This frame, with the given columns of ``other`` in the same rows."""
        if other.base is self.base:
            return self, [other.cells[c] for c in columns]
        mine, theirs = self.df, other.df
        p = free(mine, theirs)
        sid, key = other.roles.sample_id, self.roles.sample_id
        first = [F.first(quoted(c)).alias(f"{p}{i}") for i, c in enumerate(columns)]
        one = theirs.groupBy(F.col(quoted(sid)).alias(f"{p}id")).agg(*first, F.count("*").alias(f"{p}n"))
        single = F.when(F.col(f"{p}n") > 1, F.raise_error(F.lit("sample ids repeat in the right-hand frame")).cast("boolean")).otherwise(True)
        joined = mine.join(one.where(single), F.col(quoted(key)) == F.col(f"{p}id"))
        return Frame(joined, self.roles), [F.col(f"{p}{i}") for i in range(len(columns))]

    # Shape and projection
    @property
    def columns(self) -> list[str]:
        return list(self.roles.features)

    def count(self) -> int:
        return self.df.count()

    @property
    def shape(self) -> tuple[int, int]:
        return self.count(), len(self.roles.operable)

    def _with(self, df: DataFrame, features=None) -> Frame:
        return Frame(df, self.roles if features is None else self.roles.with_features(features))

    def __getitem__(self, key):
        """A list of columns, or a frame of booleans that keeps the cells where it is true."""
        if isinstance(key, Frame):
            return self.where(key)
        names = [key] if isinstance(key, str) else list(key)
        unknown = [c for c in names if c not in self.columns]
        if unknown:
            raise ValueError(f"unknown columns: {unknown}")
        return self._row({}, self.roles.with_features(names))

    def anonymous_columns(self, names: list[str]) -> Frame:
        """The features of these anonymous names, as another party knows them."""
        real = {a: c for c, a in self.roles.anonymous().items()}
        unknown = [a for a in names if real.get(a) not in self.columns]
        if unknown:
            raise ValueError(f"unknown columns: {unknown}")
        return self[[real[a] for a in names]]

    def create_frame(self, with_label=False, with_weight=False, columns=None) -> Frame:
        roles = replace(self.roles, label=self.roles.label if with_label else None, weight=self.roles.weight if with_weight else None)
        return self._row({}, roles.with_features(columns if columns is not None else ()))

    def role(self, name: str) -> Frame | None:
        """Frame of the ids and the label or weight alone; None where there is none."""
        column = getattr(self.roles, name)
        return self._row({}, replace(self.roles, label=None, weight=None, features=(), **{name: column})) if column else None

    def empty_frame(self) -> Frame:
        return self._with(self.df.limit(0))

    def rename(self, columns: dict[str, str] | None = None, **roles: str) -> Frame:
        """New names of features, and of sample_id, match_id, label and weight by keyword."""
        unknown = [c for c in columns or {} if c not in self.columns] + [r for r in roles if r not in ROLES or getattr(self.roles, r) is None]
        if unknown:
            raise ValueError(f"nothing to rename: {unknown}")
        new = dict(columns or {}) | {getattr(self.roles, r): name for r, name in roles.items()}
        after = [new.get(c, c) for c in self.roles.all_columns()]
        if len(set(after)) < len(after):
            raise ValueError("names repeat")
        schema = replace(self.roles, **roles, features=tuple(new.get(c, c) for c in self.columns))
        return Frame(self.base, schema, {new.get(c, c): x for c, x in self.cells.items()})

    def assign(self, values: dict) -> Frame:
        """All new or all old columns; values are constants, Column expressions over this frame's columns, or one-column frames."""
        old = [c in self.columns for c in values]
        if any(old) and not all(old):
            raise ValueError("columns are partly new and partly old")
        taken = [c for c in values if c in self.cells and c not in self.columns]
        if taken:
            raise ValueError(f"columns with a role: {taken}")
        out, cells = self, {}
        for name, value in values.items():
            if isinstance(value, Frame):
                (source,) = value.roles.operable
                out, (cells[name],) = out._met(value, [source])
            elif isinstance(value, Column):
                out = Frame(out.df, out.roles) if out is self and not cells else out
                cells[name] = value
            else:
                cells[name] = F.lit(value)
        roles = out.roles if all(old) else out.roles.with_features([*self.columns, *values])
        return Frame(out.base, roles, out.cells | cells)

    def with_role(self, name: str, value: Frame) -> Frame:
        """The label or weight taken from a one-column frame."""
        if name not in ("label", "weight"):
            raise ValueError("only label and weight can be assigned")
        source = value.roles.operable
        if len(source) != 1:
            raise ValueError("a label or weight is one column")
        out, (cell,) = self._met(value, source)
        column = getattr(self.roles, name) or name
        return Frame(out.base, replace(out.roles, **{name: column}), out.cells | {column: cell})

    def promoted(self, columns: list[str] | None = None) -> Frame:
        """Numeric features in the widest type among them."""
        kinds = dict(self.df.dtypes)
        names = [c for c in columns or self.roles.operable if kinds[c] in WIDTH]
        widest = max((kinds[c] for c in names), key=WIDTH.index, default=None)
        return self._row({c: self.cells[c].cast(widest) for c in names}) if names else self

    def as_tensor(self) -> DataFrame:
        """(row_id, v): the operable columns of each row as an array of doubles."""
        return self.df.select(F.col(quoted(self.roles.sample_id)).alias("row_id"), F.array(*[F.col(quoted(c)).cast("double") for c in self.roles.operable]).alias("v"))

    def data_overview(self, num: int = 100) -> list[dict]:
        """The first ``num`` rows by sample id."""
        return [r.asDict() for r in self.df.orderBy(quoted(self.roles.sample_id)).limit(num).collect()]

    def with_anonymous_names(self) -> DataFrame:
        return self.df.select([F.col(quoted(c)).alias(a) for c, a in self.roles.anonymous().items()])

    # Element-wise
    def map_cells(self, f, names=None) -> Frame:
        return self._row({c: f(self.cells[c]) for c in names or self.roles.operable})

    def binary(self, f, other) -> Frame:
        """other: a constant, one value for each column, or a frame of one column or of the same columns."""
        names = self.roles.operable
        if isinstance(other, Frame):
            theirs = other.roles.operable
            if len(theirs) not in (1, len(names)):
                raise ValueError("a frame operand has one column or the same columns")
            out, right = self._met(other, theirs)
            return out._row({c: f(out.cells[c], right[min(i, len(theirs) - 1)]) for i, c in enumerate(names)})
        values = list(other) if isinstance(other, (list, tuple)) else [other] * len(names)
        if len(values) != len(names):
            raise ValueError("one value for each column is needed")
        return self._row({c: f(self.cells[c], F.lit(v)) for c, v in zip(names, values)})

    def __add__(self, o): return self.binary(lambda a, b: a + b, o)  # noqa: E704
    def __sub__(self, o): return self.binary(lambda a, b: a - b, o)  # noqa: E704
    def __mul__(self, o): return self.binary(lambda a, b: a * b, o)  # noqa: E704
    def __truediv__(self, o): return self.binary(lambda a, b: F.try_divide(a, b), o)  # noqa: E704
    def __pow__(self, o): return self.binary(F.pow, o)  # noqa: E704
    def __radd__(self, o): return self + o  # noqa: E704
    def __rsub__(self, o): return self.binary(lambda a, b: b - a, o)  # noqa: E704
    def __rmul__(self, o): return self * o  # noqa: E704
    def __lt__(self, o): return self.binary(lambda a, b: a < b, o)  # noqa: E704
    def __le__(self, o): return self.binary(lambda a, b: a <= b, o)  # noqa: E704
    def __gt__(self, o): return self.binary(lambda a, b: a > b, o)  # noqa: E704
    def __ge__(self, o): return self.binary(lambda a, b: a >= b, o)  # noqa: E704
    def eq(self, o): return self.binary(lambda a, b: a == b, o)  # noqa: E704
    def ne(self, o): return self.binary(lambda a, b: a != b, o)  # noqa: E704
    def __invert__(self): return self.map_cells(lambda c: ~c)  # noqa: E704

    def sigmoid(self) -> Frame:
        return self.map_cells(lambda c: 1 / (1 + F.exp(-c.cast("double"))))

    def fillna(self, value) -> Frame:
        values = value if isinstance(value, dict) else dict.fromkeys(self.roles.operable, value)
        return self._row({c: F.coalesce(self.cells[c], F.lit(v)) for c, v in values.items()})

    def replace(self, mapping: dict[str, dict]) -> Frame:
        return self._row({c: encode.replaced(self.cells[c], m) for c, m in mapping.items()})

    def isin(self, values) -> Frame:
        """A list for all columns, or lists by column, where other columns are false."""
        def test(c: str):
            wanted = values.get(c, []) if isinstance(values, dict) else values
            plain = [v for v in wanted if v is not None and v == v]
            found = F.coalesce(self.cells[c].isin(plain), F.lit(False)) if plain else F.lit(False)
            return found | self.cells[c].isNull() if len(plain) < len(wanted) else found

        return self._row({c: test(c) for c in self.roles.operable})

    def isna(self) -> Frame:
        return self.map_cells(lambda c: c.isNull())

    def where(self, mask: Frame) -> Frame:
        names = self.roles.operable
        if set(mask.roles.operable) != set(names):
            raise ValueError("the mask covers all columns")
        out, tests = self._met(mask, names)
        return out._row({c: F.when(test, out.cells[c]) for c, test in zip(names, tests)})

    def apply_row(self, function, schema: str | None = None, with_label: bool = False, with_weight: bool = False, columns: list[str] | None = None) -> Frame:
        """New features from Column expressions by name, or from a function of a row.

        A function gets a dict of the operable columns (and the label and weight if asked for) and gives one
        value for each field of ``schema``; ``columns`` are other names for these fields.
        """
        if isinstance(function, dict):
            made = Frame(self.df, self.roles)
            return Frame(made.base, self.roles.with_features(function), made.cells | function)
        if schema is None:
            raise ValueError("the fields that the function gives need a schema")
        own = self.roles.operable + [c for c, wanted in ((self.roles.label, with_label), (self.roles.weight, with_weight)) if wanted and c and c not in self.roles.operable]
        kept = [c for c in self.roles.all_columns() if c not in self.columns]
        df = kv.map_rows(self.df, function, schema, own, kept)
        names = [c for c in df.columns if c not in kept]
        if columns is not None:
            df, names = df.withColumnsRenamed(dict(zip(names, columns))), list(columns)
        return self._with(df, names)

    # Rows
    def iloc(self, mask: Frame) -> Frame:
        if len(mask.roles.operable) != 1:
            raise ValueError("the mask has one column")
        out, (test,) = self._met(mask, mask.roles.operable)
        return out._kept(test)

    def _ids(self, ids: DataFrame | Frame) -> DataFrame:
        ids = ids.df if isinstance(ids, Frame) else ids
        return ids.select(F.col(quoted(ids.columns[0] if self.roles.sample_id not in ids.columns else self.roles.sample_id)).alias(self.roles.sample_id))

    def loc(self, ids: DataFrame | Frame, target: str = "sample_id", order: str | None = None) -> Frame:
        """Rows whose sample id (or match id) is among ``ids``; in the order of the column ``order`` of ``ids`` if given."""
        column = getattr(self.roles, target) if target in ("sample_id", "match_id") else None
        if column is None:
            raise ValueError(f"no such target: {target}")
        if order is not None:
            p = free(self.df, ids)
            wanted = ids.groupBy(F.col(quoted(column)).alias(f"{p}k")).agg(F.min(quoted(order)).alias(f"{p}o"))
            return self._with(self.df.join(wanted, F.col(quoted(column)) == F.col(f"{p}k")).orderBy(f"{p}o"))
        wanted = ids.df if isinstance(ids, Frame) else ids
        return self._with(self.df.join(wanted.select(quoted(column)), column, "left_semi"))

    def drop(self, ids: DataFrame | Frame) -> Frame:
        return self._with(self.df.join(self._ids(ids), self.roles.sample_id, "left_anti"))

    def loc_with_sample_id_replacement(self, pairs: DataFrame) -> Frame:
        """pairs: (old sample id, new_sample_id)."""
        sid = self.roles.sample_id
        return self._with(self.df.join(pairs.select(sid, "new_sample_id"), sid).drop(sid).withColumnRenamed("new_sample_id", sid))

    def nlargest(self, n: int, columns: list[str], keep: str = "first", error: float = 0.0) -> Frame:
        return self._with(encode.top_rows(self.df, n, columns, self.roles.sample_id, keep, error))

    # Statistics
    def describe(self, ddof: int = 1, unbiased: bool = True) -> DataFrame:
        return stat.describe(self.df, self.roles.operable, ddof, unbiased)

    def quantile(self, q: list[float], approx: bool = False, relative_error: float = 1e-4) -> DataFrame:
        return quantile.quantiles(self.df, self.roles.operable, q, approx, relative_error)

    def qcut(self, q: int) -> DataFrame:
        return quantile.equal_width_cuts(self.df, self.roles.operable, q)

    def bucketize(self, cuts: dict[str, list[float]]) -> Frame:
        return self._row({c: bins.bucket(self.cells[c], b) for c, b in cuts.items()})

    def get_dummies(self) -> Frame:
        (column,) = self.roles.operable
        values = encode.categories(self.df, column)
        cells = {f"{column}_{v}": F.coalesce((self.cells[column] == v).cast("int"), F.lit(0)) for v in values}
        return Frame(self.base, self.roles.with_features(cells), self.cells | cells)

    # Combination
    @staticmethod
    def vstack(frames: list[Frame]) -> Frame:
        first = frames[0].roles
        if any(f.roles != first for f in frames):
            raise ValueError("frames differ in their fields")
        return Frame(reduce(DataFrame.unionByName, [f.df for f in frames]), first)

    @staticmethod
    def hstack(frames: list[Frame]) -> Frame:
        names = [c for f in frames for c in f.columns]
        if len(set(names)) < len(names):
            raise ValueError("column names repeat")
        out, cells = frames[0], {}
        for f in frames[1:]:
            out, found = out._met(f, f.columns)
            cells |= dict(zip(f.columns, found))
        return Frame(out.base, out.roles.with_features(names), out.cells | cells)

    # Storage
    def write(self, path: str) -> None:
        self.df.write.mode("overwrite").parquet(f"{path}/data")
        self.df.sparkSession.createDataFrame([(json.dumps(asdict(self.roles)),)], "roles string").coalesce(1).write.mode("overwrite").text(f"{path}/roles")

    @staticmethod
    def read(spark, path: str) -> Frame:
        roles = json.loads(spark.read.text(f"{path}/roles").first()[0])
        return Frame(spark.read.parquet(f"{path}/data"), RoleSchema(**roles | {"features": tuple(roles["features"])}))
