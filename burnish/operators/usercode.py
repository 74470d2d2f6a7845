"""Cleaning code the user brings along."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import TYPE_CHECKING

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DateType, IntegralType, StringType, StructType

from burnish.operators.ordering import Plain, fresh, names

if TYPE_CHECKING:
    import pyspark.pandas as ps

BUCKET_ROWS = 10_000  # rows of whole groups that go to Python at once, about


def apply_code(df: DataFrame, code: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Code written against DataFrames: Spark plans it with the rest."""
    return df.transform(code)


def apply_pandas(
    df: DataFrame, code: Callable[[pd.DataFrame], pd.DataFrame], schema: StructType | str | None = None
) -> DataFrame:
    """Pandas code that treats rows one by one, run on Arrow batches of the rows.

    That is the contract: the result of a row may depend on that row only. A call
    sees one batch, whose size is Spark's choice, so code that looks across rows
    (dedup, medians, ids) gives other answers for other sizes. Such code goes to
    ``apply_table_code``, or to ``apply_grouped`` if it looks across the rows of a group.
    """

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield code(batch)

    return df.mapInPandas(each, schema or df.schema)


def apply_table_code(df: DataFrame, code: Callable[[ps.DataFrame], ps.DataFrame]) -> DataFrame:
    """Pandas code for the whole table: ``drop_duplicates``, ``fillna(median())``, ``groupby`` and their like.

    The code gets a pandas-on-Spark frame, whose methods are Spark jobs, so it sees all rows at once however many there
    are, and what it gives does not depend on batches or partitions. Rows have no order but the one the code sorts by:
    ``drop_duplicates(keep="first")`` is meant for code that sorts, or does not care which copy stays.
    """
    import pyspark.pandas as ps

    given = code(df.pandas_api())
    if isinstance(given, ps.Series):
        given = given.to_frame()
    return given.to_spark()


def apply_grouped(
    df: DataFrame,
    code: Callable[[pd.DataFrame], pd.DataFrame],
    key: str | Sequence[str],
    schema: StructType | str | None = None,
    most_rows: int = 1_000_000,
) -> DataFrame:
    """Pandas code that looks across the rows of one ``key``, a group at a time.

    A group is held by one task, so a group of more than ``most_rows`` raises ``ValueError`` before any code runs; code
    for larger ones goes to ``apply_table_code``. Rows of a group come in no certain order. A null key is a group.

    Groups go to Python many at once, about ``BUCKET_ROWS`` rows, for a group of few rows costs more on its way than
    in the code; the code still sees one group a call, with the types the group has by itself.
    """
    plain = Plain.of(df)
    keys = plain.names(key)
    size, bucket = fresh(plain.table, "size", "bucket")
    sizes = plain.table.groupBy(*keys).agg(F.count(F.lit(1)).alias(size)).agg(F.max(size), F.sum(size)).first()
    largest, total = sizes[0] or 0, sizes[1] or 0
    if largest > most_rows:
        raise ValueError(f"a group of {names(key)} has {largest} rows, more than {most_rows}")
    headers = df.columns
    fields = plain.table.schema.fields

    def each(rows: pd.DataFrame) -> pd.DataFrame:
        return code(rows.set_axis(headers, axis=1))

    # Keys that pandas might tell apart in another way than Spark does.
    if any(not isinstance(plain.table.schema[k].dataType, (IntegralType, DateType)) and plain.table.schema[k].dataType != StringType() for k in keys):
        return plain.table.groupBy(*keys).applyInPandas(each, schema or df.schema)

    # Whole numbers and truth values would change their type for a null in another group: nulls come as flags.
    flagged = [f.name for f in fields if isinstance(f.dataType, (IntegralType, BooleanType))]
    flags = dict(zip(flagged, fresh(plain.table, *(f"no_{c}" for c in flagged)), strict=True))
    zero = {f.name: F.lit(0).cast(f.dataType) if f.name in flags else None for f in fields}
    rows = plain.table.select(
        *(F.coalesce(f.name, zero[f.name]).alias(f.name) if f.name in flags else F.col(f.name) for f in fields),
        *(F.col(c).isNull().alias(flag) for c, flag in flags.items()),
        F.pmod(F.xxhash64(*keys), F.lit(max(1, total // BUCKET_ROWS))).alias(bucket),
    )
    told_apart = [*keys, *(flags[k] for k in keys if k in flags)]

    def every(rows: pd.DataFrame) -> pd.DataFrame:
        number = rows.groupby(told_apart, dropna=False, sort=False).ngroup().to_numpy()
        rows = rows.iloc[np.argsort(number, kind="stable")]
        ends = np.cumsum(np.bincount(number))
        absent = {i: rows[flags[f.name]].to_numpy() for i, f in enumerate(fields) if f.name in flags and rows[flags[f.name]].any()}
        rows = rows.iloc[:, : len(fields)].set_axis(range(len(fields)), axis=1)
        done = []
        for start, end in zip([0, *ends[:-1]], ends, strict=True):
            own = rows.iloc[start:end].reset_index(drop=True)
            for i, missing in absent.items():
                if missing[start:end].any():
                    none = missing[start:end]
                    own[i] = own[i].astype(object).where(~none, None) if own[i].dtype == bool else own[i].astype("float64").mask(none)
            own.columns = headers
            given = code(own)
            if len(given):
                done.append(given)
        if not done:
            return pd.DataFrame()
        if any(not g.columns.equals(done[0].columns) for g in done):
            raise ValueError("the code gives other columns for some groups than for others")
        if any(list(g.dtypes) != list(done[0].dtypes) for g in done):
            done = [g.astype(object).where(g.notna(), None) for g in done]  # no value may turn into another type's
        return pd.concat(done, ignore_index=True)

    return rows.groupBy(bucket).applyInPandas(every, schema or df.schema)
