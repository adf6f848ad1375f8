"""Files and tables in."""

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duefold.functions import named, or_raise, parse_timestamp
from duefold.operators.missing import nan_to_null
from duefold.sources.schemas import MISSING_TEXTS


def _value(present: Column, data_type: T.DataType, pattern: str | None) -> Column:
    if isinstance(data_type, T.StringType):
        return present
    if isinstance(data_type, T.TimestampNTZType):
        return parse_timestamp(present, pattern)
    if isinstance(data_type, T.IntegralType):
        # A column of whole numbers with gaps may have been written as 3.0.
        short = F.substring(present, F.lit(1), F.length(present) - 2)
        present = F.when(present.endswith(".0"), short).otherwise(present)
    return present.cast(data_type)


def _typed(
    raw: DataFrame, schema: T.StructType, missing: Sequence[str], pattern: str | None
) -> DataFrame:
    """The columns of ``schema``, each cell looked up, parsed and checked once.

    In three steps: as one expression a cell would be looked up wherever it is mentioned, and the
    code for a dozen columns would be too long for the JVM to compile.
    """
    texts = raw.select(
        *[F.when(~named(f.name).isin(*missing), named(f.name)).alias(f"text{k}") for k, f in enumerate(schema)]
    )
    values = texts.select(
        "*", *[_value(F.col(f"text{k}"), f.dataType, pattern).alias(f"value{k}") for k, f in enumerate(schema)]
    )
    checked = []
    for k, f in enumerate(schema):
        text, value = F.col(f"text{k}"), F.col(f"value{k}")
        if not isinstance(f.dataType, (T.StringType, T.TimestampNTZType)):
            value = or_raise(text, value, f"of type {f.dataType.simpleString()}")
        checked.append(value.alias(f.name))
    return values.select(*checked)


def read_typed_csv(
    spark: SparkSession,
    path: str | Sequence[str],
    schema: T.StructType,
    names: Mapping[str, str] | None = None,
    missing: Sequence[str] = MISSING_TEXTS,
    timestamp_pattern: str | None = None,
    multi_line: bool = False,
    **options,
) -> DataFrame:
    """CSV files with a header, as the columns of ``schema``.

    Columns are found by header and renamed by ``names`` (raw to ours); the order is free,
    but the same in all files of one call. Other headers, a missing column, or a cell that does not fit its
    type raise. Cells in ``missing`` become null. Columns nobody uses are never parsed.

    Quotes inside quoted cells are doubled, as in standard CSV. Cells with line breaks need
    ``multi_line``, which makes each file one task.
    """
    raw = (
        spark.read.options(
            header=True,
            enforceSchema=False,
            mode="FAILFAST",
            escape='"',
            multiLine=multi_line,
            **options,
        )
        .csv(path if isinstance(path, str) else list(path))
    )
    if names:
        raw = raw.withColumnsRenamed(dict(names))
    typed = _typed(raw, schema, missing, timestamp_pattern)
    return nan_to_null(typed)


# Types a column of texts may have, tried in this order.
_GUESSES = ("int", "bigint", "double", "timestamp_ntz", "boolean")


def read_delimited(
    spark: SparkSession,
    path: str,
    sep: str = ",",
    header: bool = True,
    infer_schema: bool = True,
    missing: Sequence[str] = MISSING_TEXTS,
    multi_line: bool = False,
) -> DataFrame:
    """Delimited files whose types are inferred: an extra pass, for exploring only.

    ``path`` may hold wildcards. A line with too few or too many cells raises, and so does a
    file whose headers differ from the others' or come in another order. Cells in ``missing`` become null.
    """
    raw = spark.read.options(
        header=header,
        sep=sep,
        mode="FAILFAST",
        enforceSchema=False,
        columnPruning=False,
        escape='"',
        multiLine=multi_line,
    ).csv(path)
    cells = raw.select(*[F.when(~named(c).isin(*missing), named(c)).alias(c) for c in raw.columns])
    if not infer_schema:
        return cells

    def fits(name: str, data_type: str):
        if data_type == "boolean":
            return F.lower(named(name)).isin("true", "false")
        return named(name).try_cast(data_type).isNotNull()

    tests = [
        F.coalesce(F.bool_and(fits(c, t) | named(c).isNull()), F.lit(True))
        for c in cells.columns
        for t in _GUESSES
    ]
    anything = [F.count(named(c)) > 0 for c in cells.columns]
    row = cells.agg(F.array(*tests), F.array(*anything)).first()
    types = {}
    for k, name in enumerate(cells.columns):
        right = row[0][k * len(_GUESSES) : (k + 1) * len(_GUESSES)]
        types[name] = next((t for t, ok in zip(_GUESSES, right) if ok and row[1][k]), "string")
    return nan_to_null(cells.select(*[named(c).cast(t).alias(c) for c, t in types.items()]))


def read_parquet(
    spark: SparkSession, path: str, columns: Sequence[str] | None = None
) -> DataFrame:
    df = spark.read.parquet(path)
    return nan_to_null(df if columns is None else df.select(*map(named, columns)))


def read_table(
    spark: SparkSession,
    name: str,
    columns: Sequence[str] | None = None,
    index: Sequence[str] = (),
) -> DataFrame:
    """A catalog table; ``index`` columns come first, then ``columns``."""
    df = spark.read.table(name)
    if columns is None:
        columns = df.columns
    return df.select(*map(named, index), *[named(c) for c in columns if c not in index])
