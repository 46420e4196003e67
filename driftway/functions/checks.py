"""Input rules, applied while the data streams past instead of in a pass of their own."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Spellings accepted as booleans and the direction labels in use.
TRUE_WORDS = ("true", "1", "yes")
FALSE_WORDS = ("false", "0", "no")
DIRECTIONAL_LABELS = ("A->B", "B->A")
NULL_LABELS = ("symmetric", "none")

# More rules than this would push the generated method over the size the JIT
# compiles and slow the whole stage down; a lambda keeps them out of it.
_COMPILED_RULES = 4


def require_columns(df: DataFrame, columns: Iterable[str], what: str) -> None:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"{what} lacks the columns {', '.join(missing)}")


def require_unit_interval(**values: float) -> None:
    """Driver-side check of threshold arguments."""
    for name, value in values.items():
        if not 0 <= float(value) <= 1:  # also refuses NaN
            raise ValueError(f"{name} is outside 0 to 1.")


def enforce(df: DataFrame, rules: Sequence[tuple[Column, str]]) -> DataFrame:
    """Fail the job on the first row that breaks a rule; a NULL verdict counts as broken.

    The rules become one filter, so validation costs no extra scan and cannot be
    pruned away with an unused column. Its position-dependent term keeps the
    optimiser from moving it: pushed through a projection it would repeat every
    expression it looks at, and a later filter could get ahead of it.
    """
    verdict = None
    for holds, message in rules:
        broken = ~F.coalesce(holds, F.lit(False))
        failure = F.raise_error(F.lit(message)).cast("boolean")
        verdict = F.when(broken, failure) if verdict is None else verdict.when(broken, failure)
    if verdict is None:
        return df
    verdict = verdict.otherwise(F.lit(True))
    if len(rules) > _COMPILED_RULES:
        checks = verdict
        verdict = F.exists(F.array(F.lit(True)), lambda _: checks)
    return df.filter(verdict & (F.monotonically_increasing_id() >= 0))


def is_finite(col: Column) -> Column:
    """NULL, NaN and both infinities are not finite; Spark orders NaN above infinity."""
    return F.coalesce(F.abs(col) < float("inf"), F.lit(False))


def in_unit_interval(col: Column) -> Column:
    return F.coalesce(col.between(0.0, 1.0), F.lit(False))


def is_rate(col: Column) -> Column:
    return F.coalesce((col >= 0) & (col < float("inf")), F.lit(False))


def as_number(df: DataFrame, name: str) -> Column:
    """Numeric reading of a column: text that is not a number, and NaN, become NULL."""
    value = F.col(name)
    if df.schema[name].dataType.typeName() != "double":
        value = value.try_cast("double")
    return F.nanvl(value, F.lit(None).cast("double"))


def strict_bool(df: DataFrame, name: str) -> Column:
    """Boolean reading of a column; anything outside the accepted words fails the job."""
    kind = df.schema[name].dataType.typeName()
    if kind == "boolean":
        return F.col(name)
    word = F.lower(F.trim(F.col(name).cast("string")))
    if kind in ("double", "float", "decimal"):
        word = F.lit(None).cast("string")  # fractional types never count as booleans
    shown = F.coalesce(F.col(name).cast("string"), F.lit("NULL"))
    return (
        F.when(word.isin(*TRUE_WORDS), F.lit(True))
        .when(word.isin(*FALSE_WORDS), F.lit(False))
        .otherwise(
            F.raise_error(F.concat(F.lit(f"{name} has a value that is neither true nor false: "), shown)).cast("boolean")
        )
    )


def first_values(df: DataFrame, *columns: str, limit: int = 5) -> list[tuple]:
    """A handful of offending rows for an error message."""
    return [tuple(row) for row in df.select(*columns).distinct().orderBy(*columns).limit(limit).collect()]
