"""Publishing under a fixed schema."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from civicflow.functions.dates import iso_date, us_date
from civicflow.functions.geometry import ewkt
from civicflow.functions.text import empty_to_null, stripped
from civicflow.sources.manifest import Publication
from civicflow.sources.tables import DatasetRef

GEOMETRY = "geometry"

# The spellings of true and false a published boolean accepts.
TRUE_WORDS = ["t", "tr", "tru", "true", "y", "ye", "yes", "on", "1"]
FALSE_WORDS = ["f", "fa", "fal", "fals", "false", "n", "no", "of", "off", "0"]

_TYPES = {
    "text": T.StringType(),
    "character varying": T.StringType(),
    "integer": T.IntegerType(),
    "bigint": T.LongType(),
    "double precision": T.DoubleType(),
    "boolean": T.BooleanType(),
    "date": T.DateType(),
    GEOMETRY: T.StringType(),
}


def parse_ddl(ddl: str) -> dict[str, str]:
    """Declared columns, one ``name type`` a line, in order."""
    out: dict[str, str] = {}
    for line in ddl.strip().splitlines():
        name, _, kind = line.strip().partition(" ")
        out[name] = GEOMETRY if kind.startswith(GEOMETRY) else kind
    return out


def _as_type(c: Column, have: T.DataType, kind: str, empty_as_null: bool) -> Column:
    want = _TYPES[kind]
    text = isinstance(have, T.StringType)
    if text and (empty_as_null or not isinstance(want, T.StringType)):
        c = empty_to_null(c)
    if isinstance(have, T.NullType):
        return c.cast(want)
    if kind == GEOMETRY:
        return empty_to_null(F.when(c.startswith("SRID="), c).otherwise(ewkt(c)))
    if kind == "boolean" and text:
        word = F.lower(F.trim(c))
        return F.when(word.isin(*TRUE_WORDS), F.lit(True)).when(word.isin(*FALSE_WORDS), F.lit(False))
    if kind == "date" and text:
        return F.coalesce(iso_date(c), us_date(c))
    if isinstance(want, T.StringType):
        return c.cast(want)
    return (F.trim(c) if text else c).try_cast(want)


def conform(df: DataFrame, ddl: str | dict[str, str], empty_as_null: bool = True) -> DataFrame:
    """Exactly the declared columns, in order and of the declared type.

    Empty text becomes NULL, unless asked otherwise for text columns, and so
    does a value the type cannot hold (T19).  Geometry text is tagged with its
    reference system.
    """
    ddl = parse_ddl(ddl) if isinstance(ddl, str) else ddl
    have = {f.name: f.dataType for f in df.schema.fields}
    missing = [name for name in ddl if name not in have]
    if missing:
        raise ValueError(f"columns declared but not built: {missing}")
    return df.select(*[_as_type(F.col(f"`{name}`"), have[name], kind, empty_as_null).alias(name) for name, kind in ddl.items()])


def publish(
    df: DataFrame,
    ref: DatasetRef | str,
    base: str,
    ddl: str | dict[str, str],
    empty_as_null: bool = True,
    unreadable: dict[str, int] | None = None,
) -> str:
    """Rebuild one published version from the frame; the old one is read until the new one stands.

    ``unreadable`` is filled, while writing, with the number of values of each
    column that became NULL because the declared type cannot hold them (T19).
    """
    ref = DatasetRef.parse(ref) if isinstance(ref, str) else ref
    with Publication(df.sparkSession, base, ref.name) as publication:
        return write_output(publication, df, ref, ddl, empty_as_null, unreadable)


def write_output(
    publication: Publication,
    df: DataFrame,
    ref: DatasetRef,
    ddl: str | dict[str, str],
    empty_as_null: bool = True,
    unreadable: dict[str, int] | None = None,
) -> str:
    """Write one output of a publication, which becomes visible with the others at its end."""
    ddl = parse_ddl(ddl) if isinstance(ddl, str) else ddl
    path = publication.folder_of(ref.name, ref.version)
    lost = _lost(df, ddl) if unreadable is not None else {}
    seen = Observation()
    counted = df.observe(seen, *[F.count_if(c).alias(f"c{i}") for i, c in enumerate(lost.values())]) if lost else df
    conform(counted, ddl, empty_as_null).write.parquet(path)
    if lost:
        counts = seen.get
        unreadable.update({name: counts[f"c{i}"] for i, name in enumerate(lost)})
    return path


def _lost(df: DataFrame, ddl: dict[str, str]) -> dict[str, Column]:
    """For each typed column that is read from text: whether a value is lost."""
    out = {}
    for field in df.schema.fields:
        kind = ddl.get(field.name, "text")
        if isinstance(field.dataType, T.StringType) and kind not in ("text", "character varying", GEOMETRY):
            c = F.col(f"`{field.name}`")
            out[field.name] = (stripped(c) != "") & _as_type(c, field.dataType, kind, True).isNull()
    return out


def publish_after(
    df: DataFrame,
    ref: DatasetRef | str,
    base: str,
    ddl: str | dict[str, str],
    post: Callable[[DataFrame], DataFrame],
    unreadable: dict[str, int] | None = None,
) -> str:
    """Run the post step on the untyped columns, then cast and publish.

    Empty text stays empty here; only typed columns read it as NULL.
    """
    ddl = parse_ddl(ddl) if isinstance(ddl, str) else ddl
    return publish(post(untyped(df, ddl)), ref, base, ddl, False, unreadable)


def untyped(df: DataFrame, ddl: dict[str, str]) -> DataFrame:
    """The declared columns as they are, for a step that runs before the cast."""
    return df.select(*[F.col(f"`{c}`") for c in ddl])


def split_by(df: DataFrame, condition: Column) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected); a row whose condition is NULL is rejected."""
    holds = F.coalesce(condition, F.lit(False))
    return df.filter(holds), df.filter(~holds)
