"""Small column builders shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewright.functions.fixed import TABLE_REF_PATTERN


def key_text(col: Column | str) -> Column:
    """A key as text, so that keys of different types compare by what they print as."""
    return (F.col(col) if isinstance(col, str) else col).cast("string")


def parse_timestamp(col: Column | str, fmt: str | None = None) -> Column:
    """Text to timestamp; text that is no timestamp becomes NULL instead of failing the job."""
    return F.try_to_timestamp(col, F.lit(fmt)) if fmt else F.try_to_timestamp(col)


def landing_date(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def landing_path(root: Column | str, entity: str, ts: Column, run_id: Column | str) -> Column:
    """Where a run's files belong: ``root/entity/dt=YYYY-MM-DD/run=<id>``."""
    as_col = lambda v: F.lit(v) if isinstance(v, str) else v
    return F.concat(as_col(root), F.lit(f"/{entity}/dt="), landing_date(ts), F.lit("/run="), as_col(run_id))


def qualify_ref(ref: Column, catalog: Column | str | None) -> Column:
    """Prefixes the default catalog unless the ref has three parts or is no table name at all."""
    if catalog is None or (isinstance(catalog, str) and not catalog):
        return ref
    cat = F.lit(catalog) if isinstance(catalog, str) else catalog
    kept = (
        ref.contains(":")
        | ref.contains("/")
        | (F.size(F.split(ref, r"\.", -1)) == 3)
        | cat.isNull()
        | (cat == F.lit(""))
    )
    return F.when(kept, ref).otherwise(F.concat(cat, F.lit("."), ref))


def is_table_ref(ref: Column) -> Column:
    return ref.rlike("(?U)" + TABLE_REF_PATTERN)  # letters of any script count as word characters


def percent(fraction: Column) -> Column:
    """``0.123`` as ``12.3%``; an exact half goes to the even digit."""
    return F.format_string("%.1f%%", F.bround(fraction.cast("double") * 100.0, 1))


def json_field(doc: Column | str, path: str, dtype: str = "string") -> Column:
    """One field of a JSON text; NULL when the text is broken, the field absent or of another type."""
    text = F.get_json_object(doc, path)
    return text if dtype == "string" else text.try_cast(dtype)
