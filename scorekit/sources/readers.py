"""Read many sources, normalise headers, keep source order, pick a status table.

Nothing of a source is lost without a trace: files that cannot be opened and rows of text files
that do not fit their schema are tables of the :class:`Intake` beside the sources' frames.
"""

from __future__ import annotations

import re
import warnings
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorekit.errors import DuplicateColumnError
from scorekit.functions.constants import ORDER_COL
from scorekit.functions.text import normalize_header
from scorekit.operators._cols import q
from scorekit.session import materialize
from scorekit.sources.quarantine import BAD_FILES, TESTED_FORMATS, bad_files, footer_schema, good_paths

_FORMATS = {"parquet": "parquet", "csv": "csv", "json": "json", "jsonl": "json", "orc": "orc"}
# Formats whose scan exposes ``_metadata.row_index`` (ORC, CSV and JSON do not).
_ROW_INDEX_FORMATS = {"parquet"}
_LINE_FORMATS = {"csv", "json"}
_REJECTED, _PLACE = "_rejected_line", "_rejected_file"
BAD_ROWS = "source int, path string, row string"


@dataclass
class Intake:
    """What reading several sources gave."""
    sources: list[DataFrame] = field(default_factory=list)   # the non-empty ones
    numbers: list[int] = field(default_factory=list)         # their places among the given sources
    bad_files: DataFrame | None = None                       # source, path, bytes, reason
    bad_rows: DataFrame | None = None                        # source, path, row (its text)


def _format_of(path: str) -> str:
    ext = path.rstrip("/").split(".")[-1].lower()
    fmt = _FORMATS.get(ext)
    if fmt is None:
        raise ValueError(f"no reader for files ending in {ext!r}")
    return fmt


def normalize_headers(df: DataFrame) -> DataFrame:
    """Apply the header rule to every column name; the data is not touched.

    Two names that normalise alike (``a.b`` and ``ab``) raise ``DuplicateColumnError``.
    """
    return df.select(*[q(o).alias(n) for o, n in _renamed(df.columns).items()])


def _renamed(columns: list[str]) -> dict[str, str]:
    names = [normalize_header(c) for c in columns]
    seen: dict[str, str] = {}
    for old, new in zip(columns, names):
        if new in seen:
            raise DuplicateColumnError(
                f"columns {seen[new]!r} and {old!r} both normalise to {new!r}")
        seen[new] = old
    return dict(zip(columns, names))


def file_order_key(path: Column, base: str = "") -> Column:
    """A text that sorts as files do in natural order (``part-2`` before ``part-10``): every run of
    digits is written as its length and its digits without leading zeros. What stands before and in
    ``base``, which all files of a source share, is left out; the path itself comes last and parts
    names such as ``a1`` and ``a01``."""
    if base:
        at = F.instr(path, base)
        path = F.when(at > 0, F.substring(path, at + len(base), F.length(path))).otherwise(path)
    pieces = F.regexp_extract_all(path, F.lit(r"([0-9]+|[^0-9]+)"), F.lit(1))

    def piece(p):
        digits = F.regexp_replace(p, "^0+(?=[0-9])", "")
        return F.when(p.rlike("^[0-9]"), F.concat(F.lpad(F.length(digits).cast("string"), 4, "0"), digits)).otherwise(p)

    return F.concat_ws("\u0000", F.array_join(F.transform(pieces, piece), ""), path)


def _shared_part(path: str) -> str:
    """The part of a source's path that the paths of all its files hold: no scheme, host or glob."""
    plain = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "", path)
    fixed = re.split(r"[*?\[{]", plain)[0]
    return fixed.rstrip("/") if fixed == plain else fixed[:fixed.rfind("/") + 1]


def _row_order(source_no: int, fmt: str, path: str) -> Column:
    """``_row_order`` = (source number, file, place in the file, row), made in the scan: no join and
    no list of files. Rows of a format without a row index are numbered in the order of a split,
    and splits come in the order of their first byte."""
    if fmt in _ROW_INDEX_FORMATS:
        block, row = F.lit(0).cast("bigint"), F.col("_metadata.row_index")
    else:
        block, row = F.col("_metadata.file_block_start"), F.monotonically_increasing_id()
    return F.struct(F.lit(source_no).alias("source"),
                    file_order_key(F.col("_metadata.file_path"), _shared_part(path)).alias("file"),
                    block.alias("block"), row.alias("row"))


def _parsed_lines(reader, raw: DataFrame, path, order: list[Column], source_no: int):
    """``rows, rejects, counts`` of a text source: its lines are parsed once, into a written table,
    where those that do not fit the schema (a value of another type, fields too many or too few)
    keep their text and go to the rejects."""
    names = _renamed(raw.columns)
    schema = T.StructType([*raw.schema.fields, T.StructField(_REJECTED, T.StringType())])
    lines = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", _REJECTED).schema(schema).load(path)
    plain = [f"c{i}" for i in range(len(names))]  # any header can be written
    seen = Observation()
    parsed = lines.select(*[q(o).alias(p) for o, p in zip(names, plain)], *order, q(_REJECTED),
                          F.col("_metadata.file_path").alias(_PLACE))
    written = materialize(parsed.observe(seen, F.count(F.lit(1)).alias("lines"), F.count(_REJECTED).alias("rejects")), "lines")
    kept = [ORDER_COL] if order else []
    rows = written.where(q(_REJECTED).isNull()).select(*[q(p).alias(n) for p, n in zip(plain, names.values())], *kept)
    rejects = written.where(q(_REJECTED).isNotNull()).select(
        F.lit(source_no).alias("source"), q(_PLACE).alias("path"), q(_REJECTED).alias("row"))
    counts = seen.get
    return rows, rejects, counts.get("lines") or 0, counts.get("rejects") or 0


def _read_one(spark: SparkSession, spec, source_no: int, with_order: bool):
    """``frame (None: no rows), bad files, rejects (None: none)`` of a source."""
    if isinstance(spec, Mapping):
        path = spec["path"]
        fmt = spec.get("format") or _format_of(path)
        options = dict(spec.get("options", {}))
        schema = spec.get("schema")
    else:
        path, fmt, options, schema = spec, _format_of(spec), {}, None
    if fmt == "csv":
        options.setdefault("header", "true")
    bad = bad_files(spark, path, fmt, options, schema)
    files = path
    if bad:
        files = good_paths(spark, path, options, bad)
        if not files:
            return None, bad, None
    reader = spark.read.format(fmt).options(**options)
    if schema is None and fmt in TESTED_FORMATS:
        schema = footer_schema(spark, files, fmt, options)  # of a file that has one
        if schema is None:
            return None, bad, None
    raw = (reader.schema(schema) if schema is not None else reader).load(files)
    order = [_row_order(source_no, fmt, path).alias(ORDER_COL)] if with_order else []
    if fmt in _LINE_FORMATS and not any(o.lower() == "mode" for o in options):
        found = raw.drop("_corrupt_record") if schema is None else raw
        rows, rejects, lines, rejected = _parsed_lines(reader, found, files, order, source_no)
        return (rows if lines > rejected else None), bad, (rejects if rejected else None)
    rows = raw.select(*[q(o).alias(n) for o, n in _renamed(raw.columns).items()], *order)
    return (None if rows.isEmpty() else rows), bad, None


def read_intake(spark: SparkSession, specs: Iterable, with_order: bool = True) -> Intake:
    """Read each source (a path, or ``{"path", "format", "options", "schema"}``).

    Without a schema, CSV columns are text (``inferSchema`` would scan the source once more);
    JSON has no names without reading it, so give a schema to spare that scan. Headers follow the
    header rule. With ``with_order`` every frame carries ``_row_order`` = (source number, file,
    place, row) so later steps can honour source order.

    Empty sources are left out. A source without a reader, or whose path does not exist, is
    reported with a warning. Of a Parquet or ORC source, files that cannot be opened go to
    ``bad_files`` and the others are read. Of a CSV or JSON source, rows that do not fit go to
    ``bad_rows`` (unless the source's options name a ``mode`` of their own). Any other failure, a
    storage error for one, is raised: a result is never smaller without saying so.
    """
    return _intake(spark, list(_each(spark, specs, with_order)))


def _each(spark: SparkSession, specs: Iterable, with_order: bool):
    """``number, frame, bad files, rejects`` of the sources, as far as the caller asks for them."""
    for i, spec in enumerate(specs):
        try:
            found = _read_one(spark, spec, i, with_order)
        except DuplicateColumnError:
            raise
        except Exception as e:  # noqa: BLE001 - only what says that there is no such source is skipped
            if isinstance(e, ValueError) or getattr(e, "getCondition", lambda: None)() == "PATH_NOT_FOUND":
                warnings.warn(f"skipped source {spec!r}: {e}", stacklevel=4)
                continue
            raise
        yield (i, *found)


def _intake(spark: SparkSession, found: list) -> Intake:
    out = Intake()
    files, rows = [], spark.createDataFrame([], BAD_ROWS)
    for i, frame, bad, rejects in found:
        files += [(i, *b) for b in bad]
        if rejects is not None:
            rows = rows.unionByName(rejects)
        if frame is not None:
            out.sources.append(frame)
            out.numbers.append(i)
    out.bad_files, out.bad_rows = spark.createDataFrame(files, BAD_FILES), rows
    if files:
        warnings.warn(f"{len(files)} files cannot be read and were left out: {[f[1] for f in files[:3]]} ...", stacklevel=3)
    return out


def read_sources(spark: SparkSession, specs: Iterable, with_order: bool = True) -> list[DataFrame]:
    """The non-empty frames of :func:`read_intake`; what was set apart is reported with warnings."""
    found = list(_each(spark, specs, with_order))
    for i, _, _, rejects in found:
        if rejects is not None:
            warnings.warn(f"source {i}: rows that do not fit the schema were left out; read_intake() has them", stacklevel=2)
    return _intake(spark, found).sources


def read_status(spark: SparkSession, specs: Iterable) -> DataFrame | None:
    """Status table: the first readable, non-empty source; ``None`` if there is none."""
    return next((frame for _, frame, _, _ in _each(spark, specs, with_order=False) if frame is not None), None)
