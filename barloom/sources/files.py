"""Files in: one CSV per instrument, symbol lists, snapshots, event logs; tables in Parquet."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom import schemas
from barloom.functions import columns as c
from barloom.operators import clean

#: Where a file's label stands in its path: the name without its last suffix, or the folder (``key=`` cut off).
_LABELS = {"file": r"([^/]+?)(?:\.[^./]*)?$", "folder": r"(?:[^/=]*=)?([^/=]+)/[^/]+$"}
#: Most columns of a file.
WIDTH = 64
#: Bytes of a file up to which one task reads it.
WHOLE = 2**20


def path_label(level: str = "file", path: str | Column = "_metadata.file_path") -> Column:
    """Label of the file a row comes from: its stem or its folder."""
    # the end of the path only: the search for a label grows with the square of what it looks at, row by row
    last = F.substring_index(F.col(path) if isinstance(path, str) else path, "/", {"file": -1, "folder": -2}[level])
    plain = F.url_decode(F.replace(last, F.lit("+"), F.lit("%2B")))
    return F.regexp_extract(plain, _LABELS[level], 1)


def read_cells(spark: SparkSession, path: str | list[str], key: str, wanted: list[str]) -> DataFrame:
    """The ``wanted`` columns, as text, of a folder of CSV files that name their columns: ``(file, c0, c1, ...)`` in that order.

    Spark's own reader takes the files apart once, so quoted commas, line breaks and doubled quotes are part of a cell.  Every file has a header of
    its own, its first line: columns may stand in any order or be missing (NULL), names are compared without case, and a file whose
    header lacks ``key`` is left out, as is any later line that repeats the whole header.  Cells are trimmed, empty ones are NULL.
    A file of up to :data:`WHOLE` bytes is read by one task, in order, so the header travels along with the rows.  Larger ones are read in
    pieces by as many tasks as their size asks for if each of their lines is a record by itself (:func:`_plain_files`); one with line breaks
    or stray quotes in its cells stays with one task, so an instrument of very many such rows comes as several files of one folder
    (``label='folder'``).
    """
    out = ", ".join(["file STRING", *[f"c{k} STRING" for k in range(len(wanted))]])
    key, wanted = key.lower(), [w.lower() for w in wanted]
    heads = _plain_files(spark, path)
    whole = _scan(spark, path, multi_line=True)
    if not heads:
        return whole.mapInArrow(_by_header(key, wanted), out)
    plain = F.col("_metadata.file_path").isin(*heads)
    pieces = _scan(spark, path, multi_line=False, only=plain)
    whole = _scan(spark, path, multi_line=True, only=~plain)
    return whole.mapInArrow(_by_header(key, wanted), out).unionByName(pieces.mapInArrow(_by_header(key, wanted, heads), out))


def _reader(spark: SparkSession) -> DataFrameReader:
    return spark.read.option("recursiveFileLookup", "true")


def _scan(spark: SparkSession, path: str | list[str], multi_line: bool, only: Column | None = None) -> DataFrame:
    """``(file, c0, c1, ...)`` of every line that is not empty, as it stands."""
    cells = [f"c{k}" for k in range(WIDTH)]
    # a column more than is read: lines then need not have as many cells as the schema, which costs an exception each
    reader = _reader(spark).schema(", ".join(f"{x} STRING" for x in [*cells, *([] if multi_line else ["rest"])]))
    raw = reader.option("header", "false").option("multiLine", multi_line).option("escape", '"').csv(path)
    return (raw if only is None else raw.where(only)).select(F.col("_metadata.file_path").alias("file"), *cells)


#: A line all of whose cells are either without quotes or quoted from end to end.
_CELL = r'(?:"[^"]*+(?:""[^"]*+)*+"|[^",]*+)'
_RECORD = f"^{_CELL}(?:,{_CELL})*+$"
#: Characters up to which a line with quotes is looked at.
_LINE = 10_000


def _plain_files(spark: SparkSession, path: str | list[str]) -> dict[str, list[str | None]]:
    """Files of more than :data:`WHOLE` bytes all of whose lines are records by themselves, and the cells of their first line.

    Their lines mean the same read one by one as read in order: none has a stray quote, a carriage return within, or blanks only, and
    all end alike.
    """
    text = _reader(spark).option("lineSep", "\n").text(path).where(F.col("_metadata.file_size") > WHOLE)
    ends = F.endswith("value", F.lit("\r"))
    line = F.when(ends, F.expr("left(value, length(value) - 1)")).otherwise(F.col("value"))
    place = F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    lines = text.select(F.col("_metadata.file_path").alias("file"), line.alias("line"), ends.alias("ends"), place.alias("place"))
    alone = ~F.contains("line", F.lit('"')) | ((F.length("line") <= _LINE) & F.rlike("line", F.lit(_RECORD)))
    alone &= ~F.contains("line", F.lit("\r")) & F.rlike("line", F.lit(r"[^\x00-\x20]"))
    found = lines.where("line <> ''").groupBy("file").agg(
        F.bool_and(alone).alias("alone"), F.min("ends").alias("least"), F.max("ends").alias("most"), F.min_by("line", "place").alias("head")
    )
    head = F.from_csv("head", ", ".join(f"c{k} STRING" for k in range(WIDTH)), {"escape": '"'})
    return {r.file: list(r.head) for r in found.where("alone AND least = most").select("file", head.alias("head")).collect()}


def _by_header(
    key: str, wanted: list[str], heads: dict[str, list[str | None]] | None = None
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Picks the ``wanted`` columns by each file's header: its first row, or what ``heads`` has for it."""

    def clean_cells(column: pa.Array) -> pa.Array:
        text = pc.utf8_trim_whitespace(pc.replace_substring(column, "\ufeff", ""))
        return pc.if_else(pc.equal(text, ""), pa.scalar(None, pa.string()), text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, head, places = None, [], []
        for batch in batches:
            if not batch.num_rows:
                continue
            names = batch.column(0).to_pylist()
            edges = [k for k in range(len(names)) if not k or names[k] != names[k - 1]] + [len(names)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                part = batch.slice(a, b - a)
                if names[a] != file:
                    file = names[a]
                    first = [pa.array([x], pa.string()) for x in heads[file]] if heads else [c.slice(0, 1) for c in part.columns[1:]]
                    head = [clean_cells(c)[0].as_py() for c in first]
                    if head[-1] is not None:
                        raise ValueError(f"{file} has {WIDTH} columns or more")
                    lower = [h and h.lower() for h in head]
                    places = [lower.index(w) if w in lower else None for w in wanted] if key in lower else None
                    part = part if heads else part.slice(1)
                if places is None or not part.num_rows:
                    continue
                again = pa.array([True] * part.num_rows)
                for c, h in zip(part.columns[1:], head, strict=True):
                    text = clean_cells(c)
                    again = pc.and_(again, pc.is_null(text) if h is None else pc.fill_null(pc.equal(text, h), False))
                    if not pc.any(again).as_py():
                        break
                part = part.filter(pc.invert(again))
                blank = pa.nulls(part.num_rows, pa.string())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *[blank if p is None else clean_cells(part.column(1 + p)) for p in places]],
                    ["file", *[f"c{k}" for k in range(len(wanted))]],
                )

    return run


def read_bars(
    spark: SparkSession,
    path: str,
    schema: str | T.StructType = schemas.BAR_FILE,
    fields: list[str] | None = None,
    require: list[str] | None = None,
    intraday: bool = False,
    label: str = "file",
) -> DataFrame:
    """Scan a folder of per-instrument CSV files into one long bar table.

    The instrument is the file's stem (``label='folder'``: the name of its folder).  Columns are found by their
    names in each file's header; only ``fields`` are parsed.  Rows without a readable time or without any value are
    dropped, NaN is NULL; with ``require`` an instrument needs at least one value in each of those fields.
    """
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    time = schema.fieldNames()[0]
    names = {f: f.name.lower().replace(" ", "_") for f in schema.fields if f.name != time}
    keep = {f: out for f, out in names.items() if fields is None or out in fields}
    raw = read_cells(spark, path, time, [time, *[f.name for f in keep]])
    if intraday:
        # vendors append an offset to local wall-clock time; the wall clock is kept
        wall = F.regexp_replace(F.replace("c0", F.lit("T"), F.lit(" ")), r"(Z|[+-]\d{2}:?\d{2})$", "")
        ts = wall.try_cast("timestamp_ntz")
    else:
        ts = F.try_to_date(F.substring("c0", 1, 10), "yyyy-MM-dd")
    values = [c.no_nan(F.col(f"c{k}").try_cast(f.dataType)).alias(out) for k, (f, out) in enumerate(keep.items(), 1)]
    out = raw.select(path_label(label, "file").alias("symbol"), ts.alias("ts"), *values)
    out = out.where("ts IS NOT NULL").na.drop("all", subset=list(keep.values()))
    return clean.require_fields(out, require) if require else out


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A consolidated Parquet table written by :mod:`barloom.sources.sinks`."""
    return spark.read.parquet(path)


def read_series(bars: DataFrame, dim: DataFrame | None = None, price_col: str = "adj_close") -> DataFrame:
    """Named price series ``(series_id, ts, value)`` with fallback to the plain close.

    ``dim(series_id, symbol)`` names the instruments; without it every instrument is its own series.
    """
    value = F.coalesce(price_col, "close") if price_col in bars.columns and price_col != "close" else F.col("close")
    rows = bars.select("symbol", "ts", value.alias("value")).where("value IS NOT NULL")
    if dim is None:
        return rows.withColumnRenamed("symbol", "series_id")
    return rows.join(dim.select("series_id", "symbol"), "symbol").select("series_id", "ts", "value")


def read_symbol_sets(spark: SparkSession, path: str, label: str = "file") -> DataFrame:
    """Folder of symbol lists -> ``(universe_id, symbol)``; the set is named after its file."""
    raw = read_cells(spark, path, "Symbol", ["Symbol"])
    rows = raw.select(path_label(label, "file").alias("universe_id"), F.col("c0").alias("symbol"))
    return rows.where("symbol IS NOT NULL").distinct()


def read_snapshots(
    spark: SparkSession, path: str, canon: DataFrame | None = None, label: str = "file"
) -> DataFrame:
    """Folder of constituent lists named ``yyyy-MM-dd`` -> ``(as_of, symbol, company, industry, series, isin)``."""
    from barloom.operators.membership import apply_canon

    columns = {"Symbol": "symbol", "Company Name": "company", "Industry": "industry", "Series": "series", "ISIN Code": "isin"}
    raw = read_cells(spark, path, "Symbol", list(columns))
    out = raw.select(
        F.try_to_date(path_label(label, "file"), "yyyy-MM-dd").alias("as_of"),
        *[F.col(f"c{k}").alias(name) for k, name in enumerate(columns.values())],
    ).where("as_of IS NOT NULL AND symbol IS NOT NULL")
    return out if canon is None else apply_canon(out, canon)


def parse_event_date(text: Column) -> Column:
    """Dates of mixed origin: day-first text or ISO."""
    t = F.trim(text)
    tried = [F.try_to_date(t, fmt) for fmt in ("dd-MM-yyyy", "dd/MM/yyyy", "dd-MMM-yyyy", "dd MMM yyyy", "d-M-yyyy")]
    return F.coalesce(*tried, F.try_to_date(F.substring(t, 1, 10), "yyyy-MM-dd"))


def parse_index_events(raw: DataFrame) -> DataFrame:
    """Inclusion/exclusion log -> ``(date, name, action)``; anything but an inclusion is an exclusion."""
    action = F.when(F.contains(F.col("Description"), F.lit("Inclusion")), "IN").otherwise("OUT")
    return raw.select(
        parse_event_date(F.col("`Event Date`")).alias("date"), F.trim("`Scrip Name`").alias("name"), action.alias("action")
    )


def read_index_events(spark: SparkSession, path: str) -> DataFrame:
    """CSV export of the log, see :func:`parse_index_events`."""
    reader = spark.read.schema(schemas.INDEX_EVENT_FILE).option("header", "true").option("multiLine", "true").option("escape", '"')
    return parse_index_events(reader.csv(path))
