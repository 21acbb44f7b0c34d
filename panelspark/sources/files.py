"""File sources: delimited text, symbol caches, index and factor text, panels and training folders."""

from __future__ import annotations

import uuid
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_delimited(spark: SparkSession, path: str, columns: dict[str, str], optional: dict[str, str] | None = None,
                   sep: str = "|") -> DataFrame:
    """Listed columns of a delimited file with a header, declared types, canonical names.

    Header names match case-insensitively; a missing listed column is an error. The schema follows
    the header's order, so the parser prunes every other column.
    """
    header = spark.read.option("header", True).option("sep", sep).csv(path).columns
    have = {h.upper(): h for h in header}
    missing = [c for c in columns if c.upper() not in have]
    if missing:
        raise ValueError(f"{path}: header lacks columns {missing}")
    wanted = {**columns, **{c: t for c, t in (optional or {}).items() if c.upper() in have}}
    types = {have[c.upper()]: t for c, t in wanted.items()}
    schema = T.StructType([
        T.StructField(h, T._parse_datatype_string(types[h]) if h in types else T.StringType()) for h in header])
    df = spark.read.schema(schema).option("header", True).option("sep", sep).csv(path)
    return df.select(*[F.col(f"`{have[c.upper()]}`").alias(c) for c in wanted])


def extract_filtered(rows: DataFrame, keys: DataFrame, key: str, date: str, lo: str, hi: str) -> DataFrame:
    """Rows whose key is in the set and whose date lies in [lo, hi].

    A semi join without a hint: Spark broadcasts the key set only while it is small.
    """
    inside = rows.where(F.col(date).between(F.lit(lo).cast("date"), F.lit(hi).cast("date")))
    return inside.join(keys.select(key).distinct(), key, "left_semi")


def extract_bundle(tables: dict[str, DataFrame], out: str, identity: dict[str, str]) -> None:
    """Write several member-restricted tables under one folder with a one-row identity table."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{out}/{name}")
    spark = next(iter(tables.values())).sparkSession
    row = spark.createDataFrame([tuple(identity.values())], ", ".join(f"{k} string" for k in identity))
    row.write.mode("overwrite").json(f"{out}/identity")


class ExtractMismatch(ValueError):
    """A stored extract was built with other settings than the requested ones."""


def identity_differences(spark: SparkSession, out: str, identity: dict[str, str]) -> DataFrame:
    """(field, stored, requested) for every setting that differs."""
    stored = spark.read.json(f"{out}/identity")
    names = list(identity)
    cells = [F.struct(F.lit(k).alias("field"), (F.col(k) if k in stored.columns else F.lit(None)).cast("string").alias("stored"),
                      F.lit(identity[k]).alias("requested")) for k in names]
    d = stored.select(F.inline(F.array(*cells)))
    return d.where(~F.col("stored").eqNullSafe(F.col("requested")))


def load_extract(spark: SparkSession, out: str, name: str, identity: dict[str, str]) -> DataFrame:
    bad = identity_differences(spark, out, identity).collect()  # at most one row per setting
    if bad:
        raise ExtractMismatch("; ".join(f"{r['field']}: {r['stored']} != {r['requested']}" for r in bad))
    return spark.read.parquet(f"{out}/{name}")


def _part(path, pattern: str):
    """First group of the pattern in a file path, missing when it does not match."""
    return F.nullif(F.regexp_extract(path, pattern, 1), F.lit(""))


def read_partitioned_training(spark: SparkSession, factors: str, labels: str, features, label: str,
                              limit: float = 0.2) -> DataFrame:
    """Factor files ``date/code.parquet`` left-joined to label files on (date, code, time).

    Date and code come from the file path (either form); a missing label is 0; rows with |label| >= limit are
    dropped; a (date, code) present on one side only gives no rows.
    """
    def tagged(path, cols):
        df = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").parquet(path)
        name = F.col("_metadata.file_path")
        # date/code.parquet, or the partitioned form date=d/code=c/part.parquet
        day = F.coalesce(_part(name, r"/date=([^/]+)/"), _part(name, r"/([^/]+)/[^/]+$"))
        code = F.coalesce(_part(name, r"/code=([^/]+)/"), _part(name, r"/([^/]+)\.parquet$"))
        return df.select(day.alias("date"), code.alias("code"), *cols)

    f = tagged(factors, [*features, F.col("close_time").alias("time")])
    lab = tagged(labels, [F.col("Time").alias("time"), label])
    keys = lab.select("date", "code").distinct()
    d = f.join(keys, ["date", "code"], "left_semi").join(lab, ["date", "code", "time"], "left").fillna(0, [label])
    return d.where(F.abs(label) < limit)


def list_data_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, bytes): every data file of a folder tree."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    return df.select("path", F.col("length").alias("bytes"))


def _file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and the path in it of a folder, given as uri (file, hdfs, s3, ...) or absolute path."""
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[len("file:"):].lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def write_symbol_cache(df: DataFrame, path: str, fields, order) -> list[str]:
    """One csv per symbol with its lines in ``order``; the folders to read, one for each task.

    Spark makes the lines and deals and sorts them; a task writes its symbols' files itself, because a folder, a checksum and a rename for each of
    very many small files take the writer longer than their rows. A repeated task has a folder of its own, and only those of tasks that ended are read.
    """
    line = F.concat(F.to_csv(F.struct(*fields)), F.lit("\n"))
    rows = df.select("symbol", *order, line.alias("line")).repartition("symbol").sortWithinPartitions("symbol", *order).select("symbol", "line")
    system, base = _file_system(path)
    system.create_dir(base, recursive=True)
    header = ",".join(fields).encode() + b"\n"
    folders = rows.mapInArrow(_write_symbols(path, header), "folder string").collect()  # one row for each task
    return [r["folder"] for r in folders] or [path]


def _symbol_file(symbol: str | None) -> str:
    """``sym.csv``; the folder form for a missing symbol and for names that readers take for hidden files."""
    if symbol is None:
        return "symbol=__HIVE_DEFAULT_PARTITION__/part.csv"
    name = quote(symbol, safe="")
    return f"symbol={name}/part.csv" if name[:1] in ("", "_", ".") else f"{name}.csv"


def _write_symbols(path: str, header: bytes):
    """For lines in order of their symbols: a symbol's lines are consecutive bytes of a batch and may go on in the next one."""

    def run(batches):
        folder = f"{path}/part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"
        system, base = _file_system(folder)
        out, last = None, None
        for b in batches:
            if not b.num_rows:
                continue
            symbols, lines = b.column(0), b.column(1).cast(pa.large_string())
            _, ends, data = lines.buffers()
            at = np.frombuffer(ends, np.int64)[lines.offset:lines.offset + len(lines) + 1]
            codes = symbols.dictionary_encode().indices.fill_null(-1).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(codes)) + 1).tolist(), len(codes)]
            for i, j in zip(cuts, cuts[1:]):
                symbol = symbols[i].as_py()
                if out is None or symbol != last:
                    if out is None:
                        system.create_dir(base, recursive=True)
                    else:
                        out.close()
                    file = f"{base}/{_symbol_file(symbol)}"
                    if file.endswith("/part.csv"):
                        system.create_dir(file.rsplit("/", 1)[0], recursive=True)
                    out, last = system.open_output_stream(file), symbol
                    out.write(header)
                out.write(data[int(at[i]):int(at[j])])
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"folder": [folder]})

    return run


def read_symbol_cache(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """One csv per symbol (``sym.csv`` or ``symbol=sym/``); of duplicate dates the last line wins."""
    raw = spark.read.schema(schema).option("header", True).option("recursiveFileLookup", True).csv(path)
    fields = [c for c in raw.columns if c != "date"]
    name = F.col("_metadata.file_path")
    # every line carries its file's path: plain string functions, the pattern only for the folder form
    file = F.substring_index(name, "/", -1)
    stem = F.when(file.endswith(".csv"), F.nullif(F.left(file, F.length(file) - 4), F.lit("")))
    symbol = F.when(name.contains("/symbol="), F.coalesce(_part(name, r"/symbol=([^/]+)/"), stem)).otherwise(stem)
    # line order inside one file: the block's start, then the position within its partition
    d = raw.select(symbol.alias("symbol"), "date", *fields, F.col("_metadata.file_block_start").alias("_b"),
                   F.monotonically_increasing_id().alias("_i"))
    last = F.max_by(F.struct(*fields), F.struct("_b", "_i"))
    return d.groupBy("symbol", "date").agg(last.alias("r")).select("symbol", "date", "r.*")


def save_panel(panel: DataFrame, path: str, fields) -> None:
    """One parquet folder per field in long form, partitioned by year."""
    keys = ["date", "entity"]
    for f in fields:
        panel.select(*keys, F.col(f).alias("value"), F.year("date").alias("year")).write.mode("overwrite").partitionBy(
            "year").parquet(f"{path}/{f}")


def load_panel(spark: SparkSession, path: str, fields, exclude: DataFrame | None = None) -> DataFrame:
    """The fields joined on (date, entity); sync-conflict copies (`name 2.parquet`) are skipped, excluded entities dropped."""
    out = None
    copy = F.col("_metadata.file_name").rlike(r"( |%20)\d+\.parquet$")
    for f in fields:
        one = spark.read.parquet(f"{path}/{f}").where(~copy).select("date", "entity", F.col("value").alias(f))
        out = one if out is None else out.join(one, ["date", "entity"], "full_outer")
    return out if exclude is None else out.join(exclude.select("entity"), "entity", "left_anti")


def load_index_history(spark: SparkSession, path: str, value: str = "close", fmt: str = "MM/dd/yyyy") -> DataFrame:
    """(date, value) of an index csv: header normalised, last duplicate date wins."""
    raw = spark.read.option("header", True).csv(path)
    cols = {c.strip().lower(): c for c in raw.columns}
    if "date" not in cols or value not in cols:
        raise ValueError(f"unexpected columns {raw.columns}")
    d = raw.select(F.to_date(F.trim(F.col(f"`{cols['date']}`")), fmt).alias("date"),
                   F.col(f"`{cols[value]}`").cast("double").alias("value"), F.monotonically_increasing_id().alias("_i"))
    return d.groupBy("date").agg(F.max_by("value", "_i").alias("value"))


def load_factor_text(spark: SparkSession, path: str) -> DataFrame:
    """Daily factor text: preamble and footer skipped, percent to decimal, <= -99 missing.

    The header is the line of names right before the first ``YYYYMMDD,`` line; the data block is the
    contiguous run after it. Lines are numbered within the file, which is small by format.
    """
    text = spark.read.text(path, wholetext=True).select(
        F.posexplode(F.split("value", r"\r?\n")).alias("n", "line"))
    text = text.withColumn("data", F.col("line").rlike(r"^\s*\d{8},"))
    head = text.where("data").agg(F.min("n").alias("first"))
    stop = text.join(F.broadcast(head), F.col("n") > F.col("first")).where("not data").agg(F.min("n").alias("stop"))
    first, end = head.scalar(), stop.scalar()
    names = text.where(F.col("n") == first - 1).first()["line"].split(",")[1:]
    cols = [c.strip().lower().replace("-", "_").replace(" ", "_") for c in names if c.strip()]
    block = text.where((F.col("n") >= first) & (F.col("n") < F.coalesce(end, F.lit(2**31 - 1))))
    parts = F.split("line", ",")
    values = [F.nullif(F.trim(parts[i + 1]), F.lit("")).cast("double") for i in range(len(cols))]
    return block.select(
        F.to_date(F.trim(parts[0]), "yyyyMMdd").alias("date"),
        *[(F.when(v > -99.0, v) / 100.0).alias(c) for c, v in zip(cols, values, strict=True)])


def require_rows(df: DataFrame, what: str) -> DataFrame:
    if df.isEmpty():
        raise ValueError(f"no rows for {what}")
    return df


def rows_of(df: DataFrame, column: str, value) -> DataFrame:
    """Rows of one index number or flag type; none is an error."""
    return require_rows(df.where(F.col(column) == F.lit(value)), f"{column} = {value}")


def flag_meanings(df: DataFrame, codes: DataFrame, code: str, out: str) -> DataFrame:
    """Attach the text of a flag code (``codes``: code, text)."""
    return df.join(codes.select(F.col("code").alias(code), F.col("text").alias(out)), code, "left")


def metadata_lines(spark: SparkSession, path: str, items) -> DataFrame:
    """Raw text lines that name any of the items."""
    return spark.read.text(path).where(F.col("value").rlike(r"\b(" + "|".join(items) + r")\b"))


def write_metrics(df: DataFrame, path: str) -> None:
    """csv with a header and strict json lines (missing values kept as null)."""
    clean = df.select(*[
        F.when(~F.isnan(c) & (F.abs(c) != float("inf")), F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])
    clean.write.mode("overwrite").option("header", True).csv(f"{path}/csv")
    clean.write.mode("overwrite").option("ignoreNullFields", False).json(f"{path}/json")


def save_fold_predictions(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").partitionBy("fold").parquet(path)


def write_coverage(report: DataFrame, columns, identifiers: DataFrame, path: str) -> None:
    """Write a report only after the aggregate-only check."""
    from ..operators.quality import assert_aggregate_only

    assert_aggregate_only(report, columns, identifiers)
    write_metrics(report, path)
