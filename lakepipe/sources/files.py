"""File sources: schema inference that is done once, incremental reads, rescued values."""

from __future__ import annotations

import csv
import io
import json
from collections.abc import Callable, Iterator, Mapping, Sequence
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RESCUED = "_rescued_data"
RECORD, FIELDS = "record", "fields"


def _file_system(spark: SparkSession, path: str):
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()), jvm_path


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, p = _file_system(spark, path)
    return fs.exists(p)


def delete_folder(spark: SparkSession, path: str) -> None:
    fs, p = _file_system(spark, path)
    fs.delete(p, True)


def delete_file(spark: SparkSession, path: str) -> None:
    fs, p = _file_system(spark, path)
    fs.delete(p, False)


def move_file(spark: SparkSession, path: str, target: str) -> None:
    """Move a file into a folder that is made where it is missing; a file of that name stays as it is."""
    fs, p = _file_system(spark, path)
    to = spark._jvm.org.apache.hadoop.fs.Path(target)
    fs.mkdirs(to.getParent())
    if not fs.rename(p, to):
        raise OSError(f"cannot move {path} to {target}")


def list_tree(spark: SparkSession, path: str) -> list[str]:
    """All data files below a folder, as full paths."""
    fs, p = _file_system(spark, path)
    found, entries = [], fs.listFiles(p, True)
    while entries.hasNext():
        file = entries.next().getPath()
        if not file.getName().startswith(("_", ".")):
            found.append(file.toString())
    return sorted(found)


def list_hidden(spark: SparkSession, path: str, prefix: str) -> list[str]:
    """Full paths of the sub-folders that Spark's readers pass over, by the start of their names."""
    fs, p = _file_system(spark, path)
    return sorted(s.getPath().toString() for s in fs.listStatus(p) if s.getPath().getName().startswith(prefix))


def list_folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the sub-folders: one dataset each in a landing zone, one value each below a partitioned table."""
    fs, p = _file_system(spark, path)
    names = [s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()]
    return sorted(n for n in names if "=" in n or not n.startswith(("_", ".")))


def list_files(spark: SparkSession, path: str, limit: int | None = None) -> list[str]:
    """Data files directly below a folder, by name; ``limit`` ends the listing early."""
    fs, p = _file_system(spark, path)
    if not fs.getFileStatus(p).isDirectory():
        return [path]
    found, entries = [], fs.listStatusIterator(p)
    while entries.hasNext():
        status = entries.next()
        if status.isFile() and not status.getPath().getName().startswith(("_", ".")):
            found.append(status.getPath().toString())
            if limit is not None and len(found) >= limit:
                break
    return sorted(found)


def read_small_text(spark: SparkSession, path: str) -> str | None:
    """Content of a small file, None where it is missing."""
    fs, p = _file_system(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode("utf-8")
    finally:
        stream.close()


def create_file(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small new file; False if it is there already."""
    fs, p = _file_system(spark, path)
    try:
        out = fs.create(p, False)
    except Exception as error:  # noqa: BLE001
        if "FileAlreadyExists" in str(error) or fs.exists(p):
            return False
        raise
    out.write(bytearray(text.encode("utf-8")))
    out.close()
    return True


def _one_file_a_task(spark: SparkSession) -> SparkSession:
    """A session beside this one in which a read gives each file its own task, and a task reads row by row."""
    side = spark.newSession()
    for name in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
        side.conf.set(name, str(1 << 40))
    side.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    return side


def csv_headers(
    spark: SparkSession, files: Sequence[str], options: Mapping[str, str] | None = None
) -> dict[tuple[str, ...], list[str]]:
    """Files by the column names of their first record; files without one are left out.

    Executors open the files with Spark's own reader: compressed files, other encodings and names with a line break in
    quotes are read as they are later. A task stops after the first record of its file. A name given twice gets a number.
    """
    if not files:
        return {}
    options = {k: v for k, v in (options or {}).items() if k not in ("header", "inferSchema", "maxFilesPerTrigger")}
    # of a record with more than one value the reader keeps the text
    kept = {"header": "false", "multiLine": "true", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__record"}
    reader = _one_file_a_task(spark).read.options(**{**options, **kept})
    records = reader.schema("__value string, __record string").csv(list(files))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch.slice(0, 1)
                return

    texts = records.select(F.col("_metadata.file_path").alias("file"), F.coalesce("__record", "__value").alias("header"))
    found = texts.mapInArrow(first, "file string, header string").groupBy("header").agg(F.collect_list("file").alias("files"))
    groups: dict[tuple[str, ...], list[str]] = {}
    for row in found.collect():
        text = (row["header"] or "").removeprefix("\ufeff")
        if not text:
            continue
        parsed = csv.reader(io.StringIO(text), delimiter=options.get("sep", ","), quotechar=options.get("quote", '"'))
        names = [name.strip() for name in next(parsed)]
        numbered = tuple(n if names.index(n) == i else f"{n}#{names[: i + 1].count(n)}" for i, n in enumerate(names))
        groups.setdefault(numbered, []).extend(unquote(f) for f in row["files"])
    return {names: sorted(paths) for names, paths in sorted(groups.items())}


def _for_header(names: Sequence[str], options: Mapping[str, str]) -> dict[str, str]:
    """Options that skip the whole header: one over several lines needs a reader that knows quotes before lines."""
    over_lines = any("\n" in n or "\r" in n for n in names)
    return {**options, "header": "true", **({"multiLine": "true"} if over_lines else {})}


def _text_schema(names: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def _cast(value: Column, kind: T.DataType, options: Mapping[str, str]) -> Column:
    """Text as a type; null where it does not fit."""
    if isinstance(kind, T.StringType):
        return value
    pattern = options.get("timestampFormat") if isinstance(kind, T.TimestampType) else options.get("dateFormat")
    if pattern and isinstance(kind, (T.TimestampType, T.DateType)):
        return F.try_to_timestamp(value, F.lit(pattern)).cast(kind)
    return F.trim(value).try_cast(kind)


def _as_json(parts: Mapping[str, Column]) -> Column:
    """The entries with a value as a JSON object; null when there is none."""
    names = F.array(*[F.lit(n) for n in parts])
    filled = F.map_filter(F.map_from_arrays(names, F.array(*parts.values())), lambda _, v: v.isNotNull())
    return F.when(F.size(filled) > 0, F.to_json(filled))


def _empty(spark: SparkSession, schema: T.StructType, rescue: str | None) -> DataFrame:
    fields = [*schema.fields, *([T.StructField(RESCUED, T.StringType())] if rescue else [])]
    return spark.createDataFrame([], T.StructType(fields))


def read_csv_by_header(
    spark: SparkSession,
    files: Sequence[str],
    schema: T.StructType,
    rescue: str | None = None,
    options: Mapping[str, str] | None = None,
) -> DataFrame:
    """CSV files whose columns are found by the names in each file's own header.

    A column that a file does not have is null. ``rescue``: ``fields`` keeps, as JSON in ``_rescued_data``, the values of
    columns the schema does not name, values that do not fit their type, and the whole text of a row with more or fewer
    values than the header (as ``_record``); ``record`` keeps that row's text in any of these cases.
    """
    options = {k: v for k, v in (options or {}).items() if k not in ("header", "maxFilesPerTrigger")}
    wanted = T.StructType([f for f in schema.fields if f.name != RESCUED])
    out = None
    for names, paths in csv_headers(spark, files, options).items():
        record = "__record"
        reader = spark.read.options(**_for_header(names, options)).option("columnNameOfCorruptRecord", record)
        texts = T.StructType([*_text_schema(names).fields, T.StructField(record, T.StringType())])
        rows = reader.schema(texts).csv(list(paths))
        rows = rows.toDF(*[f"__{i}" for i in range(len(names))], record)
        place = {n: F.col(f"__{i}") for i, n in enumerate(names)}
        typed = {
            f.name: _cast(place[f.name], f.dataType, options) if f.name in place else F.lit(None).cast(f.dataType)
            for f in wanted.fields
        }
        columns = [c.alias(n) for n, c in typed.items()]
        if rescue:
            left = {n: c for n, c in place.items() if n not in typed}
            for f in wanted.fields:
                if f.name in place and not isinstance(f.dataType, T.StringType):
                    left[f.name] = F.when(typed[f.name].isNull(), place[f.name])
            left["_record"] = F.col(record)
            lost = _as_json(left)
            if rescue == RECORD:
                text = F.to_csv(F.struct(*[c.alias(n) for n, c in place.items()]), {"sep": options.get("sep", ",")})
                lost = F.when(lost.isNotNull(), F.coalesce(F.col(record), text))
            columns.append(lost.alias(RESCUED))
        part = rows.select(*columns)
        out = part if out is None else out.unionByName(part)
    return _empty(spark, wanted, rescue) if out is None else out


def read_parquet_by_name(
    spark: SparkSession, files: Sequence[str], schema: T.StructType, rescue: str | None = None
) -> DataFrame:
    """Parquet files with differing columns and types, as ``schema``.

    With ``rescue`` the columns that the schema does not name and the values that cannot be cast are kept as JSON.
    """
    wanted = T.StructType([f for f in schema.fields if f.name != RESCUED])
    out = None
    for part in _parquet_parts(spark, list(files)):
        have = {f.name: f.dataType for f in part.schema.fields}
        typed = {
            f.name: (part[f"`{f.name}`"] if have[f.name] == f.dataType else part[f"`{f.name}`"].try_cast(f.dataType))
            if f.name in have
            else F.lit(None).cast(f.dataType)
            for f in wanted.fields
        }
        columns = [c.alias(n) for n, c in typed.items()]
        if rescue:
            left = {}
            for name, kind in have.items():
                text = part[f"`{name}`"].cast("string")
                if isinstance(kind, (T.StructType, T.ArrayType, T.MapType)):
                    text = F.to_json(part[f"`{name}`"])
                if name not in typed:
                    left[name] = text
                elif kind != wanted[name].dataType:
                    left[name] = F.when(typed[name].isNull(), text)
            columns.append((_as_json(left) if left else F.lit(None).cast("string")).alias(RESCUED))
        rows = part.select(*columns)
        out = rows if out is None else out.unionByName(rows)
    return _empty(spark, wanted, rescue) if out is None else out


def _parquet_parts(spark: SparkSession, files: list[str]) -> list[DataFrame]:
    """One frame over all files where their schemas merge, else one per schema."""
    if not files:
        return []
    try:
        return [spark.read.option("mergeSchema", True).parquet(*files)]
    except Exception as error:  # noqa: BLE001
        if "CANNOT_MERGE_SCHEMA" not in str(error) and "merge" not in str(error).lower():
            raise
    groups: dict[str, list[str]] = {}
    for path in files:
        groups.setdefault(spark.read.parquet(path).schema.json(), []).append(path)
    return [spark.read.parquet(*paths) for paths in groups.values()]


def read_bound(
    spark: SparkSession,
    files: Sequence[str],
    fmt: str,
    schema: T.StructType,
    rescue: str | None = None,
    options: Mapping[str, str] | None = None,
) -> DataFrame:
    """Given files as ``schema``, with columns found by name in each file and the rest rescued."""
    options = dict(options or {})
    if fmt == "csv":
        return read_csv_by_header(spark, files, schema, rescue, options)
    if fmt == "parquet":
        return read_parquet_by_name(spark, files, schema, rescue)
    if not files:
        return _empty(spark, schema, rescue)
    if fmt == "json" and options.get("multiLine") == "true" and rescue == FIELDS:
        documents = spark.read.text(list(files), wholetext=True)
        # a file holds one document or an array of them; a file that is neither is kept whole
        many = F.from_json("value", "array<string>")
        lines = documents.select(F.explode(F.coalesce(many, F.array("value"))).alias("value"))
        return rescue_fields(lines, schema)
    return _load(spark.read, list(files), fmt, schema, rescue, options)


def apply_hints(schema: T.StructType, hints: str | None) -> T.StructType:
    """Replace or add the fields named in a DDL string."""
    if not hints:
        return schema
    hinted = {f.name: f for f in T.StructType.fromDDL(hints).fields}
    kept = [hinted.pop(f.name, f) for f in schema.fields]
    return T.StructType([*kept, *hinted.values()])


def infer_schema(
    spark: SparkSession,
    path: str,
    fmt: str,
    infer_types: bool = True,
    hints: str | None = None,
    sample_files: int | None = None,
    options: Mapping[str, str] | None = None,
) -> T.StructType:
    """Schema of all files of a folder, or of a sample file; without ``infer_types`` every leaf is text.

    ``sample_files`` looks at that many files only: what the others have besides is then left to rescuing.
    """
    files = list_files(spark, path, sample_files) if sample_files or fmt == "csv" else []
    if fmt == "csv":
        found = _csv_schema(spark, files or [path], infer_types, options or {})
        return apply_hints(found, hints)
    reader = spark.read.format(fmt).options(**(options or {}))
    if fmt == "json" and not infer_types:
        reader = reader.option("primitivesAsString", True)
    if fmt == "parquet":
        reader = reader.option("mergeSchema", True)
    return apply_hints(reader.load(files or path).schema, hints)


def _csv_schema(
    spark: SparkSession, files: Sequence[str], infer_types: bool, options: Mapping[str, str]
) -> T.StructType:
    """All columns of all headers; a column that the files type differently is text, numbers the wider number."""
    kinds: dict[str, T.DataType] = {}
    for names, paths in csv_headers(spark, files, options).items():
        if infer_types:
            reader = spark.read.options(**_for_header(names, options)).option("inferSchema", True)
            found = [f.dataType for f in reader.csv(paths).schema.fields]
        else:
            found = [T.StringType()] * len(names)
        for name, kind in zip(names, found, strict=False):
            kinds[name] = kind if name not in kinds else _wider(kinds[name], kind)
    return T.StructType([T.StructField(n, k) for n, k in kinds.items()])


_NUMBERS = (T.IntegerType, T.LongType, T.DoubleType)


def _wider(one: T.DataType, two: T.DataType) -> T.DataType:
    if one == two:
        return one
    ranks = [next((i for i, n in enumerate(_NUMBERS) if isinstance(k, n)), None) for k in (one, two)]
    return T.StringType() if None in ranks else _NUMBERS[max(ranks)]()


def widen(schema: T.StructType, seen: T.StructType) -> T.StructType:
    """The schema plus the fields that only ``seen`` has; known fields keep their type."""
    return T.StructType([*schema.fields, *[f for f in seen.fields if f.name not in schema.names]])


def remembered_schema(
    spark: SparkSession, location: str, make: Callable[[], T.StructType], evolve: bool = False
) -> T.StructType:
    """Schema kept below ``location``, so that a restarted stream reads as it did before.

    ``make()`` runs the first time only, or with ``evolve`` also to find new fields.
    """
    stored = None
    if path_exists(spark, location):
        text = spark.read.text(location, wholetext=True).first()["value"]
        stored = T.StructType.fromJson(json.loads(text))
        if not evolve:
            return stored
    schema = make() if stored is None else widen(stored, make())
    if schema != stored:
        row = spark.createDataFrame([(schema.json(),)], "value string")
        row.coalesce(1).write.mode("overwrite").text(location)
    return schema


def _reader_options(fmt: str, multi_line: bool, options: Mapping[str, str] | None) -> dict[str, str]:
    chosen = dict(options or {})
    if fmt == "csv":
        chosen.setdefault("header", "true")
    if multi_line:
        chosen["multiLine"] = "true"
    return chosen


def _load(
    reader, path: str, fmt: str, schema: T.StructType, rescue: str | None, options: Mapping[str, str]
) -> DataFrame:
    """Load by a batch or stream reader, with the wanted way to rescue what does not fit."""
    if rescue not in (None, RECORD, FIELDS):
        raise ValueError(f"unknown way to rescue: {rescue!r}")
    if rescue == FIELDS:
        if fmt != "json" or options.get("multiLine") == "true":
            raise ValueError("single fields can be rescued from JSON lines only")
        kept = {k: v for k, v in options.items() if k == "maxFilesPerTrigger"}
        return rescue_fields(reader.format("text").options(**kept).load(path), schema)
    if rescue == RECORD and RESCUED not in schema.names:
        schema = T.StructType([*schema.fields, T.StructField(RESCUED, T.StringType())])
        options = {**options, "columnNameOfCorruptRecord": RESCUED}
    return reader.format(fmt).options(**options).schema(schema).load(path)


def read_files(
    spark: SparkSession,
    path: str,
    fmt: str,
    schema: T.StructType | str | None = None,
    multi_line: bool = False,
    rescue: str | None = None,
    options: Mapping[str, str] | None = None,
) -> DataFrame:
    """Batch read; see ``stream_files`` for ``rescue``."""
    chosen = _reader_options(fmt, multi_line, options)
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    if schema is None:
        if fmt == "parquet":
            return spark.read.options(**{"mergeSchema": "true", **chosen}).parquet(path)
        schema = infer_schema(spark, path, fmt, options=chosen)
    if rescue not in (None, RECORD, FIELDS):
        raise ValueError(f"unknown way to rescue: {rescue!r}")
    headed = fmt == "csv" and chosen["header"].lower() == "true"
    if headed or (rescue and fmt == "parquet"):
        return read_bound(spark, list_files(spark, path), fmt, schema, rescue, chosen)
    return _load(spark.read, path, fmt, schema, rescue, chosen)


def stream_files(
    spark: SparkSession,
    path: str,
    fmt: str,
    schema: T.StructType | str | None = None,
    schema_location: str | None = None,
    infer_types: bool = True,
    hints: str | None = None,
    sample_files: int | None = None,
    evolve: bool = False,
    multi_line: bool = False,
    rescue: str | None = None,
    max_files_per_trigger: int | None = None,
    options: Mapping[str, str] | None = None,
) -> DataFrame:
    """Incremental read of a folder: each file is delivered once per checkpoint.

    Without ``schema`` the schema is inferred from all files (or ``sample_files`` of
    them) and remembered at ``schema_location``; with ``evolve`` all files are looked
    at again and new fields added. CSV columns are taken by position here, and a file
    whose header differs is refused; ``ingest_folder`` takes them by name.
    ``rescue`` adds the column ``_rescued_data``: ``record`` keeps the text of a
    record that does not fit, ``fields`` (JSON lines) keeps just the fields that
    do not fit or are not in the schema, so that nothing gets lost.
    """
    chosen = _reader_options(fmt, multi_line, options)
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    if schema is None:

        def infer() -> T.StructType:
            sample = None if evolve else sample_files
            return infer_schema(spark, path, fmt, infer_types, hints, sample, chosen)

        schema = (
            remembered_schema(spark, schema_location, infer, evolve) if schema_location else infer()
        )
    if fmt == "csv":
        chosen.setdefault("enforceSchema", "false")
    if max_files_per_trigger:
        chosen["maxFilesPerTrigger"] = str(max_files_per_trigger)
    return _load(spark.readStream, path, fmt, schema, rescue, chosen)


def _does_not_fit(raw: Column, typed: Column, kind: T.DataType) -> Column:
    """True when the JSON text ``raw`` holds something that ``typed`` has lost, at any depth."""
    lost = typed.isNull()
    if isinstance(kind, T.StructType):
        fields = F.from_json(raw, "map<string,string>")
        unknown = F.map_filter(fields, lambda k, v: v.isNotNull() & ~k.isin(kind.names))
        lost = lost | (F.size(unknown) > 0)
        for f in kind.fields:
            lost = lost | _does_not_fit(fields[f.name], typed.getField(f.name), f.dataType)
    elif isinstance(kind, T.ArrayType):
        items = F.from_json(raw, "array<string>")
        pairs = F.zip_with(items, typed, lambda r, t: _does_not_fit(r, t, kind.elementType))
        lost = lost | F.exists(pairs, lambda p: p)
    return raw.isNotNull() & F.coalesce(lost, F.lit(False))


def rescue_fields(
    lines: DataFrame, schema: T.StructType | str, text: str = "value", keep: Sequence[str] = ()
) -> DataFrame:
    """Parse JSON lines and rescue single fields instead of whole records.

    ``_rescued_data`` holds, as JSON, the fields that the schema does not name
    and those that do not fit their type, also somewhere inside; a line that is
    no JSON object is kept whole. The other fields are delivered as usual.
    """
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    parsed = lines.withColumns(
        {"__raw": F.from_json(text, "map<string,string>"), "__typed": F.from_json(text, schema)}
    )

    # one check per field of the schema; all other keys are unknown
    unknown = F.map_filter("__raw", lambda k, v: v.isNotNull() & ~F.array_contains(F.array(*map(F.lit, schema.names)), k))
    raw, typed = F.col("__raw"), F.col("__typed")
    unfit = [
        F.when(_does_not_fit(F.element_at(raw, f.name), typed.getField(f.name), f.dataType), F.lit(f.name))
        for f in schema.fields
    ]
    lost = F.array_compact(F.array(*unfit)) if unfit else F.array().cast("array<string>")
    misfits = F.map_from_arrays(lost, F.transform(lost, lambda k: F.element_at(raw, k)))
    leftover = F.map_concat(unknown, misfits)
    rescued = F.when(F.col("__raw").isNull(), F.col(text)).when(
        F.size(leftover) > 0, F.to_json(leftover)
    )
    return parsed.select(
        *keep,
        *[F.col("__typed").getField(n).alias(n) for n in schema.names],
        rescued.alias(RESCUED),
    )


def delimited_table(
    lines: DataFrame, schema: str, text: str = "value", delimiter: str = ",", trim: bool = True
) -> DataFrame:
    """Lines of delimited text as typed columns; a value that cannot be cast becomes null."""
    fields = T.StructType.fromDDL(schema).fields
    as_text = T.StructType([T.StructField(f.name, T.StringType()) for f in fields])
    options = {"sep": delimiter}
    if trim:
        options |= {"ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true"}
    row = F.from_csv(F.col(text), as_text.simpleString()[len("struct<") : -1].replace(":", " "), options)
    parsed = lines.select(row.alias("r")).select("r.*")
    return parsed.select(
        *[
            F.col(f.name) if isinstance(f.dataType, T.StringType) else F.col(f.name).try_cast(f.dataType).alias(f.name)
            for f in fields
        ]
    )


def table_on_path(spark: SparkSession, fmt: str, path: str, columns: str = "*") -> DataFrame:
    """Query files by path in SQL."""
    return spark.sql(f"SELECT {columns} FROM {fmt}.`{path}`")


def preview(df: DataFrame, limit: int = 10) -> DataFrame:
    return df.limit(limit)
