"""Text tables in and out. Every cell is text; nothing is inferred or trimmed."""

from __future__ import annotations

import csv
import io
import itertools
import re
import uuid
from collections.abc import Callable, Iterator, Mapping, Sequence
from urllib.parse import unquote

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from burnish.operators.grade import Sheets
from burnish.operators.ordering import names, quoted
from burnish.session import settle, shipped

ORDER = "_order"
_DIALECT = {"header": True, "escape": '"', "encoding": "UTF-8"}


def header_of(spark: SparkSession, path: str) -> list[str]:
    """Header texts as they stand in the file, or in one file of the folder."""
    first = spark.read.options(**_DIALECT | {"header": False}, multiLine=True).csv(path).head(1)
    return [cell or "" for cell in first[0]] if first else []


def heads(spark: SparkSession, path: str | Sequence[str]) -> dict[str, str]:
    """The first record of every file, as it is written, by the file's full path; files without one are left out.

    One task per file, which stops reading after that record; lines go to it one by one, so that few are read ahead.
    """

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends_inside = record_scanner()
        lines, inside = [], False
        for batch in batches:
            for line in batch.column(0).to_pylist():
                if not (inside or line.strip()):
                    continue
                lines.append(line)
                inside = ends_inside(line, inside)
                if not inside:
                    yield pa.RecordBatch.from_arrays([pa.array(["\n".join(lines)]), batch.column(1).slice(0, 1)], names=["head", "file"])
                    return

    shipped(spark)
    whole = {
        "spark.sql.files.maxPartitionBytes": str(1 << 40),
        "spark.sql.files.openCostInBytes": str(1 << 40),
        "spark.sql.execution.arrow.maxRecordsPerBatch": "1",
    }
    before = {k: spark.conf.get(k) for k in whole}
    lines = spark.read.option("lineSep", "\n").text(path).select("value", F.col("_metadata.file_path").alias("file"))
    try:
        for k, v in whole.items():
            spark.conf.set(k, v)  # a file is one partition, and a partition one file
        found = lines.mapInArrow(first, "head string, file string").collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    return {r["file"]: r["head"] for r in found}


def cells_of(head: str) -> list[str]:
    """Cells of a record as it is written."""
    return next(csv.reader(io.StringIO(head.removesuffix("\r"), newline="")), [])


def record_scanner() -> Callable[[str, bool], bool]:
    """A function that tells whether a record goes on behind a line, given whether it did before it.

    A quote opens a cell only where a cell begins, two quotes inside are one, and what follows the closing quote
    up to the next comma belongs to the cell.
    """
    # Cells that end in this line, then one that is open at its end.
    opens = re.compile(r'(?:(?:"(?:[^"]++|"")*+"[^,]*+|(?!")[^,]*+),)*+"(?:[^"]++|"")*+\Z')
    closes = re.compile(r'(?:[^"]++|"")*+"[^,]*+')

    def ends_inside(line: str, inside: bool) -> bool:
        if '"' not in line:
            return inside
        if inside:
            closed = closes.match(line)
            if closed is None:
                return True
            at = closed.end()
            return at < len(line) and opens.match(line, at + 1) is not None
        return opens.match(line) is not None

    return ends_inside


def read_table(
    spark: SparkSession,
    path: str,
    columns: Sequence[str] | None = None,
    ordered: bool = False,
    multiline: bool = True,
    broken: str | None = None,
    split: bool | None = None,
) -> DataFrame:
    """All-text DataFrame of a delimited file or folder; blank cells are null.

    Header texts stay as they are, also if they differ in case only, repeat, or
    hold dots. Files of a folder must have the same header, else reading raises.
    Line breaks inside quotes are part of a cell. With ``split`` many tasks read one
    file, else one; by default a single file is split that is larger than the session's
    partitions of files. The rows are the same, and so is their order. ``multiline``
    off reads a file in pieces without a look at what its quotes enclose, and raises
    on a row that was cut. ``columns``, if given, is the header, and saves the look at
    it. ``ordered`` adds a column ``_order`` with the place of each row in its file.
    ``broken`` names a column that gets the text of rows with too many or too few fields.
    """
    header = list(columns) if columns is not None else header_of(spark, path)
    # Headers that Spark could not tell apart are read by place.
    plain = len({h.lower() for h in header}) == len(header) and all(header)
    if split is None:
        split = multiline and _large_file(spark, path)
    if split or not plain:
        found = heads(spark, path)
        if len({tuple(cells_of(head)) for head in found.values()}) > 1:
            raise ValueError(f"files with different headers in {path}")
        firsts = {file: head.split("\n")[0] for file, head in found.items()}
        # Lines that end in a carriage return alone are one line to a task.
        split = split and not any("\r" in line[:-1] for line in firsts.values())
    cells = header if plain else [f"_c{i}" for i in range(len(header))]
    schema = StructType([StructField(c, StringType()) for c in [*cells, *([broken] if broken else [])]])
    options = {**_DIALECT, "multiLine": multiline, "enforceSchema": not plain}
    if broken:
        options["columnNameOfCorruptRecord"] = broken
    elif not multiline:
        options["mode"] = "FAILFAST"
    if split and header:
        paired = {file for file, line in firsts.items() if line.endswith("\r")}
        table = _split_table(spark, path, schema, options, ordered, paired)
    else:
        table = spark.read.options(**options).schema(schema).csv(path)
        if ordered:
            table = with_file_order(table)
    return table if plain else table.toDF(*header, *table.columns[len(header) :])


def _large_file(spark: SparkSession, path: str) -> bool:
    """Whether the path is a file that Spark would cut, were it not for line breaks in cells."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(at):
        return False
    status = system.getFileStatus(at)
    most = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    return status.isFile() and status.getLen() > most


def _split_table(spark: SparkSession, path: str, schema: StructType, options: dict, ordered: bool, paired: set[str]) -> DataFrame:
    """Rows of files whose splits are read by tasks of their own, quoted line breaks or not.

    A split does not know whether it starts inside a cell. In a first pass it says how it would end in either
    case, and whether a record would begin in it. Composed in order, one row per split, that tells how each starts,
    and which split began the record that goes on in it. In a second pass each split gives its records; the two
    pieces or more of one that runs over a border are put together by the split that began it. The header goes.
    ``paired`` are the files whose lines end in carriage return and line feed; such a pair is one line break to them.
    """
    lines = shipped(spark).read.option("lineSep", "\n").text(path)
    lines = lines.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], Iterator[list[str]]]]:
        """Splits in a partition one after the other, each with its lines in lists."""

        def told() -> Iterator[tuple[tuple[str, int], list[str]]]:
            for batch in batches:
                values, files, starts = (batch.column(i).to_pylist() for i in range(3))
                places = zip(files, starts, values, strict=True)
                for place, own in itertools.groupby(places, key=lambda r: r[:2]):
                    yield place, [r[2] for r in own]

        for place, own in itertools.groupby(told(), key=lambda r: r[0]):
            yield place, (r[1] for r in own)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends_inside = record_scanner()
        for (file, start), parts in runs(batches):
            out, into, begins_out, begins_into = False, True, False, False
            for own in parts:
                for line in own:
                    begins_out |= not out
                    begins_into |= not into
                    if '"' in line:
                        same = out == into
                        out = ends_inside(line, out)
                        into = out if same else ends_inside(line, into)
            row = [[file], [start], [out], [into], [begins_out], [begins_into]]
            yield pa.RecordBatch.from_arrays(list(map(pa.array, row)), names=["file", "start", "out", "into", "begins_out", "begins_into"])

    shape = "file string, start long, out boolean, into boolean, begins_out boolean, begins_into boolean"
    state: dict[tuple[str, int], tuple[bool, int]] = {}  # does the split start inside a record, and which split began it
    at, inside, owner = None, False, 0
    for r in sorted(lines.mapInArrow(look, shape).collect()):
        if r["file"] != at:
            at, inside, owner = r["file"], False, 0
        state[at, r["start"]] = inside, owner
        owner = r["start"] if r["begins_into" if inside else "begins_out"] else owner
        inside = r["into" if inside else "out"]
    known = spark.sparkContext.broadcast((state, paired))

    def records(pieces: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        """The splits' whole records, or the pieces of those that run over a border."""

        def give(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ends_inside = record_scanner()
            for (file, start), parts in runs(batches):
                inside, owner = known.value[0][file, start]
                ending = "\r" if file in known.value[1] else ""
                began, row, held = start if not inside else owner, 0, []
                for own in parts:
                    out: list[tuple[int, int, str]] = []
                    for line in own:
                        if not inside:
                            began = start
                        held.append(line)
                        inside = ends_inside(line, inside)
                        if inside:
                            continue
                        # Blank lines are no records; a record that another split began is a piece.
                        text = "\n".join([part.removesuffix(ending) for part in held])
                        if (began != start) == pieces and (text or began != start):
                            out.append((began, row, text))
                        row += bool(text) or began != start
                        held = []
                    if out:
                        yield batch_of(file, start, out)
                if held and pieces:
                    yield batch_of(file, start, [(began, row, "\n".join([part.removesuffix(ending) for part in held]))])

        return give

    def batch_of(file: str, start: int, found: list[tuple[int, int, str]]) -> pa.RecordBatch:
        n = len(found)
        columns = [[file] * n, [start] * n, *map(list, zip(*found, strict=True))]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names_)

    names_ = ["file", "start", "began", "row", "text"]
    shape = "file string, start long, began long, row long, text string"
    whole = lines.mapInArrow(records(False), shape).select("file", "start", "row", "text")
    pieces = lines.mapInArrow(records(True), shape).groupBy("file", "began")
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("start", "row", "text"))), lambda p: p["text"]), "\n")
    row = F.min_by("row", "start")
    stitched = pieces.agg(row.alias("row"), joined.alias("text")).select("file", F.col("began").alias("start"), "row", "text")
    every = whole.unionByName(stitched).where("not (start = 0 and row = 0)")
    as_text = {k: str(v).lower() if isinstance(v, bool) else v for k, v in options.items() if k not in ("header", "enforceSchema")}
    parsed = every.select(F.from_csv("text", _ddl(schema), as_text).alias("cells"), "file", "start", "row")
    order = [F.struct("file", "start", "row").alias(ORDER)] if ordered else []
    return parsed.select(*(F.col("cells").getField(f.name).alias(f.name) for f in schema.fields), *order)


def _ddl(schema: StructType) -> str:
    return ", ".join(f"`{f.name.replace('`', '``')}` string" for f in schema.fields)


def read_sheets(spark: SparkSession, paths: Mapping[str, str]) -> Sheets:
    """Tables of many tasks, by task, in one scan: rows with their task, cells by place, and the headers aside.

    The plan does not grow with the tasks. A path may be a file or a folder of parts with one header. Tables without a
    header are left out.
    """
    found = heads(spark, list(paths.values()))
    conf, tasks = spark._jsc.hadoopConfiguration(), {}
    for task, path in paths.items():
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        tasks[_bare(at.getFileSystem(conf).makeQualified(at).toString())] = task
    task_of = {}
    for file in found:
        bare = _bare(unquote(file))
        task_of[file] = tasks[bare] if bare in tasks else tasks[bare.rsplit("/", 1)[0]]
    headers: dict[str, list[str]] = {}
    for file, head in found.items():
        cells = cells_of(head)
        if headers.setdefault(task_of[file], cells) != cells:
            raise ValueError(f"files with different headers in {paths[task_of[file]]}")
    width = max(map(len, headers.values()), default=1)
    schema = StructType([StructField(f"c{i}", StringType()) for i in range(width)])
    table = with_file_order(spark.read.options(**_DIALECT, multiLine=True).schema(schema).csv(list(paths.values())))
    whose = spark.createDataFrame([(f, t) for f, t in task_of.items()], "of string, task string")
    rows = table.join(F.broadcast(whose), F.col(f"{ORDER}.file") == F.col("of"))  # a row per file
    return Sheets(rows.select("task", F.array(*schema.names).alias("cells"), F.col(ORDER).alias("place")), headers)


def _bare(path: str) -> str:
    """A full path with one slash where its scheme ends, if it names no host."""
    return re.sub(r"^(\w+):/(?://)?(?!/)", r"\1:/", path)


def read_table_or_empty(spark: SparkSession, path: str | None, stored: bool = False, **options: object) -> DataFrame:
    """As ``read_table``; a path that cannot be read gives a table without columns.

    ``stored`` reads the rows at once and keeps them under the shared folder, so that a file which breaks off on the
    way counts as one that cannot be read, too. What has other causes raises.
    """
    try:
        table = read_table(spark, path, **options)
        return settle(table, "read") if stored else table
    except (AnalysisException, TypeError, AttributeError):
        pass
    except (PySparkException, Py4JJavaError) as error:
        if not unreadable(error):
            raise
    return spark.createDataFrame([], StructType())


def unreadable(error: Exception) -> bool:
    """Whether the data are at fault: Spark names a file that could not be read, or a malformed record."""
    condition = (error.getCondition() or "") if isinstance(error, PySparkException) else ""
    return condition.startswith(("FAILED_READ_FILE", "MALFORMED_")) or any(c in str(error) for c in ("[FAILED_READ_FILE", "[MALFORMED_"))


def with_file_order(table: DataFrame) -> DataFrame:
    """Add ``_order``: file, start of the split in it, running number in the split.

    Must come right after the scan, while a task still reads whole splits in
    file order.
    """
    place = F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("row"),
    )
    return table.withColumn(ORDER, place)


def write_table(
    df: DataFrame, path: str, order: str | Sequence[str] | None = None, mode: str = "errorifexists", one_file: bool = False
) -> None:
    """Write delimited files with a header, padding kept and quotes doubled.

    With ``order`` the files, in name order, hold the rows in that order;
    columns of that name which are no text table cells are left out. With
    ``one_file`` the path is a file: tasks write its parts, which the file system then
    joins behind one header, under another name until it is whole.
    """
    order = names(order)
    spark = df.sparkSession
    if order:
        by = [quoted(c) for c in order]
        df = df.repartitionByRange(*by).sortWithinPartitions(*by)
    df = df.drop(*[c for c in order if c.startswith("_")])
    # What the header needs of quotes is told by a first row; names of the columns can then be told apart.
    plain = df.toDF(*(f"c{i}" for i in range(len(df.columns)))) if one_file else df
    told_apart = spark.conf.get("spark.sql.caseSensitive")
    try:
        if len({c.lower() for c in plain.columns}) < len(plain.columns):
            spark.conf.set("spark.sql.caseSensitive", "true")  # headers may differ in case only
        if one_file:
            _write_one(plain, df.columns, path, mode)
        else:
            _writer(plain, mode, True).csv(path)
    finally:
        spark.conf.set("spark.sql.caseSensitive", told_apart)


def _writer(df: DataFrame, mode: str, header: bool) -> DataFrameWriter:
    return df.write.mode(mode).options(
        **_DIALECT | {"header": header}, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, emptyValue="", nullValue=""
    )


def _write_one(df: DataFrame, headers: list[str], path: str, mode: str) -> None:
    """One file from parts: joined where the file system can, else copied from stream to stream, a buffer at a time."""
    spark = df.sparkSession
    java, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    target = java.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(conf)
    if system.exists(target):
        if mode == "ignore":
            return
        if mode != "overwrite":
            raise FileExistsError(path)
    # Beside the target, so that the last step is a rename in one file system.
    parent = target.getParent() or java.org.apache.hadoop.fs.Path(".")
    folder = java.org.apache.hadoop.fs.Path(parent, f"_{target.getName()}-{uuid.uuid4().hex}")
    try:
        spark.createDataFrame([headers], ", ".join(f"c{i} string" for i in range(len(headers)))).coalesce(1).write.options(
            **_DIALECT | {"header": False}, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, emptyValue="", nullValue=""
        ).csv(f"{folder.toString()}/head")
        _writer(df, "errorifexists", False).csv(f"{folder.toString()}/rows")
        parts = []
        for name in ("head", "rows"):
            listed = system.listStatus(java.org.apache.hadoop.fs.Path(folder, name))
            own = [s.getPath() for s in listed if s.getPath().getName().startswith("part-") and s.getLen() > 0]
            parts += sorted(own, key=lambda p: p.getName())
        joined = java.org.apache.hadoop.fs.Path(folder, "joined")
        out = system.create(joined)
        try:
            for part in parts:
                into = system.open(part)
                try:
                    java.org.apache.hadoop.io.IOUtils.copyBytes(into, out, 1 << 20, False)
                finally:
                    into.close()
        finally:
            out.close()
        if system.exists(target):
            system.delete(target, True)
        if not system.rename(joined, target):
            raise OSError(f"cannot rename to {path}")
    finally:
        system.delete(folder, True)
