"""Large tab-separated files as a Python data source that takes equality filters and reads a file in ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


def scan_tsv(spark: SparkSession, path: str, schema: str, range_bytes: int = 64 << 20) -> DataFrame:
    r"""Rows of a file with a header line; ``schema`` names columns of it, in any order. ``\N`` is null, empty text and ``NA`` are text.

    Equality of a text column with a constant is tested while a block is parsed, so only rows that pass reach Spark. A plain file is read
    in ranges of ``range_bytes``, each from its first whole line on; a gzip file is one range and is read as it is unpacked.
    ``path`` is anything that pyarrow's file systems open. Numbers that do not parse end the scan with an error. Switches Spark's
    push-down to Python sources on for the session, since a source with filters is refused without it.
    """
    spark.conf.set(PUSHDOWN, "true")
    source = _source()
    spark.dataSource.register(source)
    return spark.read.format(source.name()).schema(schema).option("path", path).option("range_bytes", str(range_bytes)).load()


def _source() -> type:
    """The classes are made here, so that they travel to the tasks as they are."""
    import io
    from collections.abc import Iterable, Iterator

    import pyarrow as pa
    from pyarrow import compute, csv, fs
    from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    class Range(InputPartition):
        def __init__(self, begin: int, end: int | None, header: list[str]):
            super().__init__((begin, end))
            self.begin, self.end, self.header = begin, end, header

    class Reader(DataSourceReader):
        def __init__(self, schema: StructType, options: dict[str, str]):
            self.wanted = to_arrow_schema(schema)
            self.path, self.range_bytes, self.block = options["path"], int(options["range_bytes"]), 8 << 20
            self.equal: dict[str, str] = {}

        def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
            for f in filters:
                column = f.attribute[0] if isinstance(f, EqualTo) and len(f.attribute) == 1 else None
                if column in self.wanted.names and isinstance(f.value, str) and self.equal.get(column, f.value) == f.value:
                    self.equal[column] = f.value
                else:
                    yield f

        def opened(self) -> tuple[object, int | None]:
            system, path = fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)
            if path.endswith(".gz"):
                return system.open_input_stream(path, compression="gzip"), None
            return system.open_input_file(path), system.get_file_info(path).size

        def partitions(self) -> list[InputPartition]:
            stream, size = self.opened()
            head = b""
            with stream:
                while b"\n" not in head and (more := stream.read(1 << 16)):
                    head += more
            header = head.partition(b"\n")[0].decode().rstrip("\r").split("\t")
            if size is None:
                return [Range(0, None, header)]
            return [Range(at, min(size, at + self.range_bytes), header) for at in range(0, size, self.range_bytes)] or [Range(0, 0, header)]

        def blocks(self, part: Range) -> Iterator[bytes]:
            """Whole lines that begin in the range; the header is the first line of the file."""
            stream, _ = self.opened()
            with stream:
                at, rest = part.begin, b""
                if at:
                    stream.seek(at - 1)
                    at -= 1
                skipping = True  # up to the end of the line that began before, or of the header
                while more := stream.read(self.block):
                    at += len(more)
                    rest += more
                    if skipping:
                        cut = rest.find(b"\n")
                        if cut < 0:
                            continue
                        begin, rest, skipping = at - len(rest) + cut + 1, rest[cut + 1 :], False
                        if part.end is not None and begin >= part.end:
                            return
                    done = part.end is not None and at >= part.end
                    if done:  # the line that holds the last byte of the range ends the last block
                        last = max(0, len(rest) - (at - part.end) - 1)
                        cut = rest.find(b"\n", last)
                        if cut < 0:
                            continue
                    else:
                        cut = rest.rfind(b"\n")
                    if cut >= 0:
                        yield rest[: cut + 1]
                        rest = rest[cut + 1 :]
                    if done:
                        return
                if rest and not skipping:
                    yield rest

        def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
            names = self.wanted.names
            convert = csv.ConvertOptions(column_types=dict.fromkeys(names, pa.string()), include_columns=names, null_values=["\\N"], strings_can_be_null=True, quoted_strings_can_be_null=True)
            shape = csv.ReadOptions(column_names=partition.header)
            plain = csv.ParseOptions(delimiter="\t", quote_char=False, newlines_in_values=False)
            for block in self.blocks(partition):
                table = csv.read_csv(io.BytesIO(block), shape, plain, convert)
                for column, value in self.equal.items():
                    table = table.filter(compute.equal(table.column(column), value))
                if table.num_rows:
                    yield from table.cast(self.wanted).to_batches()

    class Tsv(DataSource):
        @classmethod
        def name(cls) -> str:
            return "spanlight_tsv"

        def reader(self, schema: StructType) -> DataSourceReader:
            return Reader(schema, dict(self.options))

    return Tsv
