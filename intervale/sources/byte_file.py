"""A Spark data source for the byte file of monomorphic sites.

The file has one byte a position, chromosome after chromosome in the order of the
``.chroms`` file; code 0 has no site. A partition is a chunk of a chromosome, read by its
offset. Filters on chrom, st and en choose the chunks, and those that cannot hold a row
are not read. Rows are runs of equal codes, cut at chunk borders, and at the filters'
only by Spark, which applies them once more.

``{base}.db`` is a file, or a folder of parts in the order of their names, as
``write_byte_file`` leaves it. The file system must be one that pyarrow opens.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

SCHEMA = "chrom string, st long, en long, idx short"
NAME = "intervale_bytes"
CHUNK = 1 << 22


def _system(path: str):
    from pyarrow import fs

    if path.startswith("file:") or "://" not in path:
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path)


def _parts(base: str) -> list[tuple[str, int]]:
    """The files of ``{base}.db`` and their lengths, in order."""
    from pyarrow import fs

    system, name = _system(f"{base}.db")
    info = system.get_file_info(name)
    if info.type == fs.FileType.Directory:
        found = [i for i in system.get_file_info(fs.FileSelector(name)) if i.type == fs.FileType.File and i.base_name.startswith("part-")]
        return [(i.path, i.size) for i in sorted(found, key=lambda i: i.base_name)]
    return [(name, info.size)]


@dataclass
class Chunk(InputPartition):
    """A piece of a chromosome: its first position, its bytes' place in the whole, and their number."""

    chrom: str
    st: int
    at: int
    size: int


class ByteReader(DataSourceReader):
    def __init__(self, base: str, chunk: int):
        self.base, self.chunk = base, chunk
        self.chroms: set[str] | None = None
        self.least_en, self.most_st = None, None  # rows need en > least_en and st < most_st

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Note what chooses chunks; Spark applies all filters itself as well."""
        for f in filters:
            match f:
                case EqualTo(("chrom",), value):
                    self.chroms = {value} if self.chroms is None else self.chroms & {value}
                case In(("chrom",), values):
                    self.chroms = set(values) if self.chroms is None else self.chroms & set(values)
                case GreaterThan((name,), value) | GreaterThanOrEqual((name,), value) if name in ("st", "en"):
                    # A run from ``value`` on ends behind it; one that ends at ``value`` or later has its last position from value - 1 on.
                    low = value if name == "st" or isinstance(f, GreaterThan) else value - 1
                    self.least_en = low if self.least_en is None else max(self.least_en, low)
                case LessThan((name,), value) | LessThanOrEqual((name,), value) if name in ("st", "en"):
                    high = value + 1 if name == "st" and isinstance(f, LessThanOrEqual) else value
                    self.most_st = high if self.most_st is None else min(self.most_st, high)
            yield f

    def partitions(self) -> list[InputPartition]:
        system, name = _system(f"{self.base}.chroms")
        with system.open_input_stream(name) as file:
            rows = [line.split("\t") for line in file.read().decode().splitlines() if line.strip()]
        made, at = [], 0
        for chrom, st, en in ((r[0], int(r[1]), int(r[2])) for r in rows):
            n = en - st
            for s in range(0, n, self.chunk):
                e = min(s + self.chunk, n)
                known = self.chroms is None or chrom in self.chroms
                if known and (self.least_en is None or e > self.least_en) and (self.most_st is None or s < self.most_st):
                    made.append(Chunk(chrom, s, at + s, e - s))
            at += n
        if (length := sum(n for _, n in _parts(self.base))) != at:
            raise ValueError(f"{self.base}.db has {length} bytes; its chromosomes have {at}")
        return made

    def read(self, partition: Chunk | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # what Spark gives where no chunk is left
            return
        codes, at = [], 0
        for path, size in _parts(self.base):
            lo, hi = max(partition.at, at), min(partition.at + partition.size, at + size)
            if lo < hi:
                system, name = _system(path)
                with system.open_input_file(name) as file:
                    codes.append(file.read_at(hi - lo, lo - at))
            at += size
        codes = np.frombuffer(b"".join(codes), np.uint8)
        start = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
        end, code = np.append(start[1:], len(codes)), codes[start]
        keep = code != 0
        st, en = start[keep] + partition.st, end[keep] + partition.st
        columns = [pa.array([partition.chrom] * len(st), pa.string()), pa.array(st, pa.int64()), pa.array(en, pa.int64()), pa.array(code[keep].astype(np.int16))]
        yield pa.RecordBatch.from_arrays(columns, ["chrom", "st", "en", "idx"])


class ByteFile(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ByteReader:
        return ByteReader(self.options["path"], int(self.options.get("chunk", CHUNK)))


def read_byte_file(spark: SparkSession, base: str, chunk: int = CHUNK) -> DataFrame:
    """The runs of ``base`` as chrom, st, en, idx; filters on the first three choose the chunks."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ByteFile)
    return spark.read.format(NAME).option("chunk", chunk).load(base)


def write_byte_file(pieces: DataFrame, base: str, order: list[str]) -> int:
    """Write ``pieces`` (chrom, number, bytes) as the parts of ``{base}.db`` and its ``.chroms``; the bytes written.

    Chromosomes come in the ``order`` of the list, their pieces by number. A task writes a
    range of the pieces as one part; one that runs again writes the same part.
    """
    from pyspark import TaskContext

    spark = pieces.sparkSession
    ranks = spark.createDataFrame([(c, i) for i, c in enumerate(order)], "chrom string, rank int")
    ranked = pieces.join(F.broadcast(ranks), "chrom")
    dealt = ranked.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "rank", "number").sortWithinPartitions("rank", "number")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = _system(f"{base}.db")
        system.create_dir(folder)
        sizes: dict[str, int] = {}
        with system.open_output_stream(f"{folder}/part-{TaskContext.get().partitionId():07d}") as out:
            for batch in batches:
                for chrom, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    out.write(blob)
                    sizes[chrom] = sizes.get(chrom, 0) + len(blob)
        yield pa.RecordBatch.from_arrays([pa.array(list(sizes), pa.string()), pa.array(list(sizes.values()), pa.int64())], ["chrom", "n"])

    made = dealt.select("chrom", "bytes").mapInArrow(run, "chrom string, n long").groupBy("chrom").agg(F.sum("n").alias("n"))
    sizes = {r.chrom: r.n for r in made.collect()}  # one row a chromosome
    system, name = _system(f"{base}.chroms")
    with system.open_output_stream(name) as out:
        out.write("".join(f"{c}\t0\t{sizes[c]}\n" for c in order if c in sizes).encode())
    return sum(sizes.values())
