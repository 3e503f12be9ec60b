"""Result archives as a data source: folders of compressed tar files, read and written by tasks.

    spark.dataSource.register(ArchiveSource)
    spark.read.format("run_archives").option("parts", 8).load(path)
    results.write.format("run_archives").option("outcomes", '{"y": "ScalarOutcome"}').mode("append").save(folder)

A member of an archive is read as a stream of rows, all members of a row side by side, so a task holds one row at a time,
however large the archive. ``parts`` tasks share an archive: blocks of BLOCK rows go round. An uncompressed array is
skipped by seeking; compressed members are unpacked up to a task's last row, once a member and task.

A writing task cuts its rows into archives of at most ROWS rows and VALUES numbers, whole archives with metadata of their
own, below ``_temporary``; the commit moves those of the tasks that succeeded to the folder, and what failed or repeated
attempts left is deleted. ``overwrite`` then deletes the archives that were there before. Nothing but names passes the
driver. Paths may be those of any file system that Arrow knows.

Nulls are empty cells, or NaN inside arrays of two sides and more; an empty text reads back as null. A null series is a
row without numbers where all rows of its archive are null, else NaN for each step. Arrays of one archive need one shape.
An empty table writes no archive; a folder without one can't be read, as it has no metadata.
"""

from __future__ import annotations

import csv
import io
import json
import math
import tarfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import ArrayType, BooleanType, DataType, DoubleType, LongType, StringType, StructField, StructType

from explorium.exceptions import ExplorationError
from explorium.sources.archives import DTYPES, KINDS

BLOCK, ROWS, VALUES = 1000, 50_000, 1 << 23
TYPES = {"double": DoubleType(), "bigint": LongType(), "boolean": BooleanType(), "string": StringType()}
CASTS = {"double": float, "bigint": lambda v: int(float(v)) if "." in v else int(v), "boolean": lambda v: v == "True", "string": str}
SUFFIXES = (".tar.gz", ".tgz", ".tar")


def located(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else fs.FileSystem.from_uri("file://" + path.removeprefix("file:"))


def archives_at(path: str) -> list[str]:
    """The archive itself, or those of a folder in order of their names."""
    system, at = located(path)
    info = system.get_file_info(at)
    if info.type == fs.FileType.File:
        return [path]
    if info.type != fs.FileType.Directory:
        raise ExplorationError(f"nothing is at {path}")
    names = sorted(f.base_name for f in system.get_file_info(fs.FileSelector(at)) if f.type == fs.FileType.File and f.base_name.endswith(SUFFIXES))
    return [f"{path.rstrip('/')}/{n}" for n in names]


class Archive:
    """One archive. Each member is opened as a stream of its own."""

    def __init__(self, path: str):
        self.path = path

    def __enter__(self):
        self.open = []
        return self

    def __exit__(self, *_):
        for f in reversed(self.open):
            f.close()

    def member(self, *wanted: str) -> tuple[str, io.BufferedIOBase]:
        system, at = located(self.path)
        tar = tarfile.open(fileobj=system.open_input_file(at))
        self.open.append(tar)
        for m in tar:
            if m.isfile() and (name := m.name.removeprefix("./")) in wanted:
                return name, tar.extractfile(m)
        raise ExplorationError(f"{self.path} lacks {' or '.join(wanted)}")

    def metadata(self) -> dict:
        return json.load(self.member("metadata.json")[1])

    def outcome(self, name: str) -> tuple[str, io.BufferedIOBase]:
        return self.member(*(name + s for s in (".cls", ".csv", ".npy")))

    def schema(self, meta: dict) -> StructType:
        fields = [StructField("experiment_id", LongType())]
        fields += [StructField(c, TYPES[KINDS.get(k, "string")]) for c, k in meta["experiments"].items() if c != "experiment_id"]
        for name, kind in meta["outcomes"].items():
            member, content = self.outcome(name)
            sides = len(_npy(content)[0]) - 1 if member.endswith(".npy") else 0 if kind == "ScalarOutcome" else 1
            fields.append(StructField(name, _nested(sides)))
        return StructType(fields)

    def rows(self, schema: StructType, part: int, parts: int) -> Iterator[tuple]:
        meta = self.metadata()
        known = meta["experiments"]
        head = csv.reader(io.TextIOWrapper(self.member("experiments.csv")[1], newline=""))
        places = {c: k for k, c in enumerate(next(head, []))}
        casts = [(places[f.name], CASTS[KINDS.get(known[f.name], "string")]) if f.name in places else None for f in schema.fields if f.name in known or f.name == "experiment_id"]
        outcomes = [_values(*self.outcome(f.name), meta["outcomes"][f.name]) for f in schema.fields if f.name in meta["outcomes"]]
        at = 0
        for row in head:
            if not row:  # an empty line is a row of a single null
                row = [""] * max(len(places), 1)
            mine = (at // BLOCK) % parts == part
            values = [next(v) if mine else v.skip() for v in outcomes]
            if mine:
                own = [at if c is None else c[1](row[c[0]]) if row[c[0]] != "" else None for c in casts]
                yield (*own, *values)
            at += 1


def _nested(sides: int) -> DataType:
    kind: DataType = DoubleType()
    for _ in range(sides):
        kind = ArrayType(kind)
    return kind


def _npy(content) -> tuple[tuple, bool, np.dtype]:
    version = np.lib.format.read_magic(content)
    return (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(content)


def _number(v: str) -> float | None:
    return float(v) if v not in ("", "nan") else None


class _Cells:
    """Rows of a table without quotes: a number each, or a list."""

    def __init__(self, content, scalar: bool, header: bool):
        self.lines, self.scalar = csv.reader(io.TextIOWrapper(content, newline="")), scalar
        if header:
            next(self.lines, None)

    def __next__(self):
        cells = next(self.lines)
        return (_number(cells[0]) if cells else None) if self.scalar else [_number(v) for v in cells]

    def skip(self):
        next(self.lines)


class _Blocks:
    """Rows of an array; what is skipped is passed over by its length."""

    def __init__(self, content):
        self.content, self.ahead = content, 0
        shape, turned, self.kind = _npy(content)
        if turned:
            raise ExplorationError("an array must have its rows one after another")
        self.shape, self.size = shape[1:], math.prod(shape[1:]) * self.kind.itemsize

    def __next__(self):
        if self.ahead:
            self.content.seek(self.ahead, 1)
            self.ahead = 0
        return np.frombuffer(self.content.read(self.size), self.kind).astype(float).reshape(self.shape).tolist()

    def skip(self):
        self.ahead += self.size


def _values(member: str, content, kind: str):
    return _Blocks(content) if member.endswith(".npy") else _Cells(content, kind == "ScalarOutcome", kind == "TimeSeriesOutcome")


@dataclass
class Part(InputPartition):
    path: str
    part: int
    parts: int


class ArchiveReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType, parts: int):
        self.path, self.schema, self.parts = path, schema, parts

    def partitions(self) -> list[Part]:
        return [Part(p, k, self.parts) for p in archives_at(self.path) for k in range(self.parts)]

    def read(self, partition: Part) -> Iterator[tuple]:
        with Archive(partition.path) as archive:
            yield from archive.rows(self.schema, partition.part, partition.parts)


@dataclass
class Written(WriterCommitMessage):
    names: list[str] = field(default_factory=list)


def _shaped(rows: list, sides: int) -> np.ndarray:
    """Rows of one shape as an array; nulls are NaN throughout."""
    shape = next((np.shape(r) for r in rows if r is not None), (0,) * sides)
    out = np.full((len(rows), *shape), np.nan)
    for k, r in enumerate(rows):
        if r is not None:
            one = np.array(r, dtype=float)
            if one.shape != shape:
                raise ExplorationError(f"arrays of {one.shape} and {shape} can't share an archive")
            out[k] = one
    return out


class ArchiveWriter(DataSourceWriter):
    def __init__(self, path: str, schema: StructType, outcomes: dict[str, str], overwrite: bool):
        if missing := set(outcomes) - set(schema.names):
            raise ExplorationError(f"no column is called {sorted(missing)}")
        outcomes = {c: outcomes[c] for c in schema.names if c in outcomes}  # in the order of the columns
        self.path, self.schema, self.outcomes, self.overwrite = path.rstrip("/"), schema, outcomes, overwrite
        self.job = uuid.uuid4().hex

    @property
    def scratch(self) -> str:
        return f"{located(self.path)[1]}/_temporary/{self.job}"

    def write(self, iterator: Iterator) -> Written:
        done, rows, size = Written(), [], 0
        for r in iterator:
            row = tuple(r)
            rows.append(row)
            size += sum(np.size(v) if isinstance(v, list) else 1 for v in row)
            if len(rows) >= ROWS or size >= VALUES:
                done.names.append(self._archive(rows))
                rows, size = [], 0
        if rows:
            done.names.append(self._archive(rows))
        return done

    def _archive(self, rows: list[tuple]) -> str:
        system = located(self.path)[0]
        system.create_dir(self.scratch)
        name = f"part-{uuid.uuid4().hex}.tar.gz"
        columns = dict(zip(self.schema.names, zip(*rows, strict=True), strict=True))
        known = [f for f in self.schema.fields if f.name not in self.outcomes]
        meta = {"version": 0.1, "outcomes": self.outcomes, "experiments": {f.name: DTYPES.get(f.dataType.simpleString(), "object") for f in known}}
        with system.open_output_stream(f"{self.scratch}/{name}", compression=None) as out, tarfile.open(fileobj=out, mode="w|gz") as tar:

            def add(member: str, content: bytes) -> None:
                info = tarfile.TarInfo(member)
                info.size = len(content)
                tar.addfile(info, io.BytesIO(content))

            def table(header: list[str] | None, lines) -> bytes:
                text = io.StringIO()
                to = csv.writer(text, lineterminator="\n")
                if header is not None:
                    to.writerow(header)
                to.writerows(["" if v is None else v for v in line] for line in lines)
                return text.getvalue().encode()

            add("metadata.json", json.dumps(meta).encode())
            add("experiments.csv", table([f.name for f in known], zip(*[columns[f.name] for f in known], strict=True) if known else ([] for _ in rows)))
            for c, kind in self.outcomes.items():
                if kind == "ScalarOutcome":
                    add(f"{c}.cls", table(None, ([v] for v in columns[c])))
                    continue
                sides = 1 if self.schema[c].dataType == ArrayType(DoubleType()) else 2
                values = _shaped(list(columns[c]), sides)
                if values.ndim == 2:
                    lines = ([None if np.isnan(v) else repr(float(v)) for v in r] for r in values)
                    add(f"{c}.csv", table([str(k) for k in range(values.shape[1])] if kind == "TimeSeriesOutcome" else None, lines))
                else:
                    content = io.BytesIO()
                    np.save(content, values)
                    add(f"{c}.npy", content.getvalue())
        return name

    def commit(self, messages: list[Written | None]) -> None:
        system, at = located(self.path)
        system.create_dir(at)
        old = [p for p in archives_at(self.path)] if self.overwrite else []
        for m in messages:
            for name in m.names if m else []:
                system.move(f"{self.scratch}/{name}", f"{at}/{name}")
        for p in old:
            system.delete_file(located(p)[1])
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        system, _ = located(self.path)
        if system.get_file_info(self.scratch).type == fs.FileType.Directory:
            system.delete_dir(self.scratch)


class ArchiveSource(DataSource):
    """Options: path; parts (tasks an archive, 1); outcomes (JSON: columns that are outcomes, with their kinds; by default all arrays)."""

    @classmethod
    def name(cls) -> str:
        return "run_archives"

    def schema(self) -> StructType:
        found = archives_at(self.options["path"])
        if not found:
            raise ExplorationError(f"no archive is at {self.options['path']}")
        with Archive(found[0]) as archive:
            meta = archive.metadata()
            if len(found) > 1 and "experiment_id" not in meta["experiments"]:
                raise ExplorationError("several archives need a column experiment_id of their own")
            return archive.schema(meta)

    def reader(self, schema: StructType) -> ArchiveReader:
        parts = int(self.options.get("parts", 1))
        if parts < 1:
            raise ValueError("a part at least")
        return ArchiveReader(self.options["path"], schema, parts)

    def writer(self, schema: StructType, overwrite: bool) -> ArchiveWriter:
        arrays = {f.name: "TimeSeriesOutcome" if f.dataType.simpleString() == "array<double>" else "ArrayOutcome" for f in schema.fields if isinstance(f.dataType, ArrayType)}
        return ArchiveWriter(self.options["path"], schema, arrays | json.loads(self.options.get("outcomes", "{}")), overwrite)
