"""Tar shards as a Spark data source: one partition per shard, one row per key.

    spark.dataSource.register(TarSource)
    spark.read.format("voxloom_tar").option("shards", json.dumps([...])).load()

Options: ``shards`` (JSON list of paths, or of {url, path}), ``source``, ``include_audio`` (false reads sizes only).
Members of a key must lie together; a key that comes back later starts a new row, which ``broken_runs`` reports.  Of a suffix
that occurs twice within a key the first member counts and ``duplicates`` names it.  Where a shard breaks off, the key
that was being read gives a row with the members read so far and the error, so no half-read sample passes for a sound
one; the rest of the job goes on.  Paths may be local or urls of any file system pyarrow knows, and http(s) urls.
"""

from __future__ import annotations

import io
import json
import os
import re
import tarfile
from collections.abc import Iterator
from typing import IO

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Fixed value: a member path is a key up to the first dot of its file name, then the suffix.
MEMBER = re.compile(r"^((?:.*/|)[^.]+)[.]([^/]*)$")
SCHEMA = (
    "source string, url string, key string, place bigint, members map<string,binary>, sizes map<string,bigint>, duplicates array<string>, error string"
)


#: Most rows and bytes of members in one Arrow batch (a single larger sample is a batch of its own).
BATCH_ROWS, BATCH_BYTES = 256, 64 << 20
_ARROW = pa.schema(
    [
        ("source", pa.string()), ("url", pa.string()), ("key", pa.string()), ("place", pa.int64()), ("members", pa.map_(pa.string(), pa.binary())),
        ("sizes", pa.map_(pa.string(), pa.int64())), ("duplicates", pa.list_(pa.string())), ("error", pa.string()),
    ]
)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = [list(c) for c in zip(*rows)]
    columns[4:6] = [[list(m.items()) for m in columns[i]] for i in (4, 5)]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW)], schema=_ARROW)


class ShardPartition(InputPartition):
    def __init__(self, url: str, path: str):
        super().__init__((url, path))
        self.url, self.path = url, path


def open_shard(path: str) -> IO[bytes]:
    """A readable stream of a local path or url."""
    if path.startswith(("http://", "https://")):
        from urllib.request import urlopen

        return urlopen(path)  # noqa: S310
    system, place = file_system(path)
    return system.open_input_stream(place)


def file_system(path: str):
    """(file system, path in it) of a local path or url."""
    from pyarrow.fs import FileSystem

    if path.startswith("file:/") and not path.startswith("file://"):
        path = path.replace("file:/", "file:///", 1)
    return FileSystem.from_uri(path if "://" in path else os.path.abspath(path))


def physical_samples(source: str | None, url: str, path: str, include_audio: bool = True) -> Iterator[tuple]:
    """Rows of one shard in order."""
    key, members, sizes, twice, place = None, {}, {}, [], 0
    broken: str | None = None
    try:
        with open_shard(path) as stream, tarfile.open(fileobj=stream, mode="r|*") as shard:
            for entry in shard:
                match = MEMBER.match(entry.name) if entry.isfile() else None
                if not match:
                    continue
                if match[1] != key:
                    if key is not None:
                        yield (source, url, key, place, members, sizes, twice, None)
                        place += 1
                    key, members, sizes, twice = match[1], {}, {}, []
                if match[2] in sizes:
                    twice.append(match[2])
                    continue
                if include_audio or match[2].endswith("json"):
                    members[match[2]] = shard.extractfile(entry).read()
                sizes[match[2]] = entry.size
    except (tarfile.TarError, OSError, EOFError, pa.ArrowException) as error:
        broken = f"{type(error).__name__}: {error}"[:4096]
    if key is not None or broken:
        yield (source, url, key, place, members, sizes, twice, broken)


class TarReader(DataSourceReader):
    def __init__(self, options: dict):
        self.source = options.get("source")
        self.include_audio = str(options.get("include_audio", "true")).lower() != "false"
        self.shards = [(s, s) if isinstance(s, str) else (s["url"], s.get("path") or s["url"]) for s in json.loads(options["shards"])]

    def partitions(self) -> list[ShardPartition]:
        return [ShardPartition(*s) for s in self.shards]

    def read(self, partition: ShardPartition) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for row in physical_samples(self.source, partition.url, partition.path, self.include_audio):
            rows.append(row)
            held += sum(map(len, row[4].values()))
            if len(rows) >= BATCH_ROWS or held >= BATCH_BYTES:
                yield _batch(rows)
                rows, held = [], 0
        if rows:
            yield _batch(rows)


class TarSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "voxloom_tar"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TarReader:
        return TarReader(self.options)


def read_shards(spark, shards: list, source: str | None = None, include_audio: bool = True):
    """DataFrame of the physical samples of tar shards."""
    spark.dataSource.register(TarSource)
    reader = spark.read.format("voxloom_tar").option("shards", json.dumps(shards)).option("include_audio", str(include_audio).lower())
    return (reader.option("source", source) if source else reader).load()


def read_members(spark, shards: list):
    """``(shard, place, name, size, text)``: every regular member of tar shards in order; text of json members only.

    A shard that breaks off ends with a row whose name is null and whose text is the error.
    """
    listed = [(s, s) if isinstance(s, str) else (s["url"], s.get("path") or s["url"]) for s in shards]
    rows = spark.createDataFrame(listed, "url string, path string")

    def run(batches):
        for batch in batches:
            for url, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held = []
                try:
                    with open_shard(path) as stream, tarfile.open(fileobj=stream, mode="r|*") as shard:
                        for entry in shard:
                            if entry.isfile():
                                text = shard.extractfile(entry).read().decode("utf-8", "replace") if entry.name.endswith("json") else None
                                held.append((url, len(held), entry.name, entry.size, text))
                except (tarfile.TarError, OSError, EOFError, pa.ArrowException) as error:
                    held.append((url, len(held), None, None, f"{type(error).__name__}: {error}"[:4096]))
                columns = list(zip(*held)) or [[]] * 5
                types = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["shard", "place", "name", "size", "text"])

    return rows.repartition(max(1, len(listed))).mapInArrow(run, "shard string, place bigint, name string, size bigint, text string")


def write_shards(members, folder: str) -> list[dict[str, str]]:
    """Tar shards of ``members (shard, name, data)`` in a shared folder, members in the order of their names.

    Each shard is written by one task as a stream.  Returns ``[{url, path}]``, one entry per shard.
    """
    from pyspark.sql import functions as F

    def run(batches):
        open_name, out, made = None, None, []

        def close():
            if out:
                out[0].close()
                out[1].close()

        for batch in batches:
            for shard, name, data in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if shard != open_name:
                    close()
                    path = f"{folder}/{shard.replace('/', '_')}"
                    stream = open_sink(path)
                    open_name, out = shard, (tarfile.open(fileobj=stream, mode="w|"), stream)
                    made.append((shard, path))
                info = tarfile.TarInfo(name)
                info.size = len(data or b"")
                out[0].addfile(info, io.BytesIO(data or b""))
        close()
        yield pa.RecordBatch.from_arrays([pa.array([m[i] for m in made], pa.string()) for i in (0, 1)], names=["url", "path"])

    placed = members.select("shard", "name", F.col("data").cast("binary")).where("shard is not null and name is not null")
    placed = placed.repartition("shard").sortWithinPartitions("shard", "name").mapInArrow(run, "url string, path string")
    return [r.asDict() for r in placed.collect()]


def open_sink(path: str):
    """A stream that replaces the file at a local path or url."""
    system, place = file_system(path)
    system.create_dir(place.rpartition("/")[0], recursive=True)
    return system.open_output_stream(place)
