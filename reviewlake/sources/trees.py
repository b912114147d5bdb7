"""Files of a folder that the machines share, listed and read by tasks."""

from __future__ import annotations

import os
import stat
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlake.session import materialize

ENTRIES = 20_000  # that a task of the first round lists before it hands folders on; four times as many in each later round
FILES, BYTES = 5_000, 64 << 20  # of a task that reads
BATCH = 4 << 20


def local_folder(spark: SparkSession, path: str) -> tuple[str, str] | None:
    """The name of a folder as Spark's readers give it, and its path on the machines; None if it is no plain ``file:`` folder."""
    if any(c in path for c in "{}[]*?\\"):
        return None
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    place = system.makeQualified(place)
    if place.toUri().getScheme() != "file" or not system.exists(place) or not system.getFileStatus(place).isDirectory():
        return None
    return place.toString(), place.toUri().getPath()


def _passed_over(name: bytes, folder: bool) -> bool:
    """Names that Spark's readers pass over."""
    hidden = (name.startswith(b"_") and b"=" not in name) or name.startswith(b".") or name.endswith(b"._COPYING_")
    return hidden and not (folder and name.startswith((b"_common_metadata", b"_metadata")))


def _listed(spark: SparkSession, path: str) -> DataFrame:
    """``raw, size``: the files below a folder, ``raw`` being the path from there on.

    A task goes on into the folders that it finds until it has listed its number of entries. The folders left are dealt anew.
    """
    root = os.fsencode(path)
    schema = pa.schema([("raw", pa.binary()), ("size", pa.int64())])  # no size: a folder

    def rounds(most: int):
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            todo = deque(raw for batch in batches for raw in batch.column(0).to_pylist())
            done, rows = 0, []
            while todo and done < most:
                folder = todo.popleft()
                with os.scandir(os.path.join(root, folder)) as entries:
                    for entry in entries:
                        done += 1
                        below = entry.is_dir()
                        if _passed_over(entry.name, below):
                            continue
                        raw = os.path.join(folder, entry.name)
                        if below:
                            todo.append(raw)
                            continue
                        try:
                            about = entry.stat()
                        except FileNotFoundError:  # a link to nothing
                            continue
                        if stat.S_ISREG(about.st_mode) and about.st_size:  # Spark's readers pass over empty files
                            rows.append((raw, about.st_size))
                        if len(rows) == 10_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                            rows = []
            rows += [(raw, None) for raw in todo]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        return work

    folders, files, most = spark.range(1).select(F.lit(b"").alias("raw")), None, ENTRIES
    while True:
        found = materialize(folders.mapInArrow(rounds(most), "raw binary, size long"), "tree-files")
        here = found.where("size is not null")
        files = here if files is None else files.union(here)
        left = found.where("size is null").count()
        if not left:
            return files
        folders = found.where("size is null").select("raw").repartition(min(left, 4 * spark.sparkContext.defaultParallelism))
        most *= 4


def read_files(spark: SparkSession, name: str, path: str, pattern: str) -> DataFrame:
    """``path, content`` of the files below a folder whose name fits ``pattern``; the driver holds nothing for each of them."""
    fits = spark._jvm.org.apache.hadoop.fs.GlobPattern.compile(pattern).pattern()
    own = F.regexp_extract(F.decode(F.col("raw"), "ISO-8859-1"), "[^/]*$", 0)
    own = F.decode(F.encode(own, "ISO-8859-1"), "UTF-8")
    files = _listed(spark, path).where(own.rlike(f"^(?s:{fits})$"))
    size = files.agg(F.count("*").alias("n"), F.sum("size").alias("b")).first()
    parts = max(-(-size["n"] // FILES), -(-(size["b"] or 0) // BYTES), min(size["n"], spark.sparkContext.defaultParallelism), 1)
    root = os.fsencode(path)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, contents, held = [], [], 0
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                with open(os.path.join(root, raw), "rb") as file:
                    content = file.read()
                if held + len(content) > BATCH and names:
                    yield pa.RecordBatch.from_pydict({"path": names, "content": contents}, schema=schema)
                    names, contents, held = [], [], 0
                names.append(f"{name.rstrip('/')}/{raw.decode('utf-8', 'replace')}")
                contents.append(content)
                held += len(content)
        if names:
            yield pa.RecordBatch.from_pydict({"path": names, "content": contents}, schema=schema)

    schema = pa.schema([("path", pa.string()), ("content", pa.binary())])
    return files.select("raw").repartition(parts).mapInArrow(read, "path string, content binary")
