"""Trees of files as a Spark data source with a commit: tasks write files of their own, and a manifest makes them visible at once."""

from __future__ import annotations

import hashlib
import json
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

MANIFEST, LISTING = "MANIFEST.json", "tree-listing.jsonl"


@dataclass
class _Written(WriterCommitMessage):
    folder: str
    files: int
    bytes: int


def _store(root: str) -> tuple[fs.FileSystem, str]:
    """The store of a folder by its address (file, hdfs, s3, gs), and the folder's path in it."""
    return fs.FileSystem.from_uri(root if "://" in root or root.startswith("file:") else f"file://{root}")


def _relative(path: str) -> str:
    """A path below the tree, or an error: nothing is written outside of it, nothing over what the tree keeps for itself, and nothing
    under a name with `_` or `.` in front, which Spark does not read."""
    parts = path.split("/")
    if any(not p or p[0] in "._" for p in parts) or "\\" in path or parts[-1] == LISTING:
        raise ValueError(f"INVALID_PATH {path!r}")
    return path


class TreeSink(DataSource):
    """Writes rows (path, content) as files. Option root: the tree's folder, on a store that all executors reach."""

    @classmethod
    def name(cls) -> str:
        return "filetree"

    def schema(self) -> str:
        return "path string, content binary"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _TreeWriter(self.options["root"], uuid.uuid4().hex)


class _TreeWriter(DataSourceArrowWriter):
    """Each attempt of a task has a folder of its own, with its files and a listing of them. The commit names the folders of the
    attempts that count in one manifest, which takes the place of the one before by a rename: a reader sees the whole
    tree before or after, and what lost or failed attempts have written is in no manifest."""

    def __init__(self, root: str, job: str):
        self.root, self.job = root.rstrip("/"), job

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        context = TaskContext.get()
        folder = f"data-{self.job}/{context.partitionId()}-{context.taskAttemptId()}"
        store, top = _store(self.root)
        made, lines, total = set(), [], 0
        store.create_dir(f"{top}/{folder}")
        for batch in iterator:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                at = f"{top}/{folder}/{_relative(path)}"
                if (up := posixpath.dirname(at)) not in made:
                    store.create_dir(up)
                    made.add(up)
                data = content or b""
                with store.open_output_stream(at) as out:
                    out.write(data)
                lines.append(json.dumps({"path": path, "bytes": len(data), "sha256": hashlib.sha256(data).hexdigest()}))
                total += len(data)
        with store.open_output_stream(f"{top}/{folder}/{LISTING}") as out:
            out.write("".join(f"{x}\n" for x in lines).encode())
        return _Written(folder, len(lines), total)

    def commit(self, messages: list[_Written | None]) -> None:
        done = [m for m in messages if m]
        store, top = _store(self.root)
        body = {"job": self.job, "folders": sorted(m.folder for m in done), "files": sum(m.files for m in done), "bytes": sum(m.bytes for m in done)}
        with store.open_output_stream(f"{top}/.{self.job}.json") as out:
            out.write(json.dumps(body).encode())
        store.move(f"{top}/.{self.job}.json", f"{top}/{MANIFEST}")

    def abort(self, messages: list[_Written | None]) -> None:
        store, top = _store(self.root)
        if store.get_file_info(f"{top}/data-{self.job}").type == fs.FileType.Directory:
            store.delete_dir(f"{top}/data-{self.job}")


def write_tree(files: DataFrame, root: str) -> None:
    """Writes files (path, content) as the tree's next version. Paths are held against each other before anything is written."""
    twice = files.groupBy("path").agg(F.count("*").alias("n")).where("n > 1").limit(1)
    if not twice.isEmpty():
        raise ValueError(f"DUPLICATE_PATH {twice.first()['path']!r}")
    files.sparkSession.dataSource.register(TreeSink)
    files.select("path", F.col("content").cast("binary").alias("content")).write.format("filetree").mode("append").option("root", root).save()


def _manifest(root: str) -> dict:
    store, top = _store(root.rstrip("/"))
    with store.open_input_stream(f"{top}/{MANIFEST}") as held:
        return json.loads(held.read())


def listing(spark: SparkSession, root: str) -> DataFrame:
    """(path, bytes, sha256) as the tree's last version lists them; one name for each task is read on the driver."""
    folders = [f"{root.rstrip('/')}/{f}/{LISTING}" for f in _manifest(root)["folders"]]
    return spark.read.schema("path string, bytes long, sha256 string").json(folders) if folders else spark.createDataFrame([], "path string, bytes long, sha256 string")


def read_tree(spark: SparkSession, root: str) -> DataFrame:
    """(path, content) of the files of the tree's last version, whatever else lies in its folder. Empty files, which Spark does not
    open, come from the listing."""
    folders = [f"{root.rstrip('/')}/{f}" for f in _manifest(root)["folders"]]
    if not folders:
        return spark.createDataFrame([], "path string, content binary")
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folders).where(~F.endswith("path", F.lit(f"/{LISTING}")))
    held = found.where("length > 0").select(F.regexp_extract("path", r"/data-[0-9a-f]{32}/\d+-\d+/(.*)$", 1).alias("path"), "content")
    return held.union(listing(spark, root).where("bytes = 0").select("path", F.lit(b"")))


def tree_faults(spark: SparkSession, root: str) -> DataFrame:
    """(path, fault) of files that are not as listed: MISSING, UNLISTED or CHANGED."""
    there = read_tree(spark, root).select("path", F.sha2("content", 256).alias("_is"))
    both = listing(spark, root).select("path", F.col("sha256").alias("_said")).join(there, "path", "full_outer")
    fault = F.when(F.col("_is").isNull(), "MISSING").when(F.col("_said").isNull(), "UNLISTED").when(F.col("_said") != F.col("_is"), "CHANGED")
    return both.select("path", fault.alias("fault")).where("fault is not null")
