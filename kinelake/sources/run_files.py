"""Run documents as files of their own: a data source that writes <n>/<run>/obj_<n>.json.

Each task writes under temporary names. When all tasks are done, their files get their names and the
manifest a file that lists them, so it names committed files alone; if one fails, the temporary files go.
Paths are read through pyarrow's file systems: file, hdfs, s3 and gs addresses, or a shared folder.
"""

from __future__ import annotations

import json
import posixpath
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

MANIFEST = "_manifest"
#: What the manifest says of a run; all paths are relative to the folder.
SCHEMA = "run_id string, num_objects long, annotations string, video string, segmentation string"


def stem(num_objects, run_id) -> str:
    """Folder of a run. Text that paths would take apart is written as %XX."""
    from urllib.parse import quote

    return f"{num_objects}/{quote(str(run_id), safe='')}/"


def entry(num_objects, run_id) -> dict:
    at = stem(num_objects, run_id)
    return {
        "run_id": str(run_id), "num_objects": num_objects, "annotations": f"{at}obj_{num_objects}.json", "video": f"{at}simulation_{num_objects}_objects.mp4",
        "segmentation": f"{at}simulation_{num_objects}_objects_segmentation.mp4",
    }


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class Written(WriterCommitMessage):
    """Files of a task: (temporary name, entry of the manifest)."""

    files: list[tuple[str, dict]]


class Writer(DataSourceWriter):
    """Rows (run_id, num_objects, json): a file each."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path, overwrite, uuid.uuid4().hex

    def write(self, iterator) -> Written:
        store, root = _store(self.path)
        files = []
        try:
            for row in iterator:
                if row["run_id"] is None or row["num_objects"] is None or row["json"] is None:
                    raise ValueError("run_id, num_objects and json must not be NULL")
                name = f"_tmp-{self.job}/{uuid.uuid4().hex}.json"
                files.append((name, entry(row["num_objects"], row["run_id"])))
                store.create_dir(posixpath.join(root, f"_tmp-{self.job}"), recursive=True)
                with store.open_output_stream(posixpath.join(root, name)) as out:
                    out.write(row["json"].encode())
        except BaseException:
            self._drop(files)
            raise
        return Written(files)

    def commit(self, messages) -> None:
        store, root = _store(self.path)
        at = lambda name: posixpath.join(root, name)
        files = [f for m in messages if m is not None for f in m.files]
        names = [e["annotations"] for _, e in files]
        if len(set(names)) < len(names):
            self.abort(messages)
            raise ValueError("a run is given twice")

        def place(file):
            name, e = file
            store.create_dir(at(posixpath.dirname(e["annotations"])), recursive=True)
            store.move(at(name), at(e["annotations"]))

        with ThreadPoolExecutor(16) as pool:
            list(pool.map(place, files))
        store.create_dir(at(MANIFEST), recursive=True)
        if self.overwrite:
            store.delete_dir_contents(at(MANIFEST))
        with store.open_output_stream(at(f"{MANIFEST}/{self.job}.json")) as out:
            for _, e in files:
                out.write(json.dumps(e).encode() + b"\n")
        self._clear()

    def abort(self, messages) -> None:
        self._drop([f for m in messages if m is not None for f in m.files])
        self._clear()

    def _drop(self, files) -> None:
        store, root = _store(self.path)
        for name, _ in files:
            try:
                store.delete_file(posixpath.join(root, name))
            except OSError:  # it was not written yet
                pass

    def _clear(self) -> None:
        store, root = _store(self.path)
        try:
            store.delete_dir(posixpath.join(root, f"_tmp-{self.job}"))
        except OSError:  # no task wrote anything
            pass


class RunFiles(DataSource):
    """`df.write.format("run_files").mode("append").save(path)`; mode "overwrite" begins the manifest anew."""

    @classmethod
    def name(cls) -> str:
        return "run_files"

    def schema(self) -> str:
        return "run_id string, num_objects long, json string"

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options["path"], overwrite)


def write(docs: DataFrame, path: str, overwrite: bool = False) -> DataFrame:
    """Write documents (run_id, num_objects, json) as one JSON file a run, and give the manifest (an action).

    Files of other runs stay; the file of a run that was there is replaced, its manifest entry is the same.
    overwrite: the manifest lists this write's runs alone.
    """
    spark = docs.sparkSession
    spark.dataSource.register(RunFiles)
    rows = docs.selectExpr("CAST(run_id AS STRING) AS run_id", "CAST(num_objects AS LONG) AS num_objects", "json")
    rows.write.format("run_files").mode("overwrite" if overwrite else "append").save(path)
    return manifest(spark, path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(run_id, num_objects, annotations, video, segmentation) of the committed runs under path, each once."""
    return spark.read.schema(SCHEMA).json(f"{path}/{MANIFEST}").distinct()
