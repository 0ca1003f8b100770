"""Files that are named by what they hold: staged turns and sessions, and the tree of a merge in conflict."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell import schema
from tracewell.functions.text import is_full_sha, is_session_id


def write_files(files: DataFrame, path: str) -> int:
    """Writes files (name, body) below path, a URI of a file system that all machines reach; how many there were.

    Each is written under a name of its own and then moved, so a reader sees the old file or the new one whole, and a task
    that runs again does no harm.  Of several rows of a name one is written, so callers put them in one row before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs = None
        for batch in batches:
            for name, body in zip(batch.column("name").to_pylist(), batch.column("body").to_pylist(), strict=True):
                if fs is None:
                    fs, root = pyarrow.fs.FileSystem.from_uri(path)
                to = f"{root}/{name}"
                fs.create_dir(to.rpartition("/")[0], recursive=True)
                with fs.open_output_stream(part := f"{to}.{uuid.uuid4().hex}.part", compression=None) as out:
                    out.write((body or "").encode("utf-8", "surrogatepass"))
                fs.move(part, to)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    rows = files.select(F.col("name").cast("string").alias("name"), F.col("body").cast("string").alias("body"))
    return rows.mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def _by_name(name, record: list[str], newest: list[str], rows: DataFrame) -> DataFrame:
    """(name, body) with each name's newest record as JSON."""
    body = F.to_json(F.struct(*record))
    return rows.groupBy(name.alias("name")).agg(F.max_by(body, F.struct(*newest, body)).alias("body"))


def write_turns(turns: DataFrame, path: str) -> int:
    """A file `turn-<N>.json` for each session, visibility and turn, private ones in a folder of their own; one that is there
    is replaced.  turns has the fields of schema.TURN_RECORD; invalid sessions are left out, of several records of a turn
    the one completed or else started last is written."""
    name = F.concat(F.when(F.col("private"), "private/").otherwise(""), "session_id", F.lit("/turn-"), "turn_index", F.lit(".json"))
    ok = turns.where(is_session_id("session_id") & F.col("turn_index").isNotNull())
    return write_files(_by_name(name, schema.TURN_RECORD.fieldNames(), ["completed_at", "started_at"], ok), path)


def write_session_meta(sessions: DataFrame, path: str) -> int:
    """A file `session.json` for each session (schema.SESSION_META): of several records the one started last."""
    ok = sessions.where(is_session_id("session_id"))
    return write_files(_by_name(F.concat("session_id", F.lit("/session.json")), schema.SESSION_META.fieldNames(), ["started_at"], ok), path)


def read_conflicted_tree(spark: SparkSession, path: str) -> DataFrame:
    """(commit_sha, body) of the files of a conflicted merge of notes: a file's path below `path`, without its slashes, is its
    commit; other files are left out.  Files are listed and read in parallel."""
    root = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:/*", "/", path).rstrip("/")
    files = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("p"))
    commit = F.replace(F.substring_index("p", f"{root}/", -1), F.lit("/"), F.lit(""))
    return files.select(commit.alias("commit_sha"), F.col("value").alias("body")).where(is_full_sha("commit_sha"))
