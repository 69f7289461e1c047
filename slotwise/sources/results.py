"""Stored results: parquet under a fingerprint of the query text."""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

# Markers, file endings and calls that switch storing off.
BYPASS_MARKERS = ("@nocache", "-- nocache")
BYPASS_ENDINGS = (".live.sql", ".nocache.sql")
MOVING_TIME_CALLS = ("now", "currentDate", "today", "currentTimestamp")

POINTER = "CURRENT"

_MOVING_TIME = re.compile(rf"({'|'.join(MOVING_TIME_CALLS)})\s*\(", re.IGNORECASE)


def fingerprint(text: str) -> str:
    """16 hex characters over the text with its whitespace collapsed."""
    flat = " ".join(text.split())
    return hashlib.sha256(flat.encode("utf-8")).hexdigest()[:16]


class ResultStore:
    """Materialised results in one folder of the cluster's shared storage.

    Rows never pass through the driver: a miss writes parquet from the tasks, a
    hit is a scan.  Unlike a row cache it keeps types, and empty results keep
    their schema.
    """

    def __init__(self, spark: SparkSession, root: str, enabled: bool = True):
        self.spark = spark
        self.root = root.rstrip("/")
        self.enabled = enabled
        self.views: dict[str, str] = {}  # view: the name it was made for

    def bypasses(self, text: str, file_name: str = "") -> bool:
        return (
            not self.enabled
            or any(marker in text for marker in BYPASS_MARKERS)
            or file_name.endswith(BYPASS_ENDINGS)
            or _MOVING_TIME.search(text) is not None
        )

    def path(self, text: str) -> str:
        return f"{self.root}/{fingerprint(text)}"

    def stored(self, text: str) -> bool:
        return self.published(text) is not None

    def published(self, text: str) -> str | None:
        """The folder of the published version; what no pointer names is not there for readers."""
        files, pointer = self._file(f"{self.path(text)}/{POINTER}")
        if not files.exists(pointer):
            return None
        return f"{self.path(text)}/{self.spark.read.text(pointer.toString()).first()[0]}"

    def publish(self, text: str, df: DataFrame) -> str:
        """Write ``df`` as a version of its own and point readers at it.

        The pointer is written beside and renamed once the version has committed.  A job
        that dies before leaves what readers see as it was; of two jobs each leaves one
        whole version, and the pointer names one of them.
        """
        version = f"version-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path(text)}/{version}")
        files, pointer = self._file(f"{self.path(text)}/{POINTER}")
        _, draft = self._file(f"{self.path(text)}/.{version}")
        out = files.create(draft, False)
        out.write(bytearray(version.encode()))
        out.close()
        # A rename that replaces is one step on the file systems of a cluster.
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(pointer.toUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark._jvm.org.apache.hadoop.fs.Options.Rename
        replace = self.spark.sparkContext._gateway.new_array(options, 1)
        replace[0] = options.OVERWRITE
        context.rename(context.makeQualified(draft), context.makeQualified(pointer), replace)
        return f"{self.path(text)}/{version}"

    def _file(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        files = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return files, files.makeQualified(path)

    def materialize(
        self,
        text: str,
        build: Callable[[], DataFrame] | None = None,
        file_name: str = "",
    ) -> DataFrame:
        """The result for ``text``: stored when present, else built and stored.

        ``build`` makes the DataFrame; without it the text runs as Spark SQL.
        """
        make = build or (lambda: self.spark.sql(text))
        if self.bypasses(text, file_name):
            return make()
        return self.spark.read.parquet(self.published(text) or self.publish(text, make()))

    def result_view(self, name: str, text: str, build: Callable[[], DataFrame] | None = None) -> DataFrame:
        """Register the result under ``<source>_<name>`` and return it.

        Two names that would share a view, such as ``a.b_c`` and ``a_b.c``, are refused.
        """
        view = name.replace(".", "_")
        if self.views.setdefault(view, name) != name:
            raise ValueError(f"{name!r} would take the view {view} of {self.views[view]!r}")
        df = self.materialize(text, build)
        df.createOrReplaceTempView(view)
        return self.spark.table(view)


def shared_root(spark: SparkSession) -> str:
    """Folder every executor sees: the one named in ``spark.checkpoint.dir``."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return named.rstrip("/")
