"""Refilling a queue when its workers find nothing to do, one refill at a time."""

from __future__ import annotations

import os
import threading
import time
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.listener import StreamingQueryListener

from newsgrain.streaming.ingest_stream import enqueue

#: Rows that a refill puts into the queue, and seconds after which a lease counts as left behind by a lost driver.
REFILL, LEASE_SECONDS = 50_000, 3600


class Lease:
    """A file that only one holder can create, in a folder that all drivers share."""

    def __init__(self, spark: SparkSession, path: str, seconds: float = LEASE_SECONDS):
        self.spark, self.seconds = spark, seconds
        self.path = spark._jvm.org.apache.hadoop.fs.Path(path)
        self.fs = self.path.getFileSystem(spark._jsc.hadoopConfiguration())

    def take(self) -> bool:
        """Whether it is now ours.  One that is too old is moved away first, which only one of several can do."""
        if self.fs.exists(self.path):
            try:
                age = time.time() - self.fs.getFileStatus(self.path).getModificationTime() / 1000
            except Py4JJavaError as gone:  # given back meanwhile
                if "FileNotFound" not in str(gone):
                    raise
                age = 0.0
            if age < self.seconds:
                return False
            old = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path.toString()}-{uuid.uuid4().hex}")
            if not self.fs.rename(self.path, old):
                return False
            self.fs.delete(old, False)
        return self._create()

    def _create(self) -> bool:
        """Create the file unless it is there: one step of the store, and of a mounted folder's file system."""
        uri = self.fs.makeQualified(self.path).toUri()
        try:
            if uri.getScheme() == "file":
                self.fs.mkdirs(self.path.getParent())
                os.close(os.open(uri.getPath(), os.O_CREAT | os.O_EXCL | os.O_WRONLY))
            else:
                self.fs.create(self.path, False).close()
        except FileExistsError:
            return False
        except Py4JJavaError as taken:
            if "AlreadyExists" not in str(taken):
                raise
            return False
        return True

    def give_back(self) -> None:
        self.fs.delete(self.path, False)


def refill(candidates: DataFrame, queue: str, most: int = REFILL, per_message: int = 40) -> None:
    """Put the first ``most`` of the candidates, in their own order, into the queue."""
    enqueue(candidates.limit(most), queue, per_message)


class RefillWhenEmpty(StreamingQueryListener):
    """Calls ``fill`` when a worker has had nothing to do and ``empty`` confirms it, under a lease.

    ``empty`` is asked again once the lease is held, so a worker that noticed late
    does not refill a queue that another has just filled.  It runs beside the
    listener, and ``filled`` counts the refills of this driver.
    """

    def __init__(self, lease: Lease, empty: Callable[[], bool], fill: Callable[[], None]):
        self.lease, self.empty, self.fill = lease, empty, fill
        self.filled, self.failure = 0, None
        self._busy = threading.Lock()

    def check(self) -> bool:
        """One look at the queue; whether it was filled."""
        if not self.empty() or not self.lease.take():
            return False
        try:
            if not self.empty():
                return False
            self.fill()
            self.filled += 1
            return True
        finally:
            self.lease.give_back()

    def _look(self) -> None:
        try:
            self.check()
        except Exception as failure:  # the workers go on; whoever waits for the refill sees why there was none
            self.failure = failure
        finally:
            self._busy.release()

    def _idle(self) -> None:
        if self._busy.acquire(blocking=False):
            threading.Thread(target=self._look, daemon=True).start()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        if event.progress.numInputRows == 0:
            self._idle()

    def onQueryIdle(self, event) -> None:
        self._idle()

    def onQueryTerminated(self, event) -> None:
        pass
