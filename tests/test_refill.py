"""Workers with nothing to do cause one refill, whoever notices first."""

import threading
import time

from newsgrain.streaming import ingest_stream as S
from newsgrain.streaming.refill import Lease, RefillWhenEmpty, refill

SCHEMA = "id bigint, url string"


def test_one_lease_at_a_time(spark, tmp_path):
    path = str(tmp_path / "lease")
    held = []
    threads = [threading.Thread(target=lambda: held.append(Lease(spark, path).take())) for _ in range(8)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(held) == [False] * 7 + [True]
    assert not Lease(spark, path).take()
    Lease(spark, path).give_back()
    assert Lease(spark, path).take()
    time.sleep(1.1)
    taken = [Lease(spark, path, seconds=1).take() for _ in range(3)]  # left behind
    assert taken == [True, False, False]


def test_two_workers_one_refill(spark, tmp_path):
    queue, sinks = str(tmp_path / "queue"), [str(tmp_path / f"sink{i}") for i in (0, 1)]
    candidates = spark.range(500).selectExpr("id", "concat('http://x/', id) AS url").orderBy("id")
    S.enqueue(candidates.limit(3), queue)
    done = threading.Event()

    def files():
        return sum(1 for f in (tmp_path / "queue").iterdir() if f.name.endswith(".json"))

    start = files()
    fills = []

    def fill():
        fills.append(1)
        refill(candidates, queue, most=120)
        done.set()

    listeners = [RefillWhenEmpty(Lease(spark, str(tmp_path / "lease")), lambda: files() == start, fill) for _ in (0, 1)]
    workers = []
    for i, listener in enumerate(listeners):
        spark.streams.addListener(listener)
        stream = S.messages(spark, queue, SCHEMA)
        workers.append(stream.writeStream.format("parquet").option("path", sinks[i]).option("checkpointLocation", str(tmp_path / f"marks{i}")).trigger(processingTime="200 milliseconds").start())
    try:
        assert done.wait(60), [x.failure for x in listeners]
        end = time.time() + 30
        while time.time() < end and any(spark.read.schema(SCHEMA).parquet(s).count() < 123 for s in sinks):
            time.sleep(0.5)
        assert [spark.read.parquet(s).count() for s in sinks] == [123, 123]  # each worker reads all
        assert sum(x.filled for x in listeners) == 1 == len(fills) and [x.failure for x in listeners] == [None, None]
    finally:
        for w in workers:
            w.stop()
        for x in listeners:
            spark.streams.removeListener(x)
    assert not listeners[0].check()  # the queue is not empty


def test_a_failed_refill_gives_the_lease_back(spark, tmp_path):
    listener = RefillWhenEmpty(Lease(spark, str(tmp_path / "lease")), lambda: True, lambda: 1 / 0)
    for _ in range(2):
        try:
            listener.check()
            raise AssertionError("it must fail")
        except ZeroDivisionError:
            pass
    assert Lease(spark, str(tmp_path / "lease")).take()
