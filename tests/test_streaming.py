"""Running maxima of load paths over a stream: restarts, late and unordered steps, ties, nulls, and paths that end."""

from datetime import datetime, timedelta

import pytest

from voxelgrain.streaming import RESULTS, path_maxima, read_steps, use_state_store

T0 = datetime(2024, 1, 1)


def step(case, n, value, minutes, micro="m"):
    return (micro, case, n, "strain", 0, None if value is None else [float(value), 0.0], T0 + timedelta(minutes=minutes))


class Stream:
    """A folder of steps, and queries over it that stop and go on from one checkpoint."""

    def __init__(self, spark, folder):
        self.spark, self.folder, self.out, self.n = spark, folder, {}, 0
        (folder / "in").mkdir()

    def add(self, *rows):
        self.n += 1
        self.spark.createDataFrame(list(rows), RESULTS).coalesce(1).write.parquet(str(self.folder / f"stage{self.n}"))
        for k, f in enumerate((self.folder / f"stage{self.n}").glob("*.parquet")):
            f.rename(self.folder / "in" / f"{self.n:03d}-{k}.parquet")

    def run(self):
        """All that is new, in a query of its own; the rows it sends."""
        sent = []
        query = path_maxima(read_steps(self.spark, str(self.folder / "in"), 1), "10 minutes", timedelta(hours=1)).writeStream.outputMode("update")
        query = query.foreachBatch(lambda df, _: sent.extend(tuple(r) for r in df.collect())).option("checkpointLocation", str(self.folder / "state")).trigger(availableNow=True).start()
        query.awaitTermination(240)
        assert not query.isActive and query.exception() is None
        return sent


@pytest.fixture
def stream(spark, tmp_path):
    old = {k: spark.conf.get(k, None) for k in ("spark.sql.streaming.stateStore.providerClass", "spark.sql.shuffle.partitions")}
    use_state_store(spark)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield Stream(spark, tmp_path)
    for k, v in old.items():
        spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def test_a_restart_goes_on_with_the_maximum(stream):
    stream.add(step("a", 1, 3, 0), step("a", 2, 7, 1), step("b", 1, -5, 1))
    assert sorted(stream.run()) == [("m", "a", "strain", 7.0, 2, 2, False), ("m", "b", "strain", -5.0, 1, 1, False)]
    stream.add(step("a", 3, 4, 2), step("b", 2, None, 2))
    assert sorted(stream.run()) == [("m", "a", "strain", 7.0, 2, 3, False), ("m", "b", "strain", -5.0, 1, 2, False)]
    # steps in any order: an equal maximum of an earlier step is the one that counts
    stream.add(step("a", 6, 9, 4), step("a", 5, 9, 3), step("a", 4, 1, 2))
    assert stream.run() == [("m", "a", "strain", 9.0, 5, 6, False)]


def test_late_steps_and_paths_that_end(stream):
    stream.add(step("a", 1, 1, 0))
    stream.add(step("a", 2, 2, 30), step("n", 1, None, 30))
    sent = stream.run()
    assert ("m", "a", "strain", 2.0, 2, 2, False) in sent and ("m", "n", "strain", None, None, 1, False) in sent
    # five minutes behind the newest step is in time, half an hour is not
    stream.add(step("a", 9, 50, 25))
    stream.add(step("a", 8, 99, 0))
    assert [r for r in stream.run() if r[1] == "a"][-1][3:6] == (50.0, 9, 3)
    # a step of another path carries the watermark past an hour of silence
    stream.add(step("c", 1, 0, 300))
    stream.add(step("c", 2, 0, 301))
    ended = sorted(r for r in stream.run() if r[-1])
    assert ended == [("m", "a", "strain", 50.0, 9, 3, True), ("m", "n", "strain", None, None, 1, True)]
    # a path that ended begins anew
    stream.add(step("a", 1, 4, 302))
    assert ("m", "a", "strain", 4.0, 1, 1, False) in stream.run()
