"""The watch loop: quiet ticks, bursts, and a start after it was down."""
from tessella.streaming.watch import Watcher


def test_bursts_are_analysed_once_and_nothing_is_lost_while_down(spark, tmp_path):
    files, seen = {"a": 1}, []
    listing = lambda: spark.createDataFrame(sorted(files.items()), "path string, changed int")
    analyse = lambda moved: seen.append(sorted(r.path for r in moved.collect()))
    w = Watcher(spark, listing, analyse, str(tmp_path / "l"))
    w.tick()
    assert seen == []
    files["b"] = 1
    w.tick()
    files["a"] = 2  # the burst goes on
    w.tick()
    assert seen == []
    w.tick()
    assert seen == [["a", "b"]]
    w.tick()
    assert len(seen) == 1
    del files["b"]  # while the loop is down
    files["c"] = 1
    again = Watcher(spark, listing, analyse, str(tmp_path / "l"))
    again.tick()
    assert seen[1:] == [["b", "c"]]
    again.tick()
    assert len(seen) == 2
