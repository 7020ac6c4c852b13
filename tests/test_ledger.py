"""The ledger under replays, losses between write and commit, and conflicts."""

import pytest
from pyspark.errors import StreamingQueryException

from rankwell.sources import ledger, sinks

KIND = "k string, n int, v double, note string"


def rows(spark, path):
    return sorted(((r.k, r.n, r.v, r.status, r.batch) for r in ledger.judged(spark, path, KIND).collect()), key=repr)


def feed(spark, folder, batches):
    for i, b in enumerate(batches):
        spark.createDataFrame([(*x, "t") for x in b], KIND).coalesce(1).write.parquet(f"{folder}/b{i}")
    return spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(folder)


BATCHES = [[("a", 1, 1.0), ("b", 1, None), ("b", 2, None), (None, 1, 1.0)], [("a", 3, 1.0), ("c", 1, 0.1), ("c", 2, 0.3), ("a", 2, 2.0)], [("b", 1, 5.0), ("d", 1, 1e300), ("c", 9, 0.1)]]


def test_losses_and_replays(spark, tmp_path):
    """Killed after each write and before each commit, and started again, it ends as one that was never killed."""
    source = feed(spark, str(tmp_path / "in"), BATCHES)
    args = (["k"], ["n"], ["v"])
    calm, rough = str(tmp_path / "calm"), str(tmp_path / "rough")
    assert ledger.stream(source, calm, str(tmp_path / "c1"), *args).awaitTermination(120)
    seen = []

    def kill():
        seen.append(1)
        if len(seen) % 2:
            raise RuntimeError("killed")

    for _ in range(4):
        query = ledger.stream(source, rough, str(tmp_path / "c2"), *args, kill)
        try:
            query.awaitTermination(120)
        except StreamingQueryException:
            before = rows(spark, rough)
            assert {r[-1] for r in before} == set(range(len(seen) // 2))  # what is not committed does not count
    assert rows(spark, rough) == rows(spark, calm) and len(seen) == 6
    status = {(k, n, s) for k, n, _, s, _ in rows(spark, calm)}
    assert status >= {("a", 1, "APPENDED"), ("a", 2, "CONFLICT"), ("a", 3, "REPEATED"), ("b", 2, "REPEATED"), ("c", 1, "APPENDED"), ("c", 9, "REPEATED"), ("c", 2, "CONFLICT"), (None, 1, "REFUSED")}
    # a committed batch that comes again changes nothing, whatever it says
    again = spark.createDataFrame([("z", 1, 1.0, "t")], KIND)
    assert not ledger.append_batch(again, 0, calm, *args) and rows(spark, rough) == rows(spark, calm)
    assert ledger.append_batch(again.limit(0), 7, calm, *args) and ledger.append_batch(again, 8, calm, *args)


def test_forbidden(spark, tmp_path):
    bad = spark.createDataFrame([], "k string, m struct<chain_of_thought:string>")
    with pytest.raises(sinks.Refused):
        ledger.append_batch(bad, 0, str(tmp_path / "x"), ["k"], ["k"], ["k"])
