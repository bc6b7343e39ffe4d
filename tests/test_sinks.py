"""Sketches of facets within their stated error, and a sink that rotates without losing or doubling lines."""

import glob
import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from wirelake.operators import facets
from wirelake.schema import conform
from wirelake.sources.rotating import LineWriter, RotatingLines, Written


def test_sketches_stay_within_their_error(spark):
    rng = random.Random(2)
    values = [f"v{min(int(rng.paretovariate(0.7)), 3000)}" for _ in range(6000)]
    df = spark.createDataFrame([(i, i % 7, v) for i, v in enumerate(values)], "seq long, part int, v string")
    entries = conform(df.select("seq", F.struct(F.col("v").alias("workload")).alias("src"))).join(df.select("seq", "part"), "seq")
    want, few = Counter(values), 64
    assert len(want) > 4 * few
    shot = facets.sketched_snapshot(facets.facet_sketches(entries, ("part",), few), 10, few).filter("field = 'src.workload'").collect()
    error = facets.most_error(len(values), few)
    assert len(shot) == 10 and all(abs(r["count"] - want[r.value]) <= error for r in shot)
    frequent = {v for v, n in want.items() if n > 2 * error}
    assert frequent and frequent <= {r.value for r in shot}
    exact = facets.sketched_snapshot(facets.facet_sketches(entries, ("part",)), 50).collect()
    assert sorted(map(tuple, exact)) == sorted(map(tuple, facets.facet_snapshot(entries.drop("part")).collect()))


def lines_of(path):
    files = sorted(glob.glob(f"{path}/lines-*.jsonl"))
    return [line for f in files for line in open(f).read().splitlines()], files


def broken(rows, after):
    for i, r in enumerate(rows):
        if i == after:
            raise OSError("lost")
        yield r


def test_lost_and_repeated_tasks(tmp_path):
    path = str(tmp_path / "out")
    writer, rows = LineWriter(path, 40, 0), [(f"line {i:03d}",) for i in range(20)]
    with pytest.raises(OSError):
        writer.write(broken(rows, 7))
    twice, other = [writer.write(iter(rows)) for _ in range(2)], writer.write(iter([("ä",), (None,)]))
    writer.commit([twice[1], None, other, Written([])], 0)
    want = [r[0] for r in rows] + ["ä", ""]
    assert lines_of(path)[0] == want and not glob.glob(f"{path}/_open*")
    assert all(os.path.getsize(f) <= 40 + 9 for f in lines_of(path)[1]) and len(lines_of(path)[1]) == 5
    again = writer.write(iter(rows))
    writer.commit([again, other], 0)  # a batch that had been committed
    assert lines_of(path)[0] == want
    LineWriter(path, 40, 2).commit([writer.write(iter([("new",)]))], 1)
    assert lines_of(path)[0] == ["ä", "", "new"]
    writer.write(iter(rows))
    writer.abort([], 2)
    assert lines_of(path)[0] == ["ä", "", "new"] and not glob.glob(f"{path}/_open*")


def test_a_stream_that_fails_midway(spark, tmp_path):
    """A task dies after some lines; the query starts again, and every line is there once."""
    spark.range(4000).write.parquet(f"{tmp_path}/in")
    flag = str(tmp_path / "fail")
    open(flag, "w").close()

    def maybe(frames):
        for frame in frames:
            if os.path.exists(flag) and (frame.id > 3500).any():
                yield frame[frame.id < 3600]
                raise OSError("lost")
            yield frame

    spark.dataSource.register(RotatingLines)
    ids = spark.readStream.schema("id long").parquet(f"{tmp_path}/in").mapInPandas(maybe, "id long").select(F.col("id").cast("string").alias("value"))
    options = {"path": f"{tmp_path}/out", "checkpointLocation": f"{tmp_path}/state", "mostBytes": "1000", "keep": "0"}
    start = lambda: ids.writeStream.format("rotating_lines").options(**options).trigger(availableNow=True).start().awaitTermination()
    with pytest.raises(Exception):
        start()
    assert lines_of(f"{tmp_path}/out")[0] == []
    os.remove(flag)
    start()
    assert sorted(map(int, lines_of(f"{tmp_path}/out")[0])) == list(range(4000))
    start()
    assert len(lines_of(f"{tmp_path}/out")[0]) == 4000
