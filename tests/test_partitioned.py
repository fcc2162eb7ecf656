"""A memory of which an ingest rewrites only what it touches."""

import json
import os

import pytest
from pyspark.sql import functions as F

from tests.test_operators import payload
from topicmill.operators import memory
from topicmill.sources import partitioned
from topicmill.sources.schemas import PAYLOAD, TABLES


def at():
    return F.lit("2025-03-01 00:00:00").cast("timestamp")


def month(number, *args, **more):
    body = payload(*args)
    days = {"period_start": f"2025-{number:02d}-01", "period_end": f"2025-{number:02d}-28", "papers": [p | {"paper_id": f"{p['paper_id']}-{number}"} for p in body["papers"]]}
    for c in body["clusters"]:
        c["members"] = [m | {"paper_id": f"{m['paper_id']}-{number}"} for m in c["members"]]
    return json.loads(json.dumps(body | days)) | more


def read(spark, tmp_path, *bodies):
    path = tmp_path / f"{len(os.listdir(tmp_path))}.json"
    path.write_text("\n".join(map(json.dumps, bodies)))
    return spark.read.schema(PAYLOAD).json(str(path))


def contents(tables):
    return {n: sorted(map(str, tables[n].select(*[c.split()[0] for c in TABLES[n][0].split(", ")]).collect())) for n in TABLES}


def files(folder, *parts):
    found = {}
    for root, _, names in os.walk(folder):
        if any(p in root for p in parts):
            found |= {f"{root}/{n}": os.stat(f"{root}/{n}").st_mtime_ns for n in names}
    return found


def test_reruns_and_replays_touch_their_own_parts_only(spark, tmp_path):
    folder, empty = str(tmp_path / "m"), {n: spark.createDataFrame([], s) for n, (s, _) in TABLES.items()}
    assert contents(partitioned.partitioned_memory(spark, folder)) == contents(empty)
    first = read(spark, tmp_path, month(1), month(2))
    assert partitioned.update_memory(spark, folder, first, "b0", at())
    expected = memory.ingest(empty, first, at())
    assert contents(partitioned.partitioned_memory(spark, folder)) == contents(expected)

    before = files(folder, "2025-01-01", "cluster_member", "paper", "batches")
    assert not partitioned.update_memory(spark, folder, read(spark, tmp_path, month(2, "k9")), "b0", at())
    assert files(folder, "2025-01-01", "cluster_member", "paper", "batches") == before

    # the second month again, with another configuration and without clusters of the first one's
    january = files(folder, "2025-01-01")
    later = read(spark, tmp_path, month(2, "k9"), month(3))
    assert january and partitioned.update_memory(spark, folder, later, "b1", at())
    expected = memory.ingest({n: spark.createDataFrame(df.collect(), df.schema) for n, df in expected.items()}, later, at())
    assert contents(partitioned.partitioned_memory(spark, folder)) == contents(expected) and files(folder, "2025-01-01") == january

    # a rerun that leaves no cluster, without a batch's name
    bare = read(spark, tmp_path, month(3, clusters=[]))
    expected = memory.ingest({n: spark.createDataFrame(df.collect(), df.schema) for n, df in expected.items()}, bare, at())
    assert partitioned.update_memory(spark, folder, bare, None, at())
    found = partitioned.partitioned_memory(spark, folder)
    assert contents(found) == contents(expected) and found["cluster"].where("cluster_id LIKE '%2025-03-01%'").count() == 0
    assert files(folder, "2025-01-01") == january


def test_faults_write_nothing_and_a_failed_batch_is_completed(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "m")
    with pytest.raises(ValueError, match="member without paper"):
        partitioned.update_memory(spark, folder, read(spark, tmp_path, payload(members=("zz",))), "b0")
    assert not os.path.exists(folder)
    given, wanted = read(spark, tmp_path, month(1)), memory.ingest({n: spark.createDataFrame([], s) for n, (s, _) in TABLES.items()}, read(spark, tmp_path, month(1)), at())
    part = partitioned._part
    # fail when the members are about to be written: the tables before them are there already
    seen = []
    monkeypatch.setattr(partitioned, "_part", lambda name: part(name) if name != "cluster_member" or not seen.append(name) and len(seen) < 2 else 1 / 0)
    with pytest.raises(ZeroDivisionError):
        partitioned.update_memory(spark, folder, given, "b0", at())
    monkeypatch.setattr(partitioned, "_part", part)
    assert os.path.exists(f"{folder}/cluster") and not os.path.exists(f"{folder}/cluster_member")
    assert partitioned.update_memory(spark, folder, given, "b0", at())
    assert contents(partitioned.partitioned_memory(spark, folder)) == contents(wanted)


def test_a_stream_in_place_is_safe_to_replay(spark, tmp_path):
    from topicmill.streaming.ingest import follow_payloads_in_place

    source, folder = tmp_path / "in", str(tmp_path / "m")
    source.mkdir()
    (source / "a.json").write_text(json.dumps(month(1)))
    follow_payloads_in_place(spark, str(source), folder, str(tmp_path / "cp")).awaitTermination(120)
    written = files(folder, "m")
    follow_payloads_in_place(spark, str(source), folder, str(tmp_path / "other")).awaitTermination(120)
    assert files(folder, "m") == written and written
    (source / "b.json").write_text(json.dumps(month(2)))
    follow_payloads_in_place(spark, str(source), folder, str(tmp_path / "cp")).awaitTermination(120)
    assert partitioned.partitioned_memory(spark, folder)["source_snapshot"].count() == 2
