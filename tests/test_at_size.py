"""What broke on larger tables, on small ones."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from stackloom.operators import export, fingerprint, gapfill, packing
from stackloom.plans import archive, classification, fingerprints, handling, ingest, merging, resuming
from stackloom.sources import adapter, files
from stackloom.streaming import merge

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="the test tables are not here")
def test_deidentification_events_compile(spark):
    spark.conf.set("spark.sql.codegen.fallback", "false")
    try:
        handling.deidentification_events(spark, SF_DIR).write.format("noop").mode("overwrite").save()  # a count would drop the columns
    finally:
        spark.conf.unset("spark.sql.codegen.fallback")


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="the test tables are not here")
def test_files_of_events_are_never_broadcast(spark):
    plan = handling.deidentification_events(spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and plan.count("SortMergeJoin") == 2


def test_item_events_go_by_line_whatever_the_part(spark, tmp_path):
    day = dt.date(2020, 1, 1)
    # Line 1 confirms, line 2 reviews, which may not follow; the other way round both would be applied.
    lines = [(1, 1, 120_000, 5, day), (1, 2, 4, 5, day)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_shipdate date").write.parquet(f"{tmp_path}/lineitem.parquet")
    assert [(r.status, r.illegal) for r in resuming.item_status_flow(spark, str(tmp_path)).collect()] == [("confirmed", "confirmed>reviewed")]


def test_votes_look_around_once_a_bin(spark, monkeypatch):
    looked, plain = [], gapfill.candidates
    monkeypatch.setattr(gapfill, "candidates", lambda rows, key: (looked.append(rows.count()), plain(rows, key))[1])
    physics = ("1000.0D AS tr", "20.0D AS te", "CAST(NULL AS DOUBLE) AS ti", "90.0D AS fa")
    probes = gapfill.with_bins(spark.range(60).selectExpr("id", "CASE WHEN id % 3 = 1 THEN 'EP' WHEN id % 3 = 2 THEN 'SE' END AS scanning_sequence", *physics))
    known = gapfill.with_bins(spark.range(5).selectExpr("'T1w' AS base", "CASE WHEN id < 3 THEN 'TSE' ELSE 'EPI' END AS technique", *physics))
    votes = {r.id: (r.technique, r.n, r.outcome) for r in gapfill.vote(probes, known, "id").collect()}
    assert looked == [1]
    assert votes == {i: ("EPI", 2, "filled") if i % 3 == 1 else ("TSE", 3, "filled") for i in range(60)}


def test_texts_of_series_are_joined_last(spark):
    row = lambda **c: spark.range(1).selectExpr(*(f"{e} AS {n}" for n, e in c.items()))
    first = {c: "'1'" for c in fingerprint.FIRST_INSTANCE}
    stacks, series, studies = row(series_stack_id="CAST(id AS STRING)", series_id="id", study_id="id"), row(series_id="id", text="'t'"), row(study_id="id", maker="'m'")
    details = [row(series_id="id", **{n: f"'{n}'"}) for n in ("mri", "ct")] + [row(series_id="id + 9", pet="'p'")]
    wide = fingerprint.source(stacks, series, studies, *details, row(series_stack_id="CAST(id AS STRING)", instance_id="'i'", **first))
    got = wide.first()
    assert (got.text, got.maker, got.mri, got.ct, got.pet, got.image_comments) == ("t", "m", "mri", "ct", None, "1")
    joins = [line for line in wide._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join " in line]
    assert ["series_id#" in line for line in joins] == [True] * 4 + [False] * 2  # from the last join to the first


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="the test tables are not here")
def test_stacks_are_shuffled_by_study_and_series_alone(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = fingerprints.stack_fingerprints(spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
        keys = [line.split("hashpartitioning(")[1].split("#")[0] for line in plan.splitlines() if "Exchange hashpartitioning" in line]
        assert "series_stack_id" not in keys and keys.count("study_id") == 3  # instances twice, and studies
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_files_are_listed_in_tasks(spark, tmp_path):
    for path in ("1.dcm", "s1/a/2.dcm", "s1/a b/3.dcm", "s1/a/_x=1/4.dcm", "s1/_hidden/5.dcm", "s1/.6.dcm", "s2/_7.dcm", "s2/8._COPYING_", "s2/9"):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(path)
    (tmp_path / "s2" / "empty.dcm").touch()
    (tmp_path / "s3").mkdir()
    listed = files.list_files(spark, f"file://{tmp_path}/")
    assert "BinaryFile" not in listed._jdf.queryExecution().toString()  # whose list the driver holds
    by_spark = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"file://{tmp_path}").drop("content").filter(files.matches(F.element_at(F.split("path", "/"), -1)))
    assert sorted(listed.select("path", "modified", "bytes").collect()) == sorted(map(tuple, by_spark.collect()))
    assert sorted((r.subject or "", r.leaf, r.name) for r in listed.collect()) == [("", "", "1.dcm"), ("s1", "s1/a", "2.dcm"), ("s1", "s1/a b", "3.dcm"), ("s1", "s1/a/_x=1", "4.dcm"), ("s2", "s2", "9")]
    assert [r.name for r in files.list_files(spark, f"file://{tmp_path}/s1/a/2.dcm").collect()] == ["2.dcm"]
    assert files.list_files(spark, f"file://{tmp_path}/s3").collect() == []
    assert files.list_files(spark, f"file://{tmp_path}/s[12]").count() == 4


def test_roots_without_a_scheme_are_listed_in_tasks(spark, tmp_path):
    (tmp_path / "s1").mkdir()
    (tmp_path / "s1" / "1.dcm").write_text("1")
    listed, by_uri = files.list_files(spark, str(tmp_path)), files.list_files(spark, f"file://{tmp_path}")
    assert "binaryfile" not in listed._jdf.queryExecution().toString().lower()  # whose list the driver holds
    assert listed.collect() == by_uri.collect() and [(r.subject, r.name) for r in listed.collect()] == [("s1", "1.dcm")]
    assert files.list_files(spark, f"{tmp_path}/s*").count() == 1


def test_a_batch_is_read_twice_at_most(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(merge, "SENT_BYTES", 0)
    read = spark.sparkContext.accumulator(0)

    def counted(frames):
        for frame in frames:
            read.add(len(frame))
            yield frame

    schema = "sop_uid string, series_uid string, study_uid string, subject_code string, patient_id string, file_path string, arrival long"
    batch = lambda lo, hi: spark.range(lo, hi).selectExpr("CAST(id % 70 AS STRING)", "'e'", "'t'", "'S'", "'P'", "CAST(id AS STRING)", "id").toDF(*schema.replace(" string", "").replace(" long", "").split(", "))
    stream = merge.Merge(f"file://{tmp_path}/tables")
    stream.apply(batch(0, 50), 0)
    stream.apply(batch(50, 130).mapInPandas(counted, schema), 1)
    assert sorted(int(r.file_path) for r in stream.instances(spark).collect()) == list(range(70))
    assert sorted(int(r.uid) for r in stream.conflicts(spark).collect()) == list(range(60))
    assert read.value == 160  # counted, then merged


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="the test tables are not here")
def test_deliveries_have_more_files_with_more_rows(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(merging, "_FILE_ROWS", 300)
    monkeypatch.setattr(merging, "merge_stream", lambda spark, folder, shape, name, policy, files_per_batch: seen.append((len(spark.read.parquet(folder).inputFiles()), files_per_batch)))
    merging._merged(spark, SF_DIR, merge.SKIP)
    n = -(-spark.read.parquet(f"{SF_DIR}/lineitem.parquet").count() // 900)
    assert n > 4 and seen == [(2 * n, n), (3 * n, n)]


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="the test tables are not here")
@pytest.mark.parametrize("query", [ingest.orphan_parent_audit, ingest.ingest_conflicts])
def test_tasks_of_keys_stay_of_one_size(spark, monkeypatch, query):
    monkeypatch.setattr(adapter, "TASK_ROWS", 500)
    assert query(spark, SF_DIR).rdd.getNumPartitions() >= 12


def test_orphans_by_side(spark, tmp_path):
    studies = [(k, 1, "1-URGENT", dt.date(2020, 1, 1)) for k in (1, 2, 2, 3, None, None)]
    lines = [(k, 1, 1, 1, 1.0, 1.0, 0.1, 0.1, "A", "O", dt.date(2020, 1, 1)) for k in (3, 3, 4, 4, None, None)]
    spark.createDataFrame(studies, "o_orderkey long, o_custkey long, o_orderpriority string, o_orderdate date").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_tax double, l_discount double, l_returnflag string, l_linestatus string, l_shipdate date").write.parquet(f"{tmp_path}/lineitem.parquet")
    found = sorted((r.problem, r.key or 0) for r in ingest.orphan_parent_audit(spark, str(tmp_path)).collect())
    assert found == [("instance without study", 0), ("instance without study", 4)] + [("study without instance", k) for k in (0, 0, 1, 2, 2)]


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="the test tables are not here")
def test_texts_are_digested_before_they_are_packed(spark, monkeypatch):
    seen, plain = [], archive.pack_ffd
    monkeypatch.setattr(archive, "pack_ffd", lambda items, *args: (seen.append(items.columns), plain(items, *args))[1])
    assert archive.archive_manifest(spark, SF_DIR).filter("sha256 is null").count() == 0
    assert seen == [["source", "doc_id", "n_chars", "sha256"]]


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="the test tables are not here")
def test_names_are_built_before_stacks_are_shuffled(spark, monkeypatch):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        skipped = []
        for sent, shuffles in ((export.SENT_BYTES, 3), (0, 4)):  # series, names and the distinct paths; beyond, rows go by path, too
            monkeypatch.setattr(export, "SENT_BYTES", sent)
            planned = classification.export_plan(spark, SF_DIR)
            lines = planned._jdf.queryExecution().executedPlan().toString().splitlines()
            exchanges = [i for i, line in enumerate(lines) if "Exchange hashpartitioning" in line]
            assert len(exchanges) == shuffles
            below = next(lines[i + 1] for i in exchanges if "hashpartitioning(series_id" in lines[i])
            assert "__suffix" in below and not any(f" AS {c}#" in below or f"[{c}#" in below or f", {c}#" in below.split(" AS ")[-1] for c in ("technique", "base", "modifiers"))
            skipped.append(planned.filter("skip").count())
        assert skipped[0] == skipped[1]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_a_large_group_is_packed_as_a_small_one(spark, monkeypatch):
    monkeypatch.setattr(packing, "PART_ITEMS", 50, raising=False)  # from where groups were cut
    packed = packing.pack_ffd(spark.range(300).selectExpr("'g' AS g", "id", "id * 37 % 101 AS size"), "g", "id", "size", 100)
    used, want = [], []
    for size, i in sorted((-(i * 37 % 101), i) for i in range(300)):
        at = next((k for k, u in enumerate(used) if u - size <= 100), len(used))
        used[at:at + 1] = [(used[at] if at < len(used) else 0) - size]
        want.append((i, 0, at))
    assert sorted((r.id, r.part, r.chunk) for r in packed.collect()) == sorted(want)
