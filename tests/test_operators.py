"""Operators on small tables: nulls, empty tables, ties, repeated keys, and files made here."""

import datetime as dt
import hashlib
import json
import random
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from stackloom.functions import misc
from stackloom.operators import completion, explore, export, fingerprint, flow, gapfill, identity, imports, packing, qc, resume, review, rules, stacks, upsert
from stackloom.plans.protocols import FIELDS, PROTOCOLS
from stackloom.sources import elements, files, headers, manifest
from stackloom.streaming import ingest, merge

CASE = dict(zip([f.split()[0] for f in FIELDS.split(", ")], [None] * 13, strict=True))


def classified(spark, *cases):
    """Outcomes of cases, each given by what differs from a stack without any header."""
    rows = [(i, *(CASE | c).values(), a, n) for i, (c, a, n) in enumerate((x if isinstance(x, tuple) else (x, 1.0, 100)) for x in cases)]
    df = spark.createDataFrame(rows, f"stack_id int, {FIELDS}, aspect double, n_instances int")
    return [r for r in sorted(rules.classify(df, ["stack_id"]).collect())]


def test_techniques_have_display_names(spark):
    names = {"space cor": "SPACE", "stir tirm": "TIRM", "haste loc": "HASTE", "flash 2d": "FLASH", "tof neck": "TOF", "medic c spine": "MEDIC", "pcasl": "ASL", "trufi cine": "FIESTA", "perfusion pwi": "Perfusion", "nothing at all": "Unknown"}
    out = classified(spark, *({"text": t} for t in names))
    assert [r.technique for r in out] == list(names.values())
    assert {r.technique_confidence for r in out[:-1]} == {0.85} and out[-1].technique_confidence == 0.0


def test_first_match_goes_by_priority_not_by_strength(spark):
    both = {"scanning_sequence": "EP\\SE", "text": "se-epi diffusion"}
    diffusion, plain, segmented = classified(spark, both, {"scanning_sequence": "EP\\SE"}, {"scanning_sequence": "EP", "sequence_variant": "SK"})
    assert (diffusion.technique, plain.technique, segmented.technique) == ("DWI-EPI", "SE-EPI", "RESOLVE")
    assert (plain.technique_confidence, segmented.technique_confidence) == (0.75, 0.75)


@pytest.mark.parametrize(
    ("case", "base", "confidence"),
    [
        ({"text": "flair axial", "te": 39.9}, "T1w", 0.85),
        ({"text": "flair axial", "te": 40.0}, "T2w", 0.85),
        ({"text": "flair axial"}, "T2w", 0.7),
        ({"text": "pd t2 tse", "te": 12.0}, "PDw", 0.85),
        ({"text": "proton density t2 tse", "te": 80.0}, "T2w", 0.85),
        ({"scanning_sequence": "SE", "tr": 1000.0, "te": 10.0}, None, 0.5),
        ({"scanning_sequence": "SE", "tr": 999.0, "te": 10.0}, "T1w", 0.7),
        ({"scanning_sequence": "SE", "tr": 2001.0, "te": 29.0}, "PDw", 0.65),
        ({"scanning_sequence": "SE\\IR", "ti": 299.0}, "T2w", 0.75),
        ({"scanning_sequence": "SE\\IR", "ti": 1500.0}, "T1w", 0.7),
        ({"scanning_sequence": "GR", "te": 10.0}, None, 0.5),
        ({"scanning_sequence": "GR", "te": 15.5}, "T2*w", 0.7),
        ({"scanning_sequence": "EP\\GR", "te": 30.0}, None, 0.5),
    ],
)
def test_base_by_steps(spark, case, base, confidence):
    (r,) = classified(spark, case)
    assert (r.base, r.base_confidence) == (base, confidence)


def test_excluded_stacks_have_no_axes(spark):
    reformat, screenshot, kept = classified(spark, {"image_type": "DERIVED\\SECONDARY\\MPR"}, {"image_type": "ORIGINAL\\PRIMARY\\SCREEN SAVE"}, {"image_type": "DERIVED\\PRIMARY\\SECONDARY"})
    assert (reformat.intent, reformat.excluded, reformat.technique, reformat.review_reasons) == ("excluded", "secondary_reformat", None, "excluded:secondary_reformat")
    assert screenshot.excluded in ("screenshot", None) and kept.excluded is None


def test_conflicts_and_the_spine_heuristic(spark):
    base = {"scanning_sequence": "SE", "tr": 600.0, "te": 10.0, "text": "t2w tse"}
    long_tse = ({"text": "tse sag"}, 1.3, 20)
    at_bound = ({"text": "tse sag"}, 1.25, 20)
    many = ({"text": "tse sag"}, 1.3, 80)
    out = classified(spark, base, {"text": "tse fast spin", "scanning_sequence": "GR"}, long_tse, at_bound, many)
    assert out[0].base == "T2w" and "base:conflict" not in out[0].review_reasons  # by keyword: no conflict
    assert "technique:conflict" in out[1].review_reasons
    assert "body_part:heuristic" in out[2].review_reasons
    assert not any("body_part:heuristic" in r.review_reasons for r in out[3:])


def test_profiles_do_not_mix_rows(spark):
    """Rows that share a profile, or differ in what no rule compares with, keep their own outcome."""
    cases = [{"text": "flair", "te": te, "tr": tr} for te in (39.0, 40.0, 41.0, None) for tr in (1.0, 500.0, 5000.0)] * 3
    out = classified(spark, *cases)
    assert len(out) == len(cases)
    assert [r.base for r in out] == ["T1w" if c["te"] and c["te"] < 40 else "T2w" for c in cases]
    assert classified(spark, *[({}, None, None)])[0].intent == "misc"
    empty = spark.createDataFrame([], f"stack_id int, {FIELDS}, aspect double, n_instances int")
    assert rules.classify(empty, ["stack_id"]).collect() == []
    assert len(PROTOCOLS) == 23


def test_symri_and_swi_branches(spark):
    out = classified(
        spark,
        {"text": "symri", "image_type": "DERIVED\\PRIMARY\\B1MAP"},
        {"text": "symri", "image_type": "DERIVED\\PRIMARY\\QMAP\\PD"},
        {"text": "symri", "image_type": "DERIVED\\PRIMARY\\PDW\\SYNTHETIC"},
        {"text": "symri magnitude"},
        {"text": "symri", "sequence_name": None},
        {"text": "swi qsm epi"},
        {"text": "swi mip"},
        {"text": "swi magnitude phase"},
        {"text": "swan"},
    )
    assert [(r.base, r.constructs, r.intent) for r in out] == [
        (None, "B1map", "fmap"), (None, "PDmap", "anat"), ("PDw", "SyntheticPDw", "anat"), (None, "Magnitude", "anat"), (None, "Magnitude", "anat"),
        ("SWI", "QSM", "anat"), ("SWI", "MIP", "anat"), ("SWI", "Magnitude", "anat"), ("SWI", "SWI", "anat"),
    ]
    assert [r.technique for r in out[5:7]] == ["EPI", "GRE"] and {r.technique for r in out[:5]} == {"MDME"}


def test_acceleration_words(spark):
    texts = {"combat number membrane": "", "mb4": "SimultaneousMultiSlice", "search march": "", "arc": "ParallelImaging", "csf": "", "t2_cs": "CompressedSensing", "pfx": "", "5/8 twist": "PartialFourier,ViewSharing", None: "", "": ""}
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.a for r in df.select("i", rules.acceleration({}, F.col("t"), F.lit(None).cast("string")).alias("a")).collect()}
    assert [got[i] for i in range(len(texts))] == list(texts.values())


def test_compatibility_of_techniques(spark):
    cases = [("TIRM", "IR", True), ("TSE", "", True), ("TSE", None, True), (None, "EP", True), ("DWI-EPI", "RM", False), ("DWI-EPI", "['RM']", False), ("DWI-EPI", "RM\\GR", True), ("MPRAGE", "se", False), ("MPRAGE", "XX", True), ("EPI", "GR", False), ("ASL", "GR", True)]
    df = spark.createDataFrame([(i, t, s) for i, (t, s, _) in enumerate(cases)], "i int, t string, s string")
    got = {r.i: r.ok for r in df.select("i", gapfill.compatible(F.col("t"), F.col("s")).alias("ok")).collect()}
    assert [got[i] for i in range(len(cases))] == [ok for *_, ok in cases]


def test_upserts_with_nulls_and_repeats(spark):
    old = spark.createDataFrame([(1, "a", 10), (2, "b", 20), (None, "n", 0)], "k int, v string, w int")
    new = spark.createDataFrame([(2, None, 21), (3, "c", None), (None, "m", 1)], "k int, v string, w int")
    rows = lambda df: sorted(map(tuple, df.collect()), key=repr)
    assert rows(upsert.upsert(old, new, ["k"])) == sorted([(1, "a", 10), (2, None, 21), (3, "c", None), (None, "m", 1)], key=repr)
    assert (2, "b", 21) in rows(upsert.merge_non_null(old, new, ["k"])) and (2, None, 21) in rows(upsert.merge_non_null(old, new, ["k"], skip_blank=False))
    assert rows(upsert.insert_ignore(old, new, ["k"])) == sorted([(1, "a", 10), (2, "b", 20), (None, "n", 0), (3, "c", None)], key=repr)
    assert rows(upsert.upsert(old.limit(0), new, ["k"])) == rows(new) and rows(upsert.upsert(old, new.limit(0), ["k"])) == rows(old)
    ids = spark.createDataFrame([("x", 7), ("y", 3)], "k string, id long")
    given = {r.k: r.id for r in upsert.assign_ids(ids, spark.createDataFrame([("x",), ("z",), ("z",), (None,), ("q",)], "k string"), "k", "id").collect()}
    assert given["x"] == 7 and given["y"] == 3 and {given["z"], given["q"]} == {8, 9} and len(given) == 4


def test_names_packs_and_votes(spark):
    rows = spark.createDataFrame([("s", "n", 1), ("s", "n", 1), ("s", "m", 1), (None, "n", 2), ("t", None, 3)], "scope string, name string, at int")
    named = sorted((r.scope or "", r.unique_name or "") for r in review.unique_names(rows, ["scope"], "name", [F.col("at")]).collect())
    assert named == [("", "n"), ("s", "m"), ("s", "n_1"), ("s", "n_2"), ("t", "")]
    items = spark.createDataFrame([("g", "a", 6), ("g", "b", 5), ("g", "c", 5), ("g", "d", 99), ("g", "e", 1), (None, "a", 4)], "g string, n string, size int")
    chunks = {(r.g, r.n): r.chunk for r in packing.pack_ordered(items, "g", "n", "size", 10).collect()}
    assert [chunks["g", x] for x in "abcde"] == [0, 1, 1, 2, 3] and chunks[None, "a"] == 0
    votes = spark.createDataFrame([(1, "x", "y"), (1, "x", "y"), (1, "a", "b"), (1, "a", "b"), (2, "x", None), (2, "q", "r")], "g int, p string, q string")
    assert [(r.g, r.p, r.q, r.votes) for r in review.majority_pair(votes, "g", ["p", "q"]).collect()] == [(1, "a", "b", 2)]


def test_worklists_and_drafts(spark):
    cache = spark.createDataFrame([(1, 1, "base:missing, technique:conflict", 1), (2, 2, "base:missing", 1), (3, 3, None, 0), (4, 4, "contrast:low", 1)], "stack_id int, series_id int, review_reasons string, review_required int")
    cache = cache.withColumns({c: F.lit("old") for c in qc.AXIS_COLUMNS.values()})
    drafts = spark.createDataFrame([(1, "base", 1, "T1w"), (1, "base", 2, "T2w"), (2, "base", 1, None), (4, "notes", 1, "x")], "series_id int, field string, draft_id int, new_value string")
    out = {r.stack_id: r for r in qc.confirm_drafts(cache, drafts).collect()}
    assert (out[1].base, out[1].review_reasons.strip(), out[1].review_required) == ("T2w", "technique:conflict", 1)
    assert (out[2].base, out[2].review_reasons, out[2].review_required) == (None, None, 0)
    assert (out[3].base, out[3].review_required, out[4].review_reasons, out[4].review_required) == ("old", 0, "contrast:low", 1)
    assert qc.confirm_drafts(cache, drafts.limit(0)).collect() == cache.collect()


def test_export_names(spark):
    schema = "orientation string, base string, acquisition_type string, modifiers string, technique string, accelerations string, constructs string, spinal_cord int, post_contrast int, stack_key string, stack_index int"
    rows = [("Sagittal", "T2w", "2D", "FLAIR,FatSat", "TSE", "", None, 1, None, None, 0), (None, None, None, None, None, None, None, None, None, None, 0), (None, None, None, None, None, None, None, 1, 1, None, 0), ("Oblique", None, None, None, "GRE", None, "A,B", 0, 0, "multi_echo", 2)]
    df = spark.createDataFrame(rows, schema)
    assert [r.n for r in df.select(export.stack_name(F.lit(True)).alias("n")).collect()] == ["SC_Sag_T2w_2D_FLAIR-FatSat_TSE", "unknown", "SC_CE", "Obl_GRE_A-B_e3"]
    assert df.select(export.subject_label(F.lit(None).cast("string")).alias("s"), export.session_label(F.lit(dt.date(2020, 1, 2))).alias("d")).first()[:] == ("sub-unknown", "ses-20200102")


def test_ids_and_time_points(spark):
    df = spark.createDataFrame([("p1",), (None,), ("é",)], "p string")
    got = [r[0] for r in df.select(identity.keyed_hash("key")(F.col("p"))).collect()]
    assert got == [hashlib.blake2b(x.encode(), key=b"key", digest_size=8).hexdigest() if x else None for x in ("p1", None, "é")]
    want = int(hashlib.blake2b(b"s|p1", digest_size=4).hexdigest(), 16) % 10**5
    assert df.select(identity.deterministic_id(F.col("p"), "IDXXXXX", "s")).first()[0] == f"ID{want:05d}"
    days = [("2020-01-31", "2020-02-29"), ("2020-01-01", "2020-01-10"), ("2020-01-01", "2020-07-20"), ("2021-01-01", "2020-01-01"), ("2020-01-01", "2020-04-01"), ("2010-01-01", "2020-01-01")]
    table = spark.createDataFrame([tuple(map(dt.date.fromisoformat, d)) for d in days], "a date, b date")
    assert [r[0] for r in table.select(identity.timepoint(F.col("a"), F.col("b"))).collect()] == ["M01", "M00", "M06", "M12", "M03", "M120"]
    rows = spark.createDataFrame([("a", 3), ("b", 1), ("a", 0), (None, 0)], "p string, at int")
    assert {r.p: r.new_id for r in identity.sequential_ids(rows, "p", "at", "SXX").collect()} == {"a": "S01", "b": "S02"}
    mapping = spark.createDataFrame([(" P1 ", " C1 "), ("P2", ""), (None, "x")], "old_id string, new_id string")
    people = spark.createDataFrame([("P1", "u"), ("P2", "u"), (None, "u"), (None, None)], "patient_id string, study_uid string")
    out = identity.resolved_subjects(people, mapping, "seed", strict=False).collect()
    assert [r.source for r in out] == ["csv", "hash", "hash", None] and out[0].subject_code == "C1" and out[3].subject_code is None


def test_subject_mappings_with_problems_are_rejected(spark):
    people = spark.createDataFrame([("P1", "u"), ("P9", "u"), (None, None)], "patient_id string, study_uid string")
    table = lambda *entries: spark.createDataFrame(entries, "old_id string, new_id string")
    fine = table((" P1", "C1 "), ("P1", "C1"), (None, " "), ("P3", "C3"))
    assert identity.mapping_problems(fine).count() == 0
    assert {(r.patient_id, r.source) for r in identity.resolved_subjects(people, fine, "seed").collect()} == {("P1", "csv"), ("P9", "hash"), (None, None)}
    for entries, problem, wording in ((((" P1", "C1"), ("P1", "C2")), ("conflict", "P1"), "several codes for P1"), ((("P1", " "),), ("code_missing", "P1"), "no code for P1"), (((None, "C7"),), ("id_missing", "C7"), "no id for C7")):
        assert [tuple(r) for r in identity.mapping_problems(table(*entries)).collect()] == [problem]
        with pytest.raises(Exception, match=wording):
            identity.resolved_subjects(people, table(*entries), "seed").collect()
    assert identity.mapping_problems(table(("P1", "C1")).limit(0)).count() == 0


def test_csv_imports(spark, tmp_path):
    path = tmp_path / "subjects.csv"
    path.write_text('﻿code , born,active\nS1,31/12/1999,yes\n"S2\nx",1999-02-30,maybe\n,2000-01-01,1\nS1,,0\n', encoding="utf-8")
    rows = imports.read_csv(spark, f"file://{path}")
    assert rows.columns == ["code", "born", "active"] and rows.count() == 4
    numbered = rows.coalesce(1).withColumn("row_number", F.monotonically_increasing_id() + 1)
    fields = [imports.Field("subject_code", "code"), imports.Field("birth", "born", parser="date"), imports.Field("active", "active", parser="bool"), imports.Field("site", "nowhere", " x ")]
    out = imports.coerced(numbered, fields).orderBy("row_number").collect()
    assert [r.birth for r in out] == [dt.date(1999, 12, 31), None, dt.date(2000, 1, 1), None] and {r.site for r in out} == {"x"}
    assert out[1].warnings == ["Row 2: cannot parse birth", "Row 2: cannot parse active"] and out[0].warnings == []
    last = {r.subject_code: r for r in imports.last_rows(imports.coerced(numbered, fields), "subject_code").collect()}
    assert set(last) == {"S1", "S2\nx"} and (last["S1"].birth, last["S1"].active) == (None, 0)
    known = spark.createDataFrame([("S1", dt.date(1990, 1, 1), 1)], "subject_code string, birth date, active int")
    plan = {r.subject_code: r for r in imports.import_plan(known, imports.last_rows(imports.coerced(numbered, fields), "subject_code"), "subject_code", ["birth", "active"]).collect()}
    assert (plan["S1"].action, plan["S1"].birth, plan["S1"].active) == ("updated", dt.date(1990, 1, 1), 0) and plan["S2\nx"].action == "inserted"


def image(elements, implicit=False, tail=b""):
    """A file with a header of (group, number, kind, value) and something behind it."""

    def element(group, number, kind, value, plain):
        value += b" " * (len(value) % 2) if kind not in (b"UI", b"SQ") else b"\0" * (len(value) % 2)
        head = struct.pack("<HH", group, number)
        if plain:
            return head + struct.pack("<I", len(value)) + value
        return head + kind + (b"\0\0" + struct.pack("<I", len(value)) if kind in (b"OW", b"SQ", b"UN") else struct.pack("<H", len(value))) + value

    syntax = b"1.2.840.10008.1.2" + (b"" if implicit else b".1")
    meta = element(2, 0x10, b"UI", syntax, False)
    return b"\0" * 128 + b"DICM" + element(2, 0, b"UL", struct.pack("<I", len(meta)), False) + meta + b"".join(element(*e, implicit) for e in elements) + tail


def test_headers_are_read_up_to_the_last_tag(spark, tmp_path):
    sequence = struct.pack("<HHI", 0xFFFE, 0xE000, 0xFFFFFFFF) + struct.pack("<HH", 0x0008, 0x0060) + b"CS" + struct.pack("<H", 2) + b"XX" + struct.pack("<HHI", 0xFFFE, 0xE00D, 0) + struct.pack("<HHI", 0xFFFE, 0xE0DD, 0)
    undefined = struct.pack("<HH", 0x0008, 0x1111) + b"SQ\0\0" + struct.pack("<I", 0xFFFFFFFF) + sequence
    first = [(8, 0x16, b"UI", b"1.2.840.10008.5.1.4.1.1.4"), (8, 0x18, b"UI", b"1.2.3"), (8, 0x20, b"DA", b"20200102"), (8, 0x60, b"CS", b"mr")]
    rest = [(0x10, 0x20, b"LO", "Pé".encode()), (0x18, 0x81, b"DS", b"12.5"), (0x20, 0xD, b"UI", b"1.9"), (0x20, 0xE, b"UI", b"1.9.1"), (0x28, 0x10, b"US", struct.pack("<H", 256))]
    plain = image(first)
    (tmp_path / "s1" / "a").mkdir(parents=True)
    (tmp_path / "s1" / "a" / "1.dcm").write_bytes(plain + undefined + image(rest)[len(image([])) :] + b"\xff" * 300_000)
    (tmp_path / "s1" / "a" / "2").write_bytes(image(first + rest, implicit=True, tail=struct.pack("<HHI", 0x7FE0, 0x10, 10) + b"\0" * 10))
    (tmp_path / "s1" / "3.DCM").write_bytes(b"no image")
    (tmp_path / "readme.txt").write_text("x")
    listed = files.list_files(spark, f"file://{tmp_path}")
    assert sorted((r.subject, r.leaf, r.name) for r in listed.collect()) == [("s1", "s1", "3.DCM"), ("s1", "s1/a", "1.dcm"), ("s1", "s1/a", "2")]
    assert files.list_files(spark, f"file://{tmp_path}", "dcm").count() == 1 and files.list_files(spark, f"file://{tmp_path}", "no_ext").count() == 1
    stats = files.source_statistics(listed).first()
    assert (stats.n_folders, stats.n_files, stats.n_subjects) == (2, 3, 1)
    read = headers.read_headers(spark, listed, ["SOPClassUID", "SOPInstanceUID", "StudyDate", "Modality", "PatientID", "EchoTime", "StudyInstanceUID", "SeriesInstanceUID", "Rows"], files_per_task=2)
    out = {r.path.rsplit("/", 1)[1]: r for r in read.collect()}
    for name in ("1.dcm", "2"):
        r = out[name]
        assert (r.Modality, r.PatientID, r.EchoTime, r.Rows, r.StudyInstanceUID, r.error) == ("mr", "Pé", "12.5", "256", "1.9", None), r
    assert out["3.DCM"].error and out["3.DCM"].Modality is None
    rows = headers.let_in(headers.projected(read)).collect()
    assert [(r.modality, r.study_date, r.te, r.rows, r.tr) for r in rows] == [("MR", dt.date(2020, 1, 2), 12.5, 256, None)] * 2


def _plain_element(tag, kind, value, order="<"):
    value = value if isinstance(value, bytes) else value.encode("latin_1")
    value += (b"\0" if kind in ("UI", "SQ", "OB") else b" ") * (len(value) % 2)
    head = struct.pack(order + "HH", tag >> 16, tag & 0xFFFF) + kind.encode()
    return head + (b"\0\0" + struct.pack(order + "I", len(value)) if kind in ("SQ", "UN", "OB", "UT") else struct.pack(order + "H", len(value))) + value


def _file(body, syntax="1.2.840.10008.1.2.1", preamble=True, **meta):
    group = b"".join(_plain_element(elements.TAGS[k], "UI", v) for k, v in sorted(meta.items(), key=lambda x: elements.TAGS[x[0]]) if elements.TAGS[k] < 0x00020010) + _plain_element(0x00020010, "UI", syntax)
    return (b"\0" * 128 + b"DICM" if preamble else b"") + group + body


def test_headers_of_all_kinds(spark, tmp_path):
    name, patient = elements.TAGS["PatientName"], elements.TAGS["PatientID"]
    charset = lambda x: _plain_element(0x00080005, "CS", x)
    code = _plain_element(0x00080100, "SH", "113691") + _plain_element(0x00080104, "LO", "IEC Head")
    nested = _plain_element(0x00189346, "SQ", b"\xfe\xff\x00\xe0" + struct.pack("<I", len(code)) + code)
    inner = _plain_element(0x00081140, "SQ", b"\xfe\xff\x00\xe0\xff\xff\xff\xff" + _plain_element(0x00080100, "SH", "X") + _plain_element(0x00280010, "US", struct.pack("<H", 7)) + b"\xfe\xff\x0d\xe0\0\0\0\0")
    deep = struct.pack("<HH", 0x0018, 0x9346) + b"SQ\0\0\xff\xff\xff\xff\xfe\xff\x00\xe0" + struct.pack("<I", len(inner)) + inner + b"\xfe\xff\xdd\xe0\0\0\0\0"
    tail = b"\xe0\x7f\x10\0OW\0\0\xff\xff\xff\xff"
    order = lambda *parts: b"".join(parts)
    made = {
        "latin": _file(order(charset("ISO_IR 100"), _plain_element(name, "PN", "Åberg^Sören".encode("latin_1")), tail)),
        "utf8": _file(order(charset("ISO_IR 192"), _plain_element(name, "PN", "Wang^小东".encode()), tail)),
        "greek": _file(order(charset("ISO_IR 126"), _plain_element(name, "PN", "Διονυσιος".encode("iso8859_7")), tail)),
        "japanese": _file(order(charset("\\ISO 2022 IR 87"), _plain_element(name, "PN", b"Yamada^Tarou=\x1b$B;3ED\x1b(B^\x1b$BB@O:\x1b(B"), tail)),
        "korean": _file(order(charset("\\ISO 2022 IR 149"), _plain_element(name, "PN", b"Hong^Gildong=\x1b$)C\xfb\xf3^\x1b$)C\xd1\xce\xd4\xd7"), tail)),
        "unnamed": _file(order(_plain_element(name, "PN", "Åberg".encode("latin_1")), tail)),
        "deflated": _file((lambda z: z.compress(order(_plain_element(name, "PN", "Deep^Flat"), _plain_element(patient, "LO", "P1"), nested, tail, b"\0" * 200_000)) + z.flush())(zlib.compressobj(9, zlib.DEFLATED, -15)), "1.2.840.10008.1.2.1.99"),
        "big": _file(order(_plain_element(name, "PN", "Big^End", ">"), _plain_element(0x00280010, "US", struct.pack(">H", 512), ">"), tail), "1.2.840.10008.1.2.2"),
        "bare": order(_plain_element(0x00080016, "UI", "1.2.3"), _plain_element(name, "PN", "No^Preamble"), tail),
        "bare_implicit": struct.pack("<HHI", 0x0008, 0x0016, 6) + b"1.2.3\0" + struct.pack("<HHI", 0x0010, 0x0010, 4) + b"A^B " + struct.pack("<HHI", 0x0028, 0x0010, 2) + struct.pack("<H", 99),
        "meta": _file(order(_plain_element(name, "PN", "M"), nested, tail), MediaStorageSOPClassUID="1.2.840.10008.5.1.4.1.1.2", MediaStorageSOPInstanceUID="9.9"),
        "deep": _file(order(_plain_element(name, "PN", "D"), deep, tail)),
        "cut": _file(order(_plain_element(name, "PN", "D"), nested))[:-5],
        "empty": b"",
    }
    for n, raw in made.items():
        (tmp_path / n).write_bytes(raw)
    listed = spark.createDataFrame([(f"file://{tmp_path}/{n}", len(raw)) for n, raw in made.items()], "path string, bytes long")
    keywords = ["PatientName", "PatientID", "Rows", "CTDIPhantomTypeCodeSequence", "NoSuchKeyword", *headers.keywords_of({"sop_class_uid": ("SOPClassUID", None)}), "MediaStorageSOPInstanceUID"]
    read = headers.read_headers(spark, listed, keywords, files_per_task=3)
    out = {r.path.rsplit("/", 1)[1]: r for r in read.collect()}
    assert {n: r.error for n, r in out.items() if r.error} == {"cut": "the header is cut off", "empty": "no image header"}
    names = {n: r.PatientName for n, r in out.items()}
    assert [names[n] for n in ("latin", "utf8", "greek", "unnamed", "deflated", "big", "bare", "bare_implicit")] == ["Åberg^Sören", "Wang^小东", "Διονυσιος", "Åberg", "Deep^Flat", "Big^End", "No^Preamble", "A^B"]
    assert names["japanese"] == "Yamada^Tarou=山田^太郎" and names["korean"] == "Hong^Gildong=洪^吉洞"
    assert (out["big"].Rows, out["bare_implicit"].Rows, out["deflated"].PatientID, out["bare"].NoSuchKeyword) == ("512", "99", "P1", None)
    assert json.loads(out["meta"].CTDIPhantomTypeCodeSequence) == json.loads(out["deflated"].CTDIPhantomTypeCodeSequence) == [{"00080100": {"vr": "SH", "Value": ["113691"]}, "00080104": {"vr": "LO", "Value": ["IEC Head"]}}]
    assert json.loads(out["deep"].CTDIPhantomTypeCodeSequence) == [{"00081140": {"vr": "SQ", "Value": [{"00080100": {"vr": "SH", "Value": ["X"]}, "00280010": {"vr": "US", "Value": [7]}}]}}]
    classes = {r.path.rsplit("/", 1)[1]: r.sop_class_uid for r in headers.projected(read, {"sop_class_uid": ("SOPClassUID", None)}).collect()}
    assert (classes["meta"], classes["bare"], classes["latin"]) == ("1.2.840.10008.5.1.4.1.1.2", "1.2.3", None)
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and str(tmp_path) not in plan.split("MapInArrow")[0]


def test_every_table_of_an_archive_is_projected(spark):
    keywords = headers.keywords_of(*headers.TABLES.values())
    row = {k: "20200102" if k.endswith("Date") else "101500.5" if k.endswith("Time") else "7" for k in keywords}
    df = spark.createDataFrame([("p", *row.values())], "path string, " + ", ".join(f"`{k}` string" for k in row))
    for name, table in headers.TABLES.items():
        got = headers.projected(df, table).first().asDict()
        assert set(got) == {"path", *table} and all(v is not None for v in got.values()), name
    assert sum(map(len, headers.TABLES.values())) == 161
    assert not [k for k in keywords if k not in elements.TAGS and k not in ("SeriesComments", "PhaseEncodingDirection", "ActivityConcentrationScale", "SUVbw", "SUVlbm", "SUVbsa")]


def test_streams_of_one_name_go_on(spark, tmp_path, monkeypatch):
    source, name = f"{tmp_path}/in", "headers"
    monkeypatch.setattr(ingest, "_shared", lambda _, name: f"file://{tmp_path}/shared/{name}")
    shape = lambda rows: rows.select("k")
    spark.createDataFrame([(1,), (2,), (2,)], "k int").write.parquet(f"file://{source}")
    assert sorted(r.k for r in ingest.ingest_once(spark, f"file://{source}", shape, ["k"], name=name).collect()) == [1, 2]
    spark.createDataFrame([(2,), (3,)], "k int").write.mode("append").parquet(f"file://{source}")
    assert sorted(r.k for r in ingest.ingest_once(spark, f"file://{source}", shape, ["k"], name=name).collect()) == [1, 2, 3]
    written = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(f"file://{tmp_path}/shared")
    assert spark.read.parquet(f"file://{tmp_path}/shared/{name}/rows").count() == 3 and written.count() >= 2


def test_small_readings_of_nothing(spark):
    none = F.lit(None).cast("string")
    row = spark.range(1).select(misc.vendor(none).alias("a"), fingerprint.canonical_tracer(none).alias("b"), misc.echo_number(none).alias("c"), misc.size_bytes(F.lit("1.5 GiB")).alias("d"), misc.size_bytes(none).alias("e"), misc.mean_confidence(F.array().cast("array<double>")).alias("f")).first()
    assert row[:] == ("OTHER", None, None, 1610612736, None, 0.8)


def _best_fit(a, b):
    """Likeness by its definition: every cut of the longer text, subsequences by recursion."""
    import functools

    def common(x, y):
        @functools.cache
        def at(i, j):
            return 0 if i == len(x) or j == len(y) else 1 + at(i + 1, j + 1) if x[i] == y[j] else max(at(i + 1, j), at(i, j + 1))

        return at(0, 0)

    def one_way(s, t):
        n = len(s)
        cuts = [t[i : i + n] for i in range(len(t) - n + 1)] + [t[:i] for i in range(1, n)] + [t[-i:] for i in range(1, n)]
        return max(200 * common(s, c) / (n + len(c)) for c in cuts)

    short, long = sorted((a, b), key=len)
    return max(one_way(short, long), one_way(long, short) if len(a) == len(b) else 0)


def test_likeness_is_the_best_fit_of_all_cuts():
    texts = ["GE", "SIEMENS", "SIEMNS", "PHILLIPS MEDICAL", "G", "FLUORODEOXYGLUCOSE", "FLT", "WATER", "DOTATATE", "TAU", "UAT"]
    assert all(abs(fingerprint.likeness(a, b) - _best_fit(a, b)) < 1e-9 for a in texts for b in texts)


def test_names_become_canonical_by_parts_then_by_likeness(spark):
    names = {None: None, "": None, " ": None, "toshiba siemens": "CANON", "Siemens, formerly GE": "GE", "hitachi": "HITACHI", "SIEMNS": "SIEMENS", "phillips medical": "PHILIPS", "acme": "ACME", "q" * 300: "Q" * 300}
    rows = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, n string")
    assert [r.m for r in rows.select("i", fingerprint.manufacturer(F.col("n")).alias("m")).sort("i").collect()] == list(names.values())
    assert rows.limit(0).select(fingerprint.manufacturer(F.col("n"))).collect() == []


def test_contrast_duplicates_of_a_session(spark):
    look = ("T1w", "TSE", "Axial", 10.0, 500.0)
    rows = [
        (1, "a", 1, "d", 1, *look), (2, "b", 1, "d", 1, *look),  # alike, both after contrast
        (3, "c", 2, "d", 1, *look), (4, "e", 2, "d", 0, *look),  # before and after
        (5, "f", 3, "d", 1, *look), (6, "f", 3, "d", 1, *look), (7, "g", 3, "d", 1, *look),  # two of one series
        (8, "h", None, "d", 1, *look), (9, "i", None, "d", 1, *look), (10, "j", 4, None, 1, *look), (11, "k", 4, None, 1, *look),
        (12, "l", 5, "d", 0, None, None, None, None, None), (13, "m", 5, "d", 0, "", "", "", 0.0, 0.0), (14, "n", 5, "d", None, None, None, None, None, None),
        (15, None, 6, "d", 1, *look), (16, "o", 6, "d", 1, *look),
    ]
    schema = "series_stack_id int, series_instance_uid string, subject_id int, study_date string, post_contrast int, base string, technique string, stack_orientation string, mr_te double, mr_tr double"
    out = completion.contrast_duplicates(spark.createDataFrame(rows, schema)).collect()
    assert sorted(r.series_stack_id for r in out) == [1, 2, 12, 13]
    assert {r.signature for r in out} == {"T1w|TSE|Axial|10.0|500.0", "||||"}


def test_reasons_keep_order_and_come_once(spark):
    rows = spark.createDataFrame([(1, None, "MR", 0.2), (2, "z,a,a", "MR", None), (3, "", "CT", 0.1), (4, "orientation:low_confidence", "MR", 0.8499)], "i int, r string, m string, c double")
    doubt = completion.doubtful_orientation(F.col("m"), F.col("c"))
    out = rows.select("i", completion.completed_review(F.col("r"), **{"orientation:low_confidence": doubt}).alias("r")).sort("i").collect()
    assert [r.r for r in out] == ["orientation:low_confidence", "a,z", "", "orientation:low_confidence"]


def test_first_fit_decreasing(spark):
    rng = random.Random(4)
    rows = [(g, f"n{i:04}", rng.choice((rng.randrange(100), rng.randrange(60, 100), 0, None, 130))) for g in ("a", "b", None) for i in range(400 if g == "a" else 30)] + [("a", "n0000", 50), ("c", "only", 500), ("c", "nothing", None)]
    items = spark.createDataFrame(rows, "g string, n string, size int")
    packed = packing.pack_ffd(items, "g", "n", "size", 100)
    for g in ("a", "b", None, "c"):
        bins, want = [], []
        for _, n, s in sorted((r for r in rows if r[0] == g), key=lambda r: (-max(r[2] or 0, 0), r[1])):
            s = s or 0
            at = next((i for i, used in enumerate(bins) if used + s <= 100), len(bins))
            bins[at:at + 1] = [(bins[at] if at < len(bins) else 0) + s]
            want.append((n, s, at))
        assert sorted((r.n, r.size or 0, r.chunk) for r in packed.filter(F.col("g").eqNullSafe(F.lit(g))).collect()) == sorted(want)
    split = packing.pack_ffd(items, "g", "n", "size", 100, part_items=50)
    assert split.select("part").distinct().count() > 4 and split.count() == len(rows)
    plan = packing.chunk_plan(split, "g", "n", "size").filter("g = 'a'").collect()
    assert sorted(r.chunk_id for r in plan) == list(range(1, len(plan) + 1)) and sum(r.n_members for r in plan) == 401
    assert all(r.total_bytes <= 100 or sum(x[2] or 0 > 100 for x in rows if x[0] == "a" and x[1] in r.members) for r in plan)
    sizes = [r[2] or 0 for r in rows if r[0] == "a"]
    assert len(plan) <= 2 * sum(sizes) / 100 + sum(s > 100 for s in sizes) + 10
    assert packing.pack_ffd(items.limit(0), "g", "n", "size", 100).collect() == []


def test_explanations(spark):
    rows = spark.createDataFrame([(i, *PROTOCOLS[i], 1.0, 20) for i in (0, 3, 4, 6, 11, 16, 17, 21)], f"i int, {FIELDS}, aspect double, n_instances int")
    out = {r.i: r for r in rules.explain(rows, ["i"]).collect()}
    assert (out[0].technique_rule, out[0].technique_tier, out[0].base_method, out[0].base_override, out[0].branch_output) == ("MPRAGE", "exclusive", "technique", "(none)", None)
    assert (out[4].branch, out[4].branch_output, out[4].base_override, out[4].construct_override, out[4].branch_confidence) == ("swi", "swi:MinIP", "SWI", "MinIP", 0.95)
    assert (out[3].provenance, out[3].provenance_tier, out[3].provenance_evidence) == ("SWIRecon", "exclusive", "is_swi")
    assert (out[6].provenance_tier, out[6].provenance_evidence, out[6].construct_override, out[6].base_override) == ("keywords", "symri", "T1map", None)
    assert out[11].excluded == "secondary_reformat" and all(v is None for n, v in out[11].asDict().items() if n not in ("i", "excluded"))
    assert (out[16].base_method, out[16].detected_base) == ("physics", "T1w")
    assert out[17].technique_conflict == "GRE" and out[17].detected_base == "T2*w"
    assert (out[21].provenance, out[21].provenance_tier, out[21].provenance_evidence, out[21].technique_rule, out[21].base_method) == ("RawRecon", "default", None, "UNKNOWN", None)
    assert rules.explain(rows.limit(0), ["i"]).collect() == []


def test_rows_that_cannot_be_read_are_kept(spark):
    text = spark.createDataFrame([(1, "90", "t2 tse"), (2, "ninety", "t2 tse"), (3, None, None), (4, "NaN", "swi")], "i int, te string, text string")
    text = text.withColumns({c: F.lit(None).cast("string") for c in rules.INPUTS if c not in text.columns}).withColumns({"aspect": F.lit("1.0"), "n_instances": F.lit("x")})
    out = {r.i: r for r in rules.classify_captured(text.withColumn("n_instances", F.when(F.col("i") == 3, "x")), ["i"]).collect()}
    assert [out[i].error for i in (1, 2, 3, 4)] == [None, "no number in te", "no number in n_instances", "no number in te"]
    assert [(out[i].intent, out[i].review_reasons, out[i].technique) for i in (2, 3, 4)] == [("misc", rules.ERROR, None)] * 3 and out[1].technique == "TSE"


def test_merged_streams_survive_a_crash(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(merge, "_shared", lambda _, name: f"file://{tmp_path}/{name}")
    schema = "sop_uid string, series_uid string, study_uid string, subject_code string, patient_id string, file_path string, arrival long, size string"
    batches = [
        [("i1", "e1", "t1", "S1", "P1", "a", 1, "x"), ("i1", "e1", "t1", "S1", "P1", "b", 2, "x"), ("i2", "e1", "t1", "S1", "P1", "c", 3, None), (None, "e1", "t1", "S1", "P1", "d", 4, None)],
        [("i1", "e9", "t9", "S9", "P9", "e", 5, "y"), ("i3", "e1", "t1", "S2", "P1", "f", 6, None), ("i4", None, None, None, None, "g", 7, None)],
        [("i5", "e1", "t1", "S1", "P2", "h", 8, None), ("i5", "e1", "t1", "S1", "P2", "h", 8, None), ("i2", "e1", "t1", "S1", "P1", "z", 9, "late")],
    ]
    shape = lambda rows: rows.select("*")
    for policy in (merge.SKIP, merge.OVERWRITE, merge.APPEND_SERIES):
        folder = f"file://{tmp_path}/in-{policy}"
        for i, rows in enumerate(batches):
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
            if i == 1:  # the batch fails after some of its tables are written, and is run again
                with monkeypatch.context() as broken:
                    write = merge.Merge._write
                    broken.setattr(merge.Merge, "_write", lambda self, rows, table, batch, write=write: (_ for _ in ()).throw(OSError("lost")) if table == "series" else write(self, rows, table, batch))
                    with pytest.raises(Exception, match="lost"):
                        merge.merge_stream(spark, folder, shape, f"s-{policy}", policy)
            stream = merge.merge_stream(spark, folder, shape, f"s-{policy}", policy)
        at_once = merge.Merge(f"file://{tmp_path}/once-{policy}", policy)
        at_once.apply(spark.createDataFrame([r for b in batches for r in b], schema), 0)
        key = lambda m: [sorted(map(str, df.collect())) for df in (m.instances(spark), m.conflicts(spark), *(m.parents(spark, s) for s in merge.LINKS), *(m.compacted(spark, s) for s in merge.LINKS))]
        compared = slice(0, 1) if policy == merge.OVERWRITE else slice(None)  # rows that were replaced later had parents, too
        assert key(stream)[compared] == key(at_once)[compared], policy
        kept = {r.sop_uid: r.file_path for r in stream.instances(spark).collect()}
        assert kept == ({"i1": "e", "i2": "z", "i3": "f", "i4": "g", "i5": "h"} if policy == merge.OVERWRITE else {"i1": "a", "i2": "c", "i3": "f", "i4": "g", "i5": "h"})
        found = sorted((r.scope, r.uid) for r in stream.conflicts(spark).collect())
        if policy != merge.OVERWRITE:
            assert found == [("instance", "i1"), ("instance", "i2"), ("series", "e1"), ("study", "t1"), ("subject_identifier", "S1")]
            assert {r.uid for r in stream.parents(spark, "study").collect()} == {"t1"}  # t9 has no accepted instance: no orphan
            assert [(r.subject_code, r.conflict) for r in stream.parents(spark, "study").collect()] == [("S1", True)]


def test_manifests_are_committed_at_once(spark, tmp_path):
    rows = spark.createDataFrame([(i, f'a "{i}", b\nc', None if i % 3 else "x") for i in range(40)], "i int, t string, o string")
    for run in ("a", "b"):
        manifest.write_manifest(rows.repartition(3, "i"), f"file://{tmp_path}/{run}", ["i"])
    lines = (tmp_path / "a" / "MANIFEST.csv").read_text()
    assert lines == (tmp_path / "b" / "MANIFEST.csv").read_text() and sum(r.rows for r in manifest.manifest(spark, f"file://{tmp_path}/a").collect()) == 40
    assert {r.intact for r in manifest.verified(spark, f"file://{tmp_path}/a").collect()} == {True}
    back = manifest.read_parts(spark, f"file://{tmp_path}/a", "i int, t string, o string")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.collect()))
    part = next(p for p in (tmp_path / "b").iterdir() if p.name.startswith("part-"))
    part.write_text(part.read_text() + "x")
    assert sorted(r.intact for r in manifest.verified(spark, f"file://{tmp_path}/b").collect()).count(False) == 1
    fails = rows.repartition(3, "i").withColumn("t", F.when(F.col("i") == 17, F.raise_error(F.lit("broken"))).otherwise(F.col("t")))
    with pytest.raises(Exception, match="broken"):
        manifest.write_manifest(fails, f"file://{tmp_path}/c", ["i"])
    left = list((tmp_path / "c").iterdir()) if (tmp_path / "c").exists() else []
    assert not left
    manifest.write_manifest(rows.limit(0), f"file://{tmp_path}/d", ["i"])
    assert (tmp_path / "d" / "MANIFEST.csv").read_text() == "part,rows,bytes,sha256\n" and manifest.read_parts(spark, f"file://{tmp_path}/d", "i int").count() == 0


def test_resume_renames_and_flows_on_awkward_rows(spark):
    files = spark.createDataFrame([("a", "a/1", "o/1", None), ("a", "a/2", "o/2", "t1"), ("a", "a/3", "o/3", "t9"), ("b", "b/1", "o/4", "t2"), ("b", "b/1", "o/4", "t2"), (None, "c", "o/5", None)], "leaf string, path string, output string, study_uid string")
    done = spark.createDataFrame([("t1",), (None,)], "study_uid string")
    there = spark.createDataFrame([("o/3",), ("o/3",)], "path string")
    got = sorted(((r.path, r.study_uid, r.audit_done, r.mode) for r in resume.leaf_modes(files, done, there).collect()))
    assert got == [("a/1", None, False, "full"), ("a/2", "t1", True, "output_only"), ("a/3", "t1", True, "skip"), ("b/1", "t2", False, "full"), ("b/1", "t2", False, "full"), ("c", None, False, "full")]
    folders = spark.createDataFrame([("P1",), ("P1/P1_P2",), ("P2",), ("x",), ("P10",), (None,), ("P1",), ("u/P1",), ("u/Q1",)], "path string")
    mapping = spark.createDataFrame([("P1", "Q1"), ("P10", "Z"), ("Q1", "R1"), ("", "x"), ("P2", "P2"), (None, "n"), ("P1", "Y")], "old string, new string")
    plan = resume.rename_plan(folders, mapping)
    assert sorted((r.path, r.new_name, r.status) for r in plan.collect()) == [("P1", "R1", "rename"), ("P1/P1_P2", "R1_P2", "rename"), ("P10", "Z", "rename"), ("u/P1", "R1", "rename"), ("u/Q1", "R1", "target exists")]
    paths = spark.createDataFrame([("P1/P1_P2/f",), ("f",), ("u/Q1/f",)], "path string")
    assert sorted(map(tuple, resume.renamed_paths(paths, plan).collect())) == [("P1/P1_P2/f", "R1/R1_P2/f"), ("f", "f"), ("u/Q1/f", "u/Q1/f")]
    assert resume.rename_plan(folders, mapping.limit(0)).collect() == [] and resume.rename_plan(folders.limit(0), mapping).collect() == []
    events = spark.createDataFrame([(1, 1, 1, "confirmed"), (1, 2, 2, "reviewed"), (1, 3, 3, "pending"), (1, 3, 4, "reviewed"), (2, 1, 1, "odd"), (2, None, 2, "reviewed"), (None, 1, 1, "reviewed"), (3, 1, 1, "skipped"), (3, 1, 1, "skipped")], "item_id int, at int, seq int, status string")
    out = {r.item_id: r for r in flow.item_status(events).collect()}
    assert out[1][1:] == ("reviewed", 3, 1, 4, "confirmed>reviewed") and out[2][1:] == ("pending", None, None, 1, "pending>odd") and out[3][1:] == ("skipped", None, None, 2, "")
    cache = spark.createDataFrame([(1, "T1w", 0, 1), (2, "T1w", 0, 1), (3, "T1w", 0, 1)], "series_id int, base string, localizer int, review_required int")
    drafts = spark.createDataFrame([(1, "localizer", "x"), (1, "base", None), (2, "other", "y")], "series_id int, field string, new_value string")
    assert sorted(map(tuple, flow.confirm_item_changes(cache, drafts, ("base", "localizer")).collect())) == [(1, None, None, 0), (2, "T1w", 0, 1), (3, "T1w", 0, 1)]


def test_imports_of_awkward_rows(spark):
    codes = lambda *rows: spark.createDataFrame(list(rows), "p string, s string")
    assert sorted(map(tuple, imports.subject_codes(codes((" a ", "1"), ("a", "1 "), (None, " "), ("b", "2")), "p", "s").collect())) == [("a", "1"), ("b", "2")]
    for rows, says in (([("a", "1"), ("a", "2")], "conflicting"), ([("a", None)], "without a subject code"), ([(None, "1")], "no patient id"), ([("a", "1"), ("a", " ")], "without")):
        with pytest.raises(ValueError, match=says):
            imports.subject_codes(codes(*rows), "p", "s")
    types = spark.createDataFrame([(4, "Site", None)], "id long, name string, description string")
    new = spark.createDataFrame([(" site ", "x"), ("Code", None), ("code", "y"), ("  ", None), (None, None)], "name string, description string")
    after, refused = imports.create_id_types(types, new)
    assert sorted(map(tuple, after.collect())) == [(4, "Site", None), (5, "Code", None)]
    assert sorted(((r.name, r.reason) for r in refused.collect()), key=str) == [("Code", "name comes twice"), ("site", "name exists"), (None, "name is blank"), (None, "name is blank")]
    used = spark.createDataFrame([(4,), (4,), (None,)], "id_type_id long")
    assert sorted((r.id, r.identifiers_count) for r in imports.list_id_types(after, used).collect()) == [(4, 2), (5, 0)]
    rows = spark.createDataFrame([("1", "['A, b', \"c\"]", "[x, 2]"), ("1", "nan", "3"), ("", "z", "9"), ("x", "null", "1e30")], "`Instance_Id ` string, image_type string, echo_train_length string")
    values = imports.instance_values(rows)
    assert sorted(map(tuple, values.collect()), key=str) == [(1, "A, b\\c", 2), (1, None, 3), (None, None, None)]
    old = spark.createDataFrame([(1, "o", 8), (2, "o", 8)], "instance_id long, image_type string, echo_train_length long")
    out, counts = imports.update_instances(old, values)
    assert sorted(map(tuple, out.collect())) == [(1, "A, b\\c", 2), (2, "o", 8)] and tuple(counts.first()) == (3, 1)
    with pytest.raises(ValueError):
        imports.instance_values(rows.select("image_type"))
    cohorts = spark.createDataFrame([(3, "lund", "o", "/p", None, False)], "cohort_id long, name string, owner string, path string, description string, is_active boolean")
    more = spark.createDataFrame([(" LUND", "n", "/q", " ", None), ("Umea", "n", "/u", "d", None), ("none", None, "/x", None, True), (" ", "n", "/x", None, True)], "name string, owner string, path string, description string, is_active boolean")
    assert sorted(map(tuple, imports.upsert_cohorts(cohorts, more).collect())) == [(3, "lund", "n", "/q", None, False), (4, "umea", "n", "/u", "d", True)]


def test_stacks_keep_their_indices(spark):
    fields = {**stacks.SIGNATURE}
    schema = "series_id int, sop_uid string, " + ", ".join(f"{c} {'double' if d is not None else 'string'}" for c, d in fields.items())
    blank = dict.fromkeys(fields)
    row = lambda series, sop, **k: (series, sop, *({**blank, **k}.values()))
    first = spark.createDataFrame([row(1, "b", echo_time=10.001), row(1, "c", echo_time=10.004), row(1, "d", echo_time=20.0), row(None, "e")], schema)
    known = stacks.ensure_stacks(first)
    assert sorted((r.series_id or 0, r.stack_index, r.n_instances) for r in known.collect()) == [(0, 0, 1), (1, 0, 2), (1, 1, 1)]
    second = spark.createDataFrame([row(1, "a", echo_time=5.0), row(1, "x", echo_time=20.004), row(2, "y", image_type="M"), row(2, "z", image_type=None)], schema)
    both = {(r.series_id or 0, r.stack_index): (r.echo_time, r.n_instances, r.is_new) for r in stacks.ensure_stacks(second, known).collect()}
    assert both == {(0, 0): (None, 0, False), (1, 0): (10.0, 0, False), (1, 1): (20.0, 1, False), (1, 2): (5.0, 1, True), (2, 0): (None, 1, True), (2, 1): (None, 1, True)}
    gap = known.withColumn("stack_index", F.col("stack_index") * 5)
    assert {r.stack_index for r in stacks.ensure_stacks(second, gap).filter("series_id = 1").collect()} == {0, 5, 6}
    assert stacks.ensure_stacks(first.limit(0)).collect() == []
    keys = {r.series_id: r.stack_key for r in stacks.stack_key(stacks.ensure_stacks(second, known)).collect()}
    assert (keys[1], keys[2], keys[None]) == ("multi_echo", "image_type_variation", None)


def test_worklist_filters(spark):
    reasons = ["base:low_confidence,base:missing", "technique:conflict", "contrast:low", None, "Base:missing"]
    df = spark.createDataFrame([(r,) for r in reasons], "r string")
    csv = F.col("r")
    pick = lambda c: [bool(x[0]) for x in df.select(c).collect()]
    assert pick(qc.has_flag(csv, "base", "missing")) == [True, False, False, False, False] and pick(qc.has_flag(csv)) == [True, True, False, False, False]
    assert pick(qc.worth_a_look(F.lit("localizer"), csv)) == [True, True, False, False, False] and pick(qc.worth_a_look(F.lit(None).cast("string"), csv)) == [True, True, False, False, False]
    assert pick(qc.worth_a_look(F.lit("anat"), csv)) == [True] * 5


def test_deidentification_events(spark):
    assert len(identity.scrub_list()) == 121 and identity.scrub_list(("Institution_Information", "none")) == ["0008,0016", "0008,0018", "0008,0080", "0008,0081", "0008,1010", "0008,1040", "0008,1041"]
    tags = [("a", "0010,0020", "PatientID", " P1 "), ("a", "0008,0020", "StudyDate", "20200101"), ("b", "0010,0020", "PatientID", "P1"), ("b", "0008,0020", "StudyDate", "20200702"), ("b", "0008,1010", "StationName", None), ("c", "0008,0020", "StudyDate", "2020"), ("c", "0008,0080", None, "x"), ("d", "0010,0020", "PatientID", ""), ("e", "9999,0000", "Other", "x")]
    df = spark.createDataFrame(tags, "path string, tag string, name string, value string")
    ids = spark.createDataFrame([("P1", "S1"), ("P2", None)], "old_id string, new_id string")
    out = sorted((r.path, r.tag, r.action, r.old_value, r.new_value) for r in identity.audit_events(df, ids).collect())
    assert out == [("a", "0008,0020", "replaced", "20200101", "M00"), ("a", "0010,0020", "replaced", "P1", "S1"), ("b", "0008,0020", "replaced", "20200702", "M06"), ("b", "0008,1010", "removed", "", ""), ("b", "0010,0020", "replaced", "P1", "S1"), ("c", "0008,0020", "retained", "2020", ""), ("c", "0008,0080", "removed", "x", "")]
    off = identity.audit_events(df, ids.limit(0), (), timepoints=False).collect()
    assert {(r.tag, r.action) for r in off} == {("0008,0020", "retained")} and identity.audit_events(df.limit(0), ids).collect() == []


def test_sources_and_searched_subjects(spark):
    stacks = spark.createDataFrame([(1, "a/x"), (2, "b/x"), (3, "c/x"), (4, "/z/x"), (5, None), (6, ""), (7, "b/x"), (8, "solo")], "id int, path string")
    listing = spark.createDataFrame([("/r/a/x",), ("/r/sub-a/x",), ("/r/sub-b/x",), ("/r/sub-b/x",), ("/r/sub-solo",), (None,)], "path string")
    got = {r.id: (r.source, r.found) for r in export.resolved_sources(stacks, listing, "/r").collect()}
    assert got == {1: ("/r/a/x", True), 2: ("/r/sub-b/x", True), 3: ("/r/c/x", False), 4: ("/z/x", False), 5: (None, False), 6: ("/r", False), 7: ("/r/sub-b/x", True), 8: ("/r/sub-solo", True)}
    assert export.resolved_sources(stacks.limit(0), listing.limit(0), "/r").count() == 0
    subjects = spark.createDataFrame([(1, "Abc"), (12, "xyz"), (3, None)], "subject_id int, subject_code string")
    others = spark.createDataFrame([(3, "ABC-9"), (3, "abc"), (12, None), (None, "abc")], "subject_id int, value string")
    found = lambda text: sorted(r.subject_id for r in explore.found_subjects(subjects, others, text).collect())
    assert found("abc") == [1, 3] and found("1") == [1, 12] and found("a_c-%9") == [3] and found("") == [1, 3, 12] and found("q") == []
