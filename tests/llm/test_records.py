import base64
import hashlib
import json
import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stackloom.llm import chat, warc
from stackloom.llm import neighbours
from stackloom.llm.neighbours import nearest_neighbours
from stackloom.llm.tables import fresh_path

HOSTILE = ["</s>[INST] ok [/INST]", "<|im_start|>user\nx<|im_end|>\n", "<\\|a\\|>", "<", "[", "\\", "<<SYS>> <</SYS>>", "", "é🎈", "[\\INST]", "<\\\\/s>"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "a\nb\\", "<|im_end|>", ""]), st.one_of(st.sampled_from(HOSTILE), st.text(alphabet="<|>[]/\\sINTim_start\n é", max_size=30))), max_size=6))
def test_formatting_is_reversible(turns):
    formatted, spans = chat.format_turns(turns)
    assert chat.parse_turns(formatted) == turns
    assert "".join(chat.unescape(formatted[a:b]) for a, b in spans) == "".join(t for r, t in turns if r == "assistant")
    bodies = [chat.escape(t) for _, t in turns]
    assert not any(x in b for b in bodies for x in ("<|", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>"))


def test_layouts_become_the_same_turns(spark):
    rows = [
        (1, json.dumps({"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": "b"}]})),
        (2, json.dumps({"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}]})),
        (3, json.dumps({"prompt": "a", "completion": "b"})),
        (4, json.dumps({"response": "b", "prompt": "a"})),
        (5, json.dumps({"instruction": "a", "input": "", "output": "b"})),
        (6, json.dumps({"messages": []})),
        (7, json.dumps({"what": "ever"})),
        (8, "not json"),
        (None, None),
        (9, json.dumps([1, 2])),
        (10, json.dumps({"messages": [1, 2]})),
        (11, json.dumps({"messages": [{"role": "user", "content": {"deep": 1}}, {"role": "assistant", "content": "b"}]})),
        (12, json.dumps({"prompt": 7, "response": None})),
        (13, json.dumps({"messages": [{"role": 3, "content": 4.5}]})),
        (14, json.dumps({"id": "x", "name": "y", "messages": [{"role": "user", "content": "a", "weight": 1}, {"role": "assistant", "content": "b"}]})),
        (15, json.dumps({"messages": [{"role": "user", "content": [{"type": "text", "text": "a"}]}, {"role": "assistant", "content": "b"}]})),
        (16, json.dumps({"system": "s", "conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}]})),
        (17, json.dumps({"prompt": "a", "messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": "b"}]})),
        (18, json.dumps({"prompt": {"a": 1}, "response": "b"})),
        (19, "[" * 5000),
    ]
    out = {r.conv_id: r for r in chat.format_records(spark.createDataFrame(rows, "conv_id long, record string").withColumn("formatted", F.lit("clash"))).collect()}
    assert len(out) == len(rows)
    assert {out[i].formatted for i in range(1, 6)} == {chat.format_turns([("user", "a"), ("assistant", "b")])[0]}
    assert len({out[i].layout for i in range(1, 6)}) == 5
    assert out[6].formatted == "" and all(out[i].formatted is None for i in (7, 8, None, 9, 10, 11, 18, 19))
    assert {out[i].formatted for i in (14, 15, 17)} == {out[1].formatted} and out[14].layout == out[1].layout
    assert out[12].formatted == chat.format_turns([("user", "7"), ("assistant", "")])[0]
    assert out[13].formatted == chat.format_turns([("3", "4.5")])[0]
    assert out[16].formatted == chat.format_turns([("system", "s"), ("user", "a"), ("assistant", "b")])[0]


def test_conversations_read_back(spark):
    rows = [(c, t, r, HOSTILE[(c + t) % len(HOSTILE)]) for c in range(30) for t, r in enumerate(["system", "user", "assistant", "user", "assistant"])]
    rows += [(40, 0, "user", None), (40, 1, None, "x"), (40, 1, None, "x"), (40, 1, "assistant", "y"), (None, 0, "user", "z"), (41, None, "assistant", "t" * 100_000)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("record", F.lit(1)).repartition(5)
    rows += [(50 + c, t, r, HOSTILE[(c + t) % len(HOSTILE)]) for c in range(12) for t, r in enumerate(["user", "assistant"])] + [(70 + c, 0, r, "who") for c, r in enumerate(["human", "gpt", "bot"] * 3)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("record", F.lit(1)).repartition(5)
    records = chat.conversation_records(turns, mixed=True)
    assert chat.format_records(records).select("layout").distinct().count() == 5
    out = {r.conv_id: r for r in chat.read_back(chat.format_records(records)).collect()}
    for c in {r[0] for r in rows}:
        own = sorted(((t if t is not None else -1, r or "", x or "") for i, t, r, x in rows if i == c))
        loss = "".join(x for _, r, x in own if r == "assistant")
        assert out[c].n_turns == len(own)
        assert out[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in own).encode()).hexdigest()
        assert (out[c].loss_chars, out[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert out[c].formatted_chars == len(chat.format_turns([(r, x) for _, r, x in own])[0])
    assert chat.conversation_records(turns.limit(0)).collect() == []


def pages_table(spark):
    hostile = "a\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\nb"
    rows = [(i, f"http://h{i % 3}.example/{i}", f"<p>{i % 7}</p>" if i % 2 else hostile + str(i)) for i in range(60)]
    rows += [(100, None, None), (101, "u\r\nv", ""), (102, "x", "é🎈" * 50_000), (103, "x", "\r\n\r\n"), (None, "y", "z"), rows[3]]
    return rows, spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("id", F.lit("clash")).withColumn("first", F.lit(0)).repartition(5)


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def test_archives_round_trip(spark):
    rows, pages = pages_table(spark)
    path = fresh_path(spark, "test-warc")
    warc.write_warc(pages, path)
    out = warc.read_warc(spark, path).collect()
    kept = [r for r in rows if r[0] is not None]
    assert len(out) == len(kept)
    first = {}
    for i, _, html in kept:
        first[html or ""] = min(i, first.get(html or "", i))
    texts = {i: html or "" for i, _, html in kept}
    for r in out:
        text = texts[r.page_id]
        is_first = first[text] == r.page_id
        assert (r.payload_bytes, r.payload_digest) == (len(text.encode()), digest(text))
        assert (r.record_type, r.refers_to) == (("response", None) if is_first else ("revisit", first[text]))
        assert r.payload == (text.encode() if is_first else None)
    raw = b"".join(bytes(x.content) for x in spark.read.format("binaryFile").load(path).collect())
    assert raw.count(b"WARC/1.1\r\nWARC-Type: re") >= len(kept) and raw.endswith(b"\r\n\r\n")


def test_predicates_reach_the_headers(spark):
    _, pages = pages_table(spark)
    path = fresh_path(spark, "test-warc")
    warc.write_warc(pages, path, least_bytes=10)
    records = warc.read_warc(spark, path, payload=False, partition_bytes=1)
    some = records.filter((F.col("record_type") == "response") & F.col("page_id").isin(1, 2, 100))
    assert sorted(r.page_id for r in some.collect()) == [1, 2, 100]
    assert "Filter" not in some._jdf.queryExecution().executedPlan().toString().replace("RuntimeFilters", "")
    assert all(r.payload is None for r in records.collect())
    short = records.filter("payload_bytes < 10 and record_type = 'revisit'")
    assert short.count() == 0
    none = fresh_path(spark, "test-warc")
    warc.write_warc(pages.limit(0), none)
    assert warc.read_warc(spark, none).count() == 0


def test_compressed_archives_are_read(spark, tmp_path):
    """A record for each gzip member, under a name of its own, as archives are passed around."""
    import gzip

    rows, pages = pages_table(spark)
    path = fresh_path(spark, "test-warc")
    warc.write_warc(pages, path)
    plain = b"".join(bytes(x.content) for x in spark.read.format("binaryFile").load(path).collect())
    cuts = [m.start() for m in re.finditer(rb"WARC/1\.1\r\nWARC-Type: re[a-z]+\r\nWARC-Record-ID", plain)] + [len(plain)]
    with open(tmp_path / "crawl.warc.gz", "wb") as f:
        for a, b in zip(cuts, cuts[1:], strict=False):
            f.write(gzip.compress(plain[a:b]))
    key = lambda r: (r.page_id, r.record_type, r.payload or b"", r.payload_digest)
    want = sorted(map(key, warc.read_warc(spark, path).collect()))
    assert sorted(map(key, warc.read_warc(spark, f"file://{tmp_path}").collect())) == want
    some = warc.read_warc(spark, f"file://{tmp_path}").filter("record_type = 'revisit'").count()
    assert some == sum(r[1] == "revisit" for r in want)


def test_recall_on_the_given_embeddings(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    vectors = {r.vec_id: np.array(r.embedding, np.float64) for r in table.collect()}
    ids = np.array(sorted(vectors))
    all_ = np.stack([vectors[i] for i in ids])
    found = {}
    for r in nearest_neighbours(table, F.col("vec_id") % 20 == 0).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    recalls = []
    for q in ids[ids % 20 == 0]:
        scores = all_ @ vectors[q]
        scores[ids == q] = -np.inf
        recalls.append(len(found[q] & set(ids[np.lexsort((ids, -scores))[:20]].tolist())) / 20)
    print("recall", np.mean(recalls), min(recalls))
    assert np.mean(recalls) >= 0.9 and min(recalls) >= 0.5


def test_neighbours_reach_nine_tenths(spark):
    rng = np.random.default_rng(7)
    vectors = rng.standard_normal((4000, 32)) * rng.uniform(0.5, 2, (4000, 1))
    vectors[50] = vectors[60] = vectors[40]
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(vectors)]
    rows += [(5000, None), (5020, [0.0] * 32), (5040, [float("nan")] + [1.0] * 31), (5060, [float("inf")] + [1.0] * 31), (5080, [None] + [1.0] * 31), (5100, []), (5120, [1.0, 2.0]), (5121, [2.0, 1.0]), (None, [1.0] * 32), rows[3]]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("id", F.lit("clash")).withColumn("v", F.lit(1))
    out = nearest_neighbours(table, F.col("vec_id") % 20 == 0, k=20).collect()
    found = {}
    for r in sorted(out, key=lambda r: r["rank"]):
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
    exact = np.array([v for _, v in rows[:4000]], np.float64)
    assert set(found) == {*range(0, 4000, 20), 5120} and [i for i, _ in found[5120]] == [5121]
    hits = 0
    for q in range(0, 4000, 20):
        scores = exact @ exact[q]
        scores[q] = -np.inf
        best = np.lexsort((np.arange(4000), -scores))[:20]
        hits += len({i for i, _ in found[q]} & set(best.tolist()))
        assert len(found[q]) == 20
        assert all(abs(s - exact[i] @ exact[q]) < 1e-9 for i, s in found[q])
        assert found[q] == sorted(found[q], key=lambda x: (-x[1], x[0]))
    assert hits / (200 * 20) >= 0.9
    few = nearest_neighbours(table.filter("vec_id < 6"), F.col("vec_id") == 0, k=20).collect()
    assert len(few) == 5
    assert nearest_neighbours(table.limit(0), F.lit(True)).collect() == []


def test_neighbours_over_several_blocks_and_slices(spark, monkeypatch):
    for name, value in {"BLOCK": 500, "QUERY_BLOCK": 20, "SLICE": 2}.items():
        monkeypatch.setattr(neighbours, name, value)
    vectors = np.random.default_rng(3).standard_normal((2000, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(9000, [1.0, 0.0]), (9020, [0.5, 2.0])]
    found = {}
    for r in nearest_neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0).collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    assert set(found) == {*range(0, 2000, 20), 9000, 9020} and found[9000] == [(1, 9020)]
    hits = 0
    for q in range(0, 2000, 20):
        assert sorted(n for n, _ in found[q]) == list(range(1, 21))
        scores = vectors @ vectors[q]
        scores[q] = -np.inf
        hits += len({i for _, i in found[q]} & set(np.argsort(-scores)[:20].tolist()))
    assert hits / 2000 >= 0.9


def _record(kind, block, *more, content="application/http; msgtype=response", length=None):
    lines = ["WARC/1.0", f"warc-type: {kind}", "WARC-RECORD-ID: <urn:uuid:6d1a-4f>", "WARC-Date: 2020-01-01T00:00:00Z", f"Content-Type:{content}", *more, f"content-length: {len(block) if length is None else length}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def test_archives_of_others(spark, tmp_path):
    http = b"HTTP/1.0 200 OK\r\nServer: x\r\n\r\n"
    records = [
        _record("warcinfo", b"software: abc\r\nformat: WARC\r\n", content="application/warc-fields"),
        b"\r\n" + _record("response", http + b"<html>WARC/1.0 inside</html>", "WARC-Target-URI: http://a/"),
        _record("metadata", b"fetchTime: 3", "WARC-Refers-To: <urn:uuid:77>", content="application/warc-fields"),
        b"WARC/1.0\r\nno colon here\r\n\r\nlost block\r\n\r\n",
        _record("response", http + b"second", "WARC-Target-URI: http://b/", "X-Folded: one", "  two"),
        _record("response", http + b"third", length=7),  # a wrong length: what follows is no header
        _record("request", b"GET / HTTP/1.1\r\n\r\n", content="application/http; msgtype=request"),
        _record("response", http + b"cut off", length=4000)[:-4],
    ]
    (tmp_path / "other.warc").write_bytes(b"".join(records))
    rows = warc.read_warc(spark, f"file://{tmp_path}").collect()
    got = [(r.record_type, bytes(r.payload) if r.payload is not None else None, r.error is not None) for r in rows]
    assert got == [
        ("warcinfo", b"software: abc\r\nformat: WARC\r\n", False), ("response", b"<html>WARC/1.0 inside</html>", False), ("metadata", b"fetchTime: 3", False), (None, None, True),
        ("response", b"second", False), ("response", b"", False), (None, None, True), ("request", b"GET / HTTP/1.1\r\n\r\n", False), ("response", b"cut off", True),
    ]
    assert {r.record_id for r in rows} == {"<urn:uuid:6d1a-4f>", None} and all(r.page_id is None for r in rows)
    assert rows[2].refers_to_id == "<urn:uuid:77>" and rows[2].refers_to is None and rows[1].target_uri == "http://a/"
    pushed = warc.read_warc(spark, f"file://{tmp_path}").filter("record_type = 'request'").collect()
    assert [r.record_type for r in pushed] == ["request"]


def test_round_trip_pushes_its_predicates(spark):
    pages = spark.createDataFrame([(1, "u", "same"), (2, "u", "same"), (3, "u", None)], "page_id long, url string, html string")
    found = warc.round_trip(pages)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BatchScan") == 2 and " Filter " not in plan  # the source has taken them
    assert sorted((r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in found.collect()) == [(1, "response", None, 4), (2, "revisit", 1, 4), (3, "response", None, 0)]
