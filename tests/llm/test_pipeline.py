import random

import corpus_pipeline as P
from stackloom.llm.tables import materialize
from tests.llm.helpers import brute_components, prose


def planted(spark, path):
    rng = random.Random(21)
    common = {"en": ["the", "and", "with", "from", "house", "water"], "fr": ["le", "une", "avec", "maison", "dans", "être"]}
    text = lambda lang, n: " ".join(rng.choice(common[lang]) + rng.choice(["", "", str(rng.randrange(90))]) for _ in range(n))
    rows = [(i, text("en" if i % 3 else "fr", 60), "en" if i % 3 else "fr", f"s{i % 4}") for i in range(300)]
    item = prose(rng, 40, 2000)
    rows += [(400 + i, rows[i][1], "en", "s0") for i in range(30)]
    rows += [(500 + i, text("en", 30) + " " + item + " " + text("en", 10), "en", "s1") for i in range(10)]
    rows += [(600, None, None, None), (601, "", "en", "s0"), (602, "12 34 ... !!", "en", "s0"), (None, text("en", 20), "en", "s0")]
    spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return rows


def test_stages_on_planted_rows(spark, tmp_path):
    rows = planted(spark, f"file://{tmp_path}")
    docs, kept = spark.read.parquet(f"file://{tmp_path}/documents.parquet"), {}
    columns = docs.columns
    for name, stage in P.STAGES:
        docs = materialize(stage(spark, docs, f"file://{tmp_path}"), name)
        kept[name] = docs
        if name != "shard":
            assert docs.columns == columns
    ids = lambda name: [r.doc_id for r in kept[name].select("doc_id").collect()]
    assert sorted(ids("language_id")) == sorted(i for i, *_ in rows if i is not None and i not in (600, 601, 602))
    groups = brute_components([r for r in rows if r[0] in set(ids("language_id"))], 5)
    assert sorted(ids("near_dedup")) == sorted(i for i, g in groups.items() if g[2])
    assert not set(ids("near_dedup")) & set(range(400, 430))
    assert sorted(ids("decontaminate")) == sorted(i for i in ids("near_dedup") if not 500 <= i < 510)
    assert set(ids("mix")) <= set(ids("decontaminate")) and len(ids("mix")) > 250
    assert sorted(ids("shard")) == sorted(ids("mix"))
    assert P.run(spark, f"file://{tmp_path}").count() == len(ids("mix"))


def test_empty_documents(spark, tmp_path):
    planted(spark, f"file://{tmp_path}")
    empty = spark.read.parquet(f"file://{tmp_path}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        empty = stage(spark, empty, f"file://{tmp_path}") if "text" in empty.columns else empty
        assert empty.count() == 0


def repeated(spark, path):
    """Rows that repeat an id and their text, ids that stand for two texts, rows without an id."""
    rng = random.Random(22)
    item = prose(rng, 40, 2000)
    twice = [(i, prose(rng, 50, 3000), "en", f"s{i % 2}") for i in range(40)]
    rows = twice + twice + [(0, twice[1][1], "en", "s0"), (None, twice[2][1], "en", "s0")]
    rows += [(100 + i, prose(rng, 50, 3000), "en", "s2") for i in range(5)]
    rows += [(100 + i, prose(rng, 10, 3000) + " " + item, "en", "s2") for i in range(5)]
    rows += [(None, prose(rng, 50, 3000), "en", "s2") for _ in range(5)]
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return rows, item, spark.createDataFrame([(*r, len(r[1])) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")


def test_stages_decide_on_rows(spark, tmp_path):
    path = f"file://{tmp_path}"
    rows, item, docs = repeated(spark, path)
    own = lambda df: sorted(((r.doc_id if r.doc_id is not None else -1, r.text) for r in df.collect()))
    pairs = [(i if i is not None else -1, t) for i, t, *_ in rows]
    junk = docs.limit(1).selectExpr("100L doc_id", "'12 34' text", "lang", "source", "n_chars")
    assert own(P.language_id(spark, docs.union(junk), path)) == sorted(p for p in pairs if p[0] >= 0)
    kept = P.near_dedup(spark, docs, path)
    texts = {}
    for i, t in pairs:
        texts[t] = min(texts.get(t, (True, 0)), (i < 0, i))
    found = own(kept)
    assert [p for p in found if item not in p[1]] == sorted((i, t) for t, (_, i) in texts.items() if item not in t)
    clean = P.decontaminate(spark, docs, path)
    assert own(clean) == sorted(p for p in pairs if item not in p[1])
    words = lambda r: len((r.text or "").split())
    got, want = {}, {}
    for r in P.mix(spark, docs, path).collect():
        got[r.source] = got.get(r.source, 0) + words(r)
    for r in P.mix_sources(docs).collect():
        want[r.source_size, r.target] = want.get((r.source_size, r.target), 0) + r.taken
    assert sorted(got.values()) == sorted(v for v in want.values() if v)


def test_rows_are_numbered_apart(spark, tmp_path):
    path = f"file://{tmp_path}/rows"
    spark.range(1000).repartition(3).write.parquet(path)
    read = spark.read.parquet(path)
    for docs in (read, read.union(read), spark.read.parquet(path, path), read.filter("id > 5"), read.limit(0), spark.range(7)):
        numbered = P._numbered(docs)
        n = docs.count()
        assert numbered.columns == ["id", P.ROW]
        assert (numbered.count(), numbered.select(P.ROW).distinct().count()) == (n, n)
