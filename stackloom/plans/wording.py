"""Rules over wording: every keyword of the vocabulary, two by two, as the text of a stack.

The headers are otherwise empty, so that a rule matches by its words alone. The SQL does not
know the compiled expressions: it holds the vocabulary as a table of words with the rules' ranks
and finds first rules, deciding words and other matches by joins.
"""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stackloom.operators import rules

#: Words that also set flags, which the SQL leaves to other queries.
_FLAGGED = ("inv1", "inv2", "mp2rage", "uniden", "uni-den", "mpr")
_AXES = ("provenances", "techniques", "constructs", "modifiers")


def _words() -> list[str]:
    found = [k for axis in _AXES for r in rules.ordered_rules(axis) for k in r.get("keywords", ())]
    return [w for w in dict.fromkeys(found) if not any(f in w for f in _FLAGGED)]


def _stacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    words, k = _words(), F.col("k")
    listed = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "i int, word string")  # the vocabulary: bounded
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("stack_id"), (F.col("o_orderkey") + F.col("o_custkey")).alias("k"))
    rows = rows.withColumns({"a": (k % len(words)).cast("int"), "b": ((k * 7 + F.floor(k / len(words))) % len(words)).cast("int")})
    first, second = listed.select(F.col("i").alias("a"), F.col("word").alias("wa")), listed.select(F.col("i").alias("b"), F.col("word").alias("wb"))
    rows = rows.join(F.broadcast(first), "a").join(F.broadcast(second), "b").select("stack_id", F.concat_ws(" ", "wa", "wb").alias("text"))
    return rows.withColumns({c: F.lit(None).cast(t) for c, t in rules.INPUTS.items() if c != "text"}).withColumns({"aspect": F.lit(1.0), "n_instances": F.lit(100)})


_TRACED = ("provenance", "provenance_tier", "provenance_evidence", "provenance_alternatives", "technique_rule", "technique_tier", "technique_evidence", "technique_alternatives", "family", "branch")


def classification_explain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which rule decided each axis, by which word, and what else matched."""
    return rules.explain(_stacks(spark, sf_dir), ["stack_id", "text"]).select("stack_id", "text", *_TRACED)


def keyword_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Provenance, technique, constructs and modifiers of every pair of words that leads to no
    branch (C10, C11, C19, C20)."""
    found = rules.classify(_stacks(spark, sf_dir), ["stack_id", "text"])
    return found.filter(~F.coalesce(F.col("provenance").isin("SyMRI", "SWIRecon", "EPIMix"), F.lit(False))).select("stack_id", "text", "provenance", "technique", "constructs", "modifiers")


def classification_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stacks with numbers that cannot be read are kept in misc, the others classified."""
    k = F.col("stack_id")
    te = F.when(k % 7 == 0, "n/a").when(k % 7 == 1, " ").otherwise("90")
    rows = _stacks(spark, sf_dir).withColumns({"text": F.lit("t2 tse"), "te": te, "tr": F.when(k % 11 == 0, "4000 ms").otherwise("4000"), "scanning_sequence": F.lit("SE")})
    found = rules.classify_captured(rows, ["stack_id"])
    return found.groupBy("error", "intent", "base", "technique", (F.col("review_reasons") == rules.ERROR).alias("failed")).agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (classification_explain, keyword_rules, classification_errors)}


def _quote(value: str | None) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


def _table() -> str:
    rows = []
    for axis in _AXES:
        for rank, r in enumerate(rules.ordered_rules(axis)):
            rows += [f"('{axis}', {rank}, {_quote(r['id'])}, {_quote(r.get('name', r['id']))}, {_quote(r.get('family', 'UNKNOWN'))}, {_quote(r.get('branch', 'rawrecon'))}, {_quote(r.get('group'))}, {r.get('priority', 0)}, {at}, {_quote(w)})" for at, w in enumerate(r.get("keywords", ()))]
    return "kw(axis, rank, rule, name, family, branch, grp, priority, pos, word) AS (VALUES " + ", ".join(rows) + ")"


_SQL = f"""WITH {_table()}, listed AS (SELECT unnest([{', '.join(map(_quote, _words()))}]) AS word, unnest(range({len(_words())})) AS i),
o AS (SELECT o_orderkey AS stack_id, (o_orderkey + o_custkey) AS k FROM orders),
s AS (SELECT stack_id, a.word || ' ' || b.word AS text FROM o JOIN listed a ON a.i = k % {len(_words())} JOIN listed b ON b.i = (k * 7 + k // {len(_words())}) % {len(_words())}),
t AS (SELECT DISTINCT text FROM s), -- texts are few
hit AS (SELECT text, axis, rank, rule, any_value(name) AS name, any_value(family) AS family, any_value(branch) AS branch, any_value(grp) AS grp, any_value(priority) AS priority, arg_min(word, pos) AS word FROM t JOIN kw ON contains(text, kw.word) GROUP BY text, axis, rank, rule),
one AS (SELECT text, axis, arg_min(rule, rank) AS rule, arg_min(name, rank) AS name, arg_min(word, rank) AS word, arg_min(family, rank) AS family, arg_min(branch, rank) AS branch, array_to_string(list(rule ORDER BY rank)[2:], ',') AS others FROM hit GROUP BY text, axis)"""

ORACLE_SQL = {
    "classification_explain": f"""{_SQL}
SELECT stack_id, text, coalesce(p.rule, 'RawRecon') AS provenance, CASE WHEN p.rule IS NULL THEN 'default' ELSE 'keywords' END AS provenance_tier, p.word AS provenance_evidence, coalesce(p.others, '') AS provenance_alternatives,
    coalesce(q.rule, 'UNKNOWN') AS technique_rule, CASE WHEN q.rule IS NULL THEN 'default' ELSE 'keywords' END AS technique_tier, q.word AS technique_evidence, coalesce(q.others, '') AS technique_alternatives,
    coalesce(q.family, 'UNKNOWN') AS family, coalesce(p.branch, 'rawrecon') AS branch
FROM s LEFT JOIN (FROM one WHERE axis = 'provenances') p USING (text) LEFT JOIN (FROM one WHERE axis = 'techniques') q USING (text)""",
    "keyword_rules": f"""{_SQL},
m AS (SELECT a.text, array_to_string(list_sort(list(a.name)), ',') AS csv FROM hit a WHERE axis = 'modifiers' AND NOT EXISTS (FROM hit b WHERE b.text = a.text AND b.axis = 'modifiers' AND b.grp = a.grp AND b.priority < a.priority) GROUP BY a.text),
c AS (SELECT text, array_to_string(list_sort(list(name)), ',') AS csv FROM hit WHERE axis = 'constructs' GROUP BY text)
SELECT stack_id, text, coalesce(p.rule, 'RawRecon') AS provenance, coalesce(q.name, 'Unknown') AS technique, c.csv AS constructs, m.csv AS modifiers
FROM s LEFT JOIN (FROM one WHERE axis = 'provenances') p USING (text) LEFT JOIN (FROM one WHERE axis = 'techniques') q USING (text) LEFT JOIN c USING (text) LEFT JOIN m USING (text)
WHERE coalesce(p.branch, 'rawrecon') = 'rawrecon'""",
    "classification_errors": """WITH x AS (SELECT CASE WHEN o_orderkey % 7 = 0 AND o_orderkey % 11 = 0 THEN 'no number in te, tr' WHEN o_orderkey % 7 = 0 THEN 'no number in te' WHEN o_orderkey % 11 = 0 THEN 'no number in tr' END AS error, o_orderkey % 7 = 1 AS blank FROM orders)
SELECT error, CASE WHEN error IS NULL AND NOT blank THEN 'anat' ELSE 'misc' END AS intent, CASE WHEN error IS NULL AND NOT blank THEN 'T2w' END AS base, -- the weighting needs an echo time
    CASE WHEN error IS NULL THEN 'TSE' END AS technique, error IS NOT NULL AS failed, count(*) AS n FROM x GROUP BY ALL""",
}
