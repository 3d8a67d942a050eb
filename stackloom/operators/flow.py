"""Counts that are kept up to date from changes, approximate counts, and the status of review items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# When a stored count is not trusted: below this many rows, or beyond these shares of
# rows modified since, and of drift from the live count.
LEAST_ESTIMATE, MODIFIED, DRIFT = 50_000, 0.2, 0.25


def stale(estimate: Column, live: Column, modified: Column, analysed: Column) -> Column:
    """Whether a stored count has to be counted again. Nulls count as zero; never analysed is stale."""
    e, n, m = (F.greatest(F.coalesce(c, F.lit(0)), F.lit(0)) for c in (estimate, live, modified))
    return (e < LEAST_ESTIMATE) | analysed.isNull() | (m > e * MODIFIED) | ((n > 0) & (F.abs(e - n) > n * DRIFT))


def approximate_counts(stats: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """(name, n, counted) of stats(name, estimate, live, modified, analysed): the stored estimate where
    it can be trusted, else the table's count, which reads no column (of Parquet only the footers).
    Only tables with a stale estimate are counted; names without a table keep their estimate."""
    rows = stats.withColumn("__stale", stale(F.col("estimate"), F.col("live"), F.col("modified"), F.col("analysed")))
    again = [r.name for r in rows.filter("__stale").select("name").collect() if r.name in tables]  # names of tables
    counts = None
    for name in again:
        one = tables[name].agg(F.count("*").alias("__n")).select(F.lit(name).alias("name"), "__n")
        counts = one if counts is None else counts.union(one)
    if counts is None:
        return rows.select("name", F.col("estimate").cast("long").alias("n"), F.lit(False).alias("counted"))
    joined = rows.join(counts, "name", "left")
    return joined.select("name", F.coalesce("__n", F.col("estimate").cast("long")).alias("n"), F.col("__n").isNotNull().alias("counted"))


def recovery(studies: DataFrame, found: DataFrame, first_year: int, last_year: int) -> DataFrame:
    """The studies without a date, with the date found for them and a note that says where it is from.

    found(study_id, recovered, source): candidates; a date outside of the years does not count, and
    of several of one study the first by source."""
    fit = found.filter(F.year("recovered").between(first_year, last_year)).groupBy("study_id").agg(F.min(F.struct("source", "recovered")).alias("r"))
    missing = studies.filter("study_date IS NULL").join(fit, "study_id", "left")
    note = F.concat(F.lit("study_date recovered from "), F.col("r.source"), F.lit(f" (year range {first_year}-{last_year})"))
    return missing.select("study_id", F.col("r.recovered").alias("study_date"), F.when(F.col("r.recovered").isNotNull(), note).alias("quality_control"))


def patched_metrics(stored: DataFrame, recovered: DataFrame, series: DataFrame, modalities: tuple[str, ...] = ("MR", "CT", "PT")) -> DataFrame:
    """(metric, value) after a recovery, from the stored metrics and what the recovery has changed.

    stored(metric, value) holds studies_with_valid_date, studies_excluded_no_date, total_series,
    series_to_process_count and series_by_modality:<modality>. recovered is recovery's outcome; only
    series of studies that have got a date are read. Metrics that are not stored yet begin at zero.
    """
    dated = recovered.filter("study_date IS NOT NULL")
    gained = series.filter(F.col("modality").isin(*modalities)).join(dated.select("study_id"), "study_id", "left_semi")
    one = lambda rows, metric: rows.agg(F.count("*").alias("delta")).select(F.lit(metric).alias("metric"), "delta")
    by = gained.groupBy("modality").agg(F.count("*").alias("delta")).select(F.concat(F.lit("series_by_modality:"), "modality").alias("metric"), "delta")
    changes = one(dated, "studies_with_valid_date").union(one(gained, "total_series")).union(one(gained, "series_to_process_count")).union(by)
    changes = changes.union(dated.agg((-F.count("*")).alias("delta")).select(F.lit("studies_excluded_no_date").alias("metric"), "delta"))
    both = stored.select("metric", F.col("value").cast("long").alias("v")).union(changes.select("metric", "delta"))
    return both.groupBy("metric").agg(F.sum("v").alias("value"))


PENDING, REVIEWED, CONFIRMED, SKIPPED = "pending", "reviewed", "confirmed", "skipped"
#: From each status the ones that may follow; an event that repeats the status changes nothing.
FOLLOWS = {PENDING: (REVIEWED, CONFIRMED, SKIPPED), REVIEWED: (CONFIRMED, SKIPPED, PENDING), CONFIRMED: (PENDING,), SKIPPED: (PENDING,)}


def item_status(events: DataFrame) -> DataFrame:
    """(item_id, status, reviewed_at, confirmed_at, n_events, illegal) after all events of each item.

    events(item_id, at, seq, status) are folded in the order of at and seq from `pending`. An event that
    may not follow is not applied but listed in illegal as from>to. reviewed_at and confirmed_at are
    the times of the last such event applied; they stay when an item is reopened. Unknown statuses are illegal;
    null items, times and statuses are left out. An item's events are one array: people make them.
    """
    known = events.filter("item_id IS NOT NULL AND at IS NOT NULL AND status IS NOT NULL")
    folded = known.groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("at", "seq", "status"))).alias("e"))
    at = events.schema["at"].dataType.simpleString()
    start = F.struct(F.lit(PENDING).alias("status"), F.lit(None).cast(at).alias("reviewed_at"), F.lit(None).cast(at).alias("confirmed_at"), F.array().cast("array<string>").alias("illegal"))

    def step(s: Column, e: Column) -> Column:
        allowed = F.lit(False)
        for old, new in FOLLOWS.items():
            allowed = allowed | ((s["status"] == old) & e["status"].isin(*new))
        same = s["status"] == e["status"]
        stamp = lambda status, c: F.when(allowed & (e["status"] == status), e["at"]).otherwise(s[c]).alias(c)
        wrong = F.when(allowed | same, s["illegal"]).otherwise(F.concat(s["illegal"], F.array(F.concat(s["status"], F.lit(">"), e["status"]))))
        return F.struct(F.when(allowed, e["status"]).otherwise(s["status"]).alias("status"), stamp(REVIEWED, "reviewed_at"), stamp(CONFIRMED, "confirmed_at"), wrong.alias("illegal"))

    rows = folded.withColumn("s", F.aggregate("e", start, step))
    return rows.select("item_id", "s.status", "s.reviewed_at", "s.confirmed_at", F.size("e").alias("n_events"), F.array_join("s.illegal", ",").alias("illegal"))


def draft_changes(drafts: DataFrame, actions: DataFrame) -> DataFrame:
    """(item_id, field, new_value) of the drafts left after actions(item_id, at, seq, kind, field, new_value).

    kind `set` puts a value in the place of the field's draft, `discard` drops the field's draft, or
    all of the item's where field is null. drafts are what was there before. The last set of a
    field counts if no discard of it or of its item comes after it.
    """
    order = F.struct("at", "seq")
    whole = actions.filter("kind = 'discard' AND field IS NULL").groupBy("item_id").agg(F.max(order).alias("__whole"))
    one = actions.filter("kind = 'discard' AND field IS NOT NULL").groupBy("item_id", "field").agg(F.max(order).alias("__one"))
    at, seq = actions.schema["at"].dataType.simpleString(), actions.schema["seq"].dataType.simpleString()
    before = drafts.select("item_id", "field", F.lit(None).cast(f"struct<at:{at},seq:{seq}>").alias("o"), "new_value")
    last = before.union(actions.filter("kind = 'set' AND field IS NOT NULL").select("item_id", "field", order.alias("o"), "new_value")).groupBy("item_id", "field").agg(F.max(F.struct("o", "new_value")).alias("r"))
    joined = last.join(whole, "item_id", "left").join(one, ["item_id", "field"], "left")
    gone = lambda c: F.col(c).isNotNull() & (F.col("r.o").isNull() | (F.col(c) > F.col("r.o")))
    return joined.filter(~gone("__whole") & ~gone("__one")).select("item_id", "field", "r.new_value")


#: Fields of a stored classification that a confirmed item may change; those of TRI_STATES are numbers.
TRI_STATES = ("post_contrast", "localizer", "spinal_cord")


def confirm_item_changes(cache: DataFrame, drafts: DataFrame, fields: tuple[str, ...], key: str = "series_id") -> DataFrame:
    """The cache with its drafts(key, field, new_value) pushed: listed fields take the new value, tri-states as
    numbers (empty or unreadable: null), and a row with any such draft no longer needs review. Of several
    drafts of one field the largest value counts."""
    listed = drafts.filter(F.col("field").isin(*fields)).groupBy(key).agg(*(F.max(F.when(F.col("field") == f, F.struct(F.lit(True), F.col("new_value").alias("v")))).alias(f"__{f}") for f in fields))
    joined = cache.join(listed.withColumn("__any", F.lit(True)), key, "left")
    value = lambda f: F.nullif(F.col(f"__{f}.v"), F.lit("")).try_cast("int") if f in TRI_STATES else F.col(f"__{f}.v")
    new = {f: F.when(F.col(f"__{f}").isNotNull(), value(f)).otherwise(F.col(f)) for f in fields}
    return joined.withColumns({**new, "review_required": F.when(F.col("__any"), 0).otherwise(F.col("review_required"))}).select(*cache.columns)
