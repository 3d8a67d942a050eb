"""Export plans: names of stacks, folders, filters, and the paths they go to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Short orientations, the name's parts in order, and the provenances that a list selects.
ORIENTATIONS = {"Axial": "Ax", "Coronal": "Cor", "Sagittal": "Sag"}
SELECTABLE = ("SyMRI", "SWIRecon", "EPIMix", "ProjectionDerived")
SUFFIXES = {"multi_echo": "e", "multi_ti": "ti"}
#: Paths that exist are sent to all tasks up to this many bytes, at so many for each.
SENT_BYTES, PATH_BYTES = 32 << 20, 256


def stack_name(several: Column) -> Column:
    """[SC_]orientation_base_acquisition_modifiers_technique_acceleration_construct[_CE][_eN or _tiN].

    Empty and null parts are left out, `unknown` stands for a name without parts; commas of CSVs
    become hyphens. several: whether the stack's series has more than one stack.
    """
    hyphened = lambda c: F.nullif(F.replace(F.coalesce(F.col(c), F.lit("")), F.lit(","), F.lit("-")), F.lit(""))
    plain = lambda c: F.nullif(F.col(c), F.lit(""))
    orientation = F.coalesce(*(F.when(F.col("orientation") == o, a) for o, a in ORIENTATIONS.items()), F.nullif(F.substring("orientation", 1, 3), F.lit("")))
    spine = F.when(F.coalesce(F.col("spinal_cord"), F.lit(0)) != 0, "SC")
    parts = F.concat_ws("_", orientation, plain("base"), plain("acquisition_type"), hyphened("modifiers"), plain("technique"), hyphened("accelerations"), hyphened("constructs"))
    named = F.when(parts == "", F.when(spine.isNotNull(), "SC").otherwise("unknown")).otherwise(F.concat_ws("_", spine, parts))
    named = F.when(F.coalesce(F.col("post_contrast"), F.lit(0)) != 0, F.concat(named, F.lit("_CE"))).otherwise(named)
    return F.when(several, F.concat(named, _suffix())).otherwise(named)


def _suffix() -> Column:
    return F.coalesce(*(F.when(F.col("stack_key") == k, F.concat(F.lit(f"_{s}"), F.col("stack_index") + 1)) for k, s in SUFFIXES.items()), F.lit(""))


def destination(group_symri: bool = True) -> Column:
    """The folder of a stack: by provenance for three of them, else the intent, else misc."""
    intent = F.coalesce(F.nullif(F.col("intent"), F.lit("")), F.lit("misc"))
    anat = F.col("provenance").isin("SWIRecon", "ProjectionDerived")
    folder = F.when(anat, "anat").otherwise(intent)
    return F.when(F.col("provenance") == "SyMRI", "anat/SyMRI").otherwise(folder) if group_symri else folder


def chosen(stacks: DataFrame, intents: tuple[str, ...] = (), include: tuple[str, ...] = (), exclude: tuple[str, ...] = ()) -> DataFrame:
    """The stacks that filters leave. include only restricts the selectable provenances; a null
    provenance is none, a null intent is misc."""
    provenance = F.coalesce(F.col("provenance"), F.lit(""))
    keep = F.lit(True)
    if intents:
        keep &= F.coalesce(F.nullif(F.col("intent"), F.lit("")), F.lit("misc")).isin(*intents)
    if include:
        keep &= ~provenance.isin(*SELECTABLE) | provenance.isin(*include)
    if exclude:
        keep &= ~provenance.isin(*exclude)
    return stacks.filter(keep)


def subject_label(code: Column) -> Column:
    return F.concat(F.lit("sub-"), F.coalesce(F.nullif(code, F.lit("")), F.lit("unknown")))


def session_label(date: Column) -> Column:
    return F.concat(F.lit("ses-"), F.replace(F.coalesce(F.nullif(date.cast("string"), F.lit("")), F.lit("unknown")), F.lit("-"), F.lit("")))


def plan(stacks: DataFrame, layout: str = "bids", group_symri: bool = True, existing: DataFrame | None = None) -> DataFrame:
    """stacks with folder, name and target path; names that collide within a subject, date and
    folder are numbered by series time (nulls last) and stack index.

    layout `bids` is sub-<code>/ses-<date>/<folder>/<name>, `flat` puts all of it into one name.
    existing(path) lists what is there already: those stacks are marked skip. Names are built before rows are
    shuffled, so that what only they need stays behind; stacks are counted in their series by a window, those
    without one are in none; the second window is over subject, date, folder and name.
    """
    rows = stacks.withColumns({"folder": destination(group_symri), "__named": stack_name(F.lit(False)), "__suffix": _suffix()})
    alone = F.when(F.col("series_id").isNull(), F.col("stack_id"))  # stacks without a series are no group
    several = F.col("series_id").isNotNull() & (F.count("*").over(Window.partitionBy("series_id", alone)) > 1)
    rows = rows.withColumn("base_name", F.when(several, F.concat("__named", "__suffix")).otherwise(F.col("__named"))).drop("__named", "__suffix")
    same = Window.partitionBy("subject_code", "study_date", "folder", "base_name")
    number = F.row_number().over(same.orderBy(F.coalesce(F.col("series_time"), F.lit("zzz")), "stack_index", "stack_id"))
    rows = rows.withColumn("name", F.when(F.count("*").over(same) > 1, F.concat_ws("_", "base_name", number)).otherwise(F.col("base_name")))
    labels = [subject_label(F.col("subject_code")), session_label(F.col("study_date"))]
    path = F.concat_ws("/", *labels, "folder", "name") if layout == "bids" else F.concat_ws("_", *labels, F.replace("folder", F.lit("/"), F.lit("-")), "name")
    rows = rows.withColumn("path", path)
    if existing is None:
        return rows.withColumn("skip", F.lit(False))
    there = existing.select("path").distinct()
    few = there.count() * PATH_BYTES <= SENT_BYTES
    there = (F.broadcast(there) if few else there).withColumn("__there", F.lit(True))
    return rows.join(there, "path", "left").withColumn("skip", F.col("__there").isNotNull()).drop("__there")


def resolved_source(path: Column, root: str) -> Column:
    """Where a source lies: absolute paths as they are, others below the root."""
    return F.when(path.startswith("/"), path).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), path))


def resolved_sources(stacks: DataFrame, listing: DataFrame, root: str, path: str = "path") -> DataFrame:
    """stacks with `source`, where their files lie, and `found`, whether listing(path) has it.

    Absolute paths stay. Others lie below the root; if nothing is there but below a first folder
    that begins with sub-, that one is taken. What is nowhere keeps the plain place; a null path
    has no source, and an empty one is the root itself. Listed paths may repeat."""
    there = listing.select(F.col("path").alias("__at")).dropna().distinct()
    plain = resolved_source(F.col(path), root)
    labelled = F.when(~F.startswith(path, F.lit("/")) & (F.col(path) != ""), F.concat(F.lit(root.rstrip("/") + "/sub-"), path))
    rows = stacks.withColumns({"__plain": F.when(F.col(path) == "", root.rstrip("/")).otherwise(plain), "__labelled": labelled})
    for place, flag in (("__plain", "__is_plain"), ("__labelled", "__is_labelled")):
        rows = rows.join(there.select(F.col("__at").alias(place), F.lit(True).alias(flag)), place, "left")
    second = F.col("__is_plain").isNull() & F.col("__is_labelled").isNotNull()
    found = F.col("__is_plain").isNotNull() | F.col("__is_labelled").isNotNull()
    rows = rows.withColumns({"source": F.when(second, F.col("__labelled")).otherwise(F.col("__plain")), "found": found})
    return rows.select(*stacks.columns, "source", "found")
