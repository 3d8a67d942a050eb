"""The rule compiler: vocabularies in YAML become expressions.

Rules compile to SQL expression text (CASE, AND, OR, contains, array_contains) that Spark runs
through expr(). Flags are materialised in stages, fields first and unified flags then, so each
expression stays small and is evaluated once.
"""

from __future__ import annotations

from functools import cache, reduce
from pathlib import Path

import yaml
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HERE = Path(__file__).parent
PREFIX = {"image_type": "it", "scanning_sequence": "ss", "sequence_variant": "sv", "scan_options": "so", "sequence_name": "sn"}

#: Context flags that no field's tokens give.
CONTEXT = {
    "cx__positive_b": "coalesce(b_value > 0 AND b_value <= 20000, false)",
    "cx__is_3d": "coalesce(acquisition_type = '3D', false)",
    "cx__multi_echo": "coalesce(stack_key = 'multi_echo', false)",
    "cx__multi_ti": "coalesce(stack_key = 'multi_ti', false)",
    "cx__multi_flip_angle": "coalesce(stack_key = 'multi_flip_angle', false)",
    "cx__mpr_word": "contains(concat(' ', coalesce(text, ''), ' '), ' mpr ')",
}
#: Two inversion images and the denoised one are told by inversion time and text.
TEXT_FLAGS = {
    "is_mp2rage_inv1": "contains(coalesce(text, ''), 'inv1') OR (contains(coalesce(text, ''), 'mp2rage') AND coalesce(ti < 1800, false))",
    "is_mp2rage_inv2": "contains(coalesce(text, ''), 'inv2') OR (contains(coalesce(text, ''), 'mp2rage') AND coalesce(ti >= 1800, false))",
    "is_uniform_denoised": "contains(coalesce(text, ''), 'uniden') OR contains(coalesce(text, ''), 'uni-den')",
}


_TOKEN = "array_contains({}_tokens, '{}')"


def _tokens(prefix: str, *names: str) -> str:
    return "(" + " OR ".join(_TOKEN.format(prefix, n) for n in names) + ")"


def _raw(*words: str) -> str:
    return "(" + " OR ".join(f"contains(it_text, '{w}')" for w in words) + ")"


# What the branches and the acceleration step read beside the unified flags.
_SYNTHETIC = _tokens("it", "SYNTHETIC")
BRANCH_FLAGS = {
    "f_has_magnitude": f"({_tokens('it', 'MAGNITUDE', 'M_FFE', 'M_SE', 'M_IR', 'M_PCA', 'SW_M_FFE')} OR ({_tokens('it', 'M')} AND cardinality(it_tokens) > 2))",
    "f_has_qsm": f"({_tokens('it', 'QSM', 'SUSCEPTIBILITY')} OR {_raw('QUANTITATIVE SUSCEPTIBILITY')})",
    "f_has_qmap_t1": f"({_tokens('it', 'QMAP')} AND {_tokens('it', 'T1')} AND NOT {_tokens('it', 'T2')})",
    "f_has_qmap_t2": f"({_tokens('it', 'QMAP')} AND {_tokens('it', 'T2')})",
    "f_has_qmap_pd": f"({_tokens('it', 'QMAP')} AND {_tokens('it', 'PD')})",
    "f_has_pd_map": f"({_tokens('it', 'PDMAP', 'PD_MAP')} OR {_raw('PD MAP')})",
    "f_has_b1_map": f"({_tokens('it', 'B1MAP', 'B1_MAP', 'B1+')} OR {_raw('B1 MAP')})",
    "f_dir_synthetic": f"({_tokens('it', 'DIR_SYNTHETIC')} OR {_raw('DIR SYNTHETIC')} OR ({_tokens('it', 'DIR')} AND {_SYNTHETIC}))",
    "f_psir_synthetic": f"({_tokens('it', 'PSIR_SYNTHETIC')} OR ({_tokens('it', 'PSIR')} AND {_raw('SYNTHETIC')}))",
    "f_stir_synthetic": f"({_tokens('it', 'T2STIR')} AND {_raw('SYNTHETIC')})",
    "f_magic_raw": f"({_tokens('it', 'MAGIC')} AND {_tokens('it', 'ORIGINAL')})",
    **{
        f"f_derived_{t.lower()}": f"({_tokens('it', 'DERIVED')} AND {_tokens('it', t)} AND NOT {_tokens('it', 'SYNTHETIC', 'QMAP', f'{t}W_SYNTHETIC')})"
        for t in ("T1", "T2", "PD")
    },
    **{
        f"f_weighted_{t.lower()}": f"({_tokens('it', 'DERIVED')} AND {_tokens('it', t, f'{t}W')} AND {_SYNTHETIC} AND NOT {_tokens('it', 'FLAIR', 'DIR', 'PSIR', 'STIR')})"
        for t in ("T1", "T2", "PDW")
    },
    "f_pi_options": _tokens("so", "ACC_GEMS", "HYPERSENSE_GEMS", "CS_GEMS"),
    "f_cs_options": _tokens("so", "CS_GEMS"),
    "f_pf_options": _tokens("so", "PFP", "PFF"),
}


@cache
def vocabulary(name: str = "vocabulary") -> dict:
    return yaml.safe_load((HERE / f"{name}.yaml").read_text(encoding="utf-8"))


def _quoted(value: str) -> str:
    """A literal without backslashes, which engines read differently."""
    parts = value.replace("'", "''").split("\\")
    return f"'{parts[0]}'" if len(parts) == 1 else "concat(" + ", chr(92), ".join(f"'{p}'" for p in parts) + ")"


def _any(tests: list[str]) -> str:
    return "(" + " OR ".join(tests) + ")" if tests else "false"


def _entry(prefix: str, entry: dict) -> str:
    token = lambda t: f"array_contains({prefix}_tokens, {_quoted(t)})"
    text = lambda t: f"contains({prefix}_text, {_quoted(t)})"
    tests = []
    if "tokens" in entry:
        tests.append(_any([token(t) for t in entry["tokens"]]))
    if "text" in entry:
        tests.append(_any([text(t) for t in entry["text"]]))
    if "starts" in entry:
        tests.append(_any([f"left({prefix}_text, {len(t)}) = {_quoted(t)}" for t in entry["starts"]]))
    tests += [token(t) for t in entry.get("all", ())]
    tests += [f"NOT {token(t)}" for t in entry.get("not", ())] + [f"NOT {text(t)}" for t in entry.get("not_text", ())]
    if "more_than" in entry:
        tests.append(f"cardinality({prefix}_tokens) > {entry['more_than']}")
    return "(" + " AND ".join(tests) + ")"


def field_flags() -> dict[str, str]:
    """Name -> expression of the flags of single fields."""
    return {f"{p}__{flag}": _any([_entry(p, e) for e in entries]) for f, p in PREFIX.items() for flag, entries in vocabulary("flags")["fields"][f].items()}


def unified_flags() -> dict[str, str]:
    def part(p: str) -> str:
        p = p.strip()
        return f"NOT {part(p[1:])}" if p.startswith("!") else p.replace(".", "__")

    table = {f"f_{flag}": _any(["(" + " AND ".join(part(p) for p in entry.split("&")) + ")" for entry in entries]) for flag, entries in vocabulary("flags")["unified"].items()}
    return table | {f"f_{flag}": f"({test})" for flag, test in TEXT_FLAGS.items()}


def _keywords(rule: dict) -> str:
    return _any([f"contains(coalesce(text, ''), {_quoted(k)})" for k in rule["keywords"]]) if rule.get("keywords") else "false"


def _flags(names: list[str], how: str) -> str:
    return "(" + f" {how} ".join(f"f_{n}" for n in names) + ")" if names else "false"


def tiers(rule: dict, order: tuple[str, ...] = ("exclusive", "keywords", "all_of")) -> dict[str, str]:
    """Tier -> condition, in the order given."""
    conditions = {"exclusive": f"f_{rule['exclusive']}" if "exclusive" in rule else "false", "keywords": _keywords(rule), "all_of": _flags(rule.get("all_of", []), "AND"), "any_of": _flags(rule.get("any_of", []), "OR")}
    return {t: conditions[t] for t in order if conditions[t] != "false"}


def ordered_rules(axis: str) -> list[dict]:
    """Rules in the order of evaluation; names in the order that no rule has are skipped, and
    rules that the order lacks come last, in their own order."""
    table = vocabulary()[axis]
    by_id = {r["id"]: r for r in table["rules"]}
    return [by_id[i] for i in table["order"] if i in by_id] + [r for r in table["rules"] if r["id"] not in table["order"]]


def first_match(axis: str, order: tuple[str, ...], default: str) -> dict[str, str]:
    """Expressions of the first rule that matches in any tier: `id`, and the `tier`."""
    ids, found = [], []
    for rule in ordered_rules(axis):
        for tier, condition in tiers(rule, order).items():
            ids.append(f"WHEN {condition} THEN {_quoted(rule['id'])}")
            found.append(f"WHEN {condition} THEN '{tier}'")
    return {"id": f"CASE {' '.join(ids)} ELSE {default} END", "tier": f"CASE {' '.join(found)} ELSE 'default' END"}


def matches(axis: str, order: tuple[str, ...] = ("exclusive", "keywords", "all_of", "any_of")) -> dict[str, str]:
    """Rule id -> condition that any tier matches."""
    return {r["id"]: _any(list(tiers(r, order).values())) for r in ordered_rules(axis)}


def evidence(axis: str, order: tuple[str, ...], id_column: str, tier_column: str) -> str:
    """What made the rule match that a column names: its deciding flag, all of its flags, the first
    of them that holds, or the first of its keywords in the text; null for a default."""
    arms = []
    for rule in ordered_rules(axis):
        shown = {"exclusive": _quoted(rule.get("exclusive", "")), "all_of": _quoted("&".join(rule.get("all_of", ())))}
        first = lambda pairs: "CASE " + " ".join(f"WHEN {c} THEN {_quoted(v)}" for v, c in pairs) + " END"
        if rule.get("keywords"):
            shown["keywords"] = first([(k, f"contains(coalesce(text, ''), {_quoted(k)})") for k in rule["keywords"]])
        if rule.get("any_of"):
            shown["any_of"] = first([(n, f"f_{n}") for n in rule["any_of"]])
        tests = [f"WHEN '{t}' THEN {shown[t]}" for t in tiers(rule, order) if t in shown]
        if tests:
            arms.append(f"WHEN {_quoted(rule['id'])} THEN CASE {tier_column} {' '.join(tests)} END")
    return f"CASE {id_column} {' '.join(arms)} END"


def alternatives(axis: str, order: tuple[str, ...], id_column: str) -> str:
    """CSV of the other rules that match as well, in their order; '' if there are none."""
    conditions = {r["id"]: _any(list(tiers(r, order).values())) for r in ordered_rules(axis)}
    return "concat_ws(',', " + ", ".join(f"CASE WHEN {c} AND {id_column} <> {_quoted(i)} THEN {_quoted(i)} END" for i, c in conditions.items() if c != "false") + ")"


def csv_of(axis: str, conditions: dict[str, str]) -> str:
    """The names of the rules whose conditions hold, in order, joined by commas; null if there are none."""
    names = {r["id"]: r.get("name", r["id"]) for r in vocabulary()[axis]["rules"]}
    return "nullif(concat_ws(',', " + ", ".join(f"CASE WHEN {c} THEN {_quoted(names[i])} END" for i, c in conditions.items()) + "), '')"


def modifiers() -> str:
    """Modifiers as CSV; in an exclusion group the one with the lowest priority number stays."""
    conditions, rules = matches("modifiers"), {r["id"]: r for r in vocabulary()["modifiers"]["rules"]}
    for i, rule in rules.items():
        better = [j for j, other in rules.items() if rule.get("group") and other.get("group") == rule["group"] and other["priority"] < rule["priority"]]
        if better:
            conditions[i] = f"({conditions[i]} AND NOT {_any([conditions_raw for conditions_raw in (matches('modifiers')[j] for j in better)])})"
    return csv_of("modifiers", {i: conditions[i] for i in (r["id"] for r in ordered_rules("modifiers"))})


#: Confidence by tier.
CONFIDENCE = {"exclusive": 0.95, "any_of": 0.95, "keywords": 0.85, "all_of": 0.75}


def confidence(tier: str, default: float) -> str:
    return f"CASE {tier} " + " ".join(f"WHEN '{t}' THEN CAST({c} AS DOUBLE)" for t, c in CONFIDENCE.items()) + f" ELSE CAST({default} AS DOUBLE) END"


def contrast() -> str:
    """1, 0 or null: an agent is named, else negative wording, else positive wording."""
    words = vocabulary()["contrast"]
    has = lambda keys: _any([f"contains(concat(' ', coalesce(text, ''), ' '), {_quoted(k)})" for k in keys])
    return f"CASE WHEN contrast_agent IS NOT NULL THEN 1 WHEN {has(words['negative_keywords'])} THEN 0 WHEN {has(words['positive_keywords'])} THEN 1 END"


def spinal_cord() -> str:
    """1, 0 or null: spine words without brain words, brain words alone; both are a conflict."""
    words = vocabulary()["body_part"]
    has = lambda keys: _any([f"contains(coalesce(text, ''), {_quoted(k)})" for k in keys])
    spine, brain = has(words["positive_keywords"]), has(words["brain_only_keywords"])
    return f"CASE WHEN {spine} AND {brain} THEN NULL WHEN {spine} THEN 1 WHEN {brain} THEN 0 END"


def body_conflict() -> str:
    """Whether spine and brain words meet in one text."""
    words = vocabulary()["body_part"]
    has = lambda keys: _any([f"contains(coalesce(text, ''), {_quoted(k)})" for k in keys])
    return f"{has(words['positive_keywords'])} AND {has(words['brain_only_keywords'])}"


def named(axis: str, id_column: str, field: str, default: str) -> str:
    """The name (or another field) of the rule whose id a column holds."""
    rules = [(r["id"], r.get(field, r["id"] if field == "name" else None)) for r in vocabulary()[axis]["rules"]]
    differ = [(i, v) for i, v in rules if v is not None and (field != "name" or v != i)]
    return f"CASE {id_column} " + " ".join(f"WHEN {_quoted(i)} THEN {_quoted(v)}" for i, v in differ) + f" ELSE {default} END"


# Fixed values of the base cascade: technique id -> base and confidence, and the flag ladder in its order.
TECHNIQUE_BASE = {"MPRAGE": ("T1w", 0.95), "MEMPRAGE": ("T1w", 0.95), "MP2RAGE": ("T1w", 0.95), "TOF-MRA": ("T1w", 0.9), "ME-GRE": ("T2*w", 0.85), "comb-ME-GRE": ("T2*w", 0.9), "SWI": ("SWI", 0.95), "DWI-EPI": ("DWI", 0.95), "ASL-EPI": ("PWI", 0.95), "DSC-EPI": ("PWI", 0.9)}
BASE_FLAGS = (
    ("DWI", ("is_dwi", "has_adc", "has_fa", "has_trace")),
    ("PWI", ("is_perfusion", "is_asl", "has_cbf", "has_cbv", "has_mtt", "has_tmax", "has_ttp")),
    ("SWI", ("is_swi", "has_swi")),
    ("MTw", ("has_mtc",)),
    ("T1w", ("has_t1_synthetic",)),
    ("T2w", ("has_t2_synthetic", "has_flair_synthetic")),
    ("PDw", ("has_pd_synthetic",)),
    ("T2w", ("is_dir&is_synthetic",)),
    ("T1w", ("has_psir&is_synthetic",)),
    ("T1w", ("has_t1_map", "has_r1")),
    ("T2w", ("has_t2_map", "has_r2")),
    ("T1w", ("is_mp2rage_inv1", "is_mp2rage_inv2")),
    ("T1w", ("has_uniform", "is_uniform_denoised")),
)
_TEXT = "coalesce(text, '')"


def _says(*words: str) -> str:
    return _any([f"contains({_TEXT}, {_quoted(w)})" for w in words])


def base_steps() -> list[tuple[str, str, float, bool]]:
    """(condition, base, confidence, whether the text may contradict it), in order: technique,
    flags, FLAIR, dual echo, keywords, physics."""
    steps = [(f"technique_id = {_quoted(t)}", b, c, False) for t, (b, c) in TECHNIQUE_BASE.items()]
    flag = lambda f: "(" + " AND ".join(f"f_{x}" for x in f.split("&")) + ")"
    steps += [(_any([flag(f) for f in flags]), base, 0.9, False) for base, flags in BASE_FLAGS]
    flair = f"(f_is_flair OR {_says('flair')})"
    steps += [(f"{flair} AND {_says('t1')}", "T1w", 0.85, True), (f"{flair} AND {_says('t2')}", "T2w", 0.85, True)]
    steps += [(f"{flair} AND te < 40", "T1w", 0.85, True), (f"{flair} AND te >= 40", "T2w", 0.85, True), (flair, "T2w", 0.7, True)]
    dual = f"{_says('pd', 'proton density', 'proton-density')} AND {_says('t2')}"
    steps += [(f"{dual} AND te < 40", "PDw", 0.85, True), (f"{dual} AND te >= 40", "T2w", 0.85, True)]
    steps += [(_keywords(r), r.get("name", r["id"]), 0.85, False) for r in ordered_rules("bases") if r.get("keywords")]
    steps += [("f_has_ir AND ti < 300", "T2w", 0.75, True), ("f_has_ir AND ti <= 1500", "T1w", 0.7, True)]
    se, gre = "f_has_se AND NOT f_has_epi", "f_has_gre AND NOT f_has_epi"
    steps += [(f"{se} AND tr < 1000 AND te < 30", "T1w", 0.7, True), (f"{se} AND tr > 2000 AND te > 50", "T2w", 0.7, True), (f"{se} AND tr > 2000 AND te < 30", "PDw", 0.65, True)]
    return steps + [(f"{gre} AND te < 10", "T1w", 0.7, True), (f"{gre} AND te > 15", "T2*w", 0.7, True)]


def base_step() -> str:
    """The number of the first step of the base cascade that holds; null if none does."""
    return "CASE " + " ".join(f"WHEN {c} THEN {i}" for i, (c, *_) in enumerate(base_steps())) + " END"


def _of_step(column: int, default: str, quote: bool) -> str:
    value = lambda x: _quoted(x) if quote else f"CAST({x} AS DOUBLE)"
    return "CASE base_step " + " ".join(f"WHEN {i} THEN {value(s[column])}" for i, s in enumerate(base_steps())) + f" ELSE {default} END"


def base_conflict() -> str:
    """The first base, in the table's order, whose keywords the text has while it has none of
    the detected base's; only where the step is one that text may contradict."""
    rules = [r for r in vocabulary()["bases"]["rules"] if r.get("keywords")]
    open_steps = ", ".join(str(i) for i, s in enumerate(base_steps()) if s[3])
    name = lambda r: _quoted(r.get("name", r["id"]))
    own = _any([f"(detected_base = {name(r)} AND {_keywords(r)})" for r in rules])
    return f"CASE WHEN base_step NOT IN ({open_steps}) OR {own} THEN NULL " + " ".join(f"WHEN detected_base <> {name(r)} AND {_keywords(r)} THEN {name(r)}" for r in rules) + " END"


#: The families' flags and wording, and the techniques of the spine heuristic.
FAMILY_FLAGS = {"SE": ("has_se", "is_tse"), "GRE": ("has_gre",), "EPI": ("has_epi",)}
FAMILY_WORDS = {"SE": ("spin echo", "tse", "turbo spin", "fast spin", "fse"), "GRE": ("gradient echo", "gradient recalled"), "EPI": ("echo planar",)}
SIMPLE_TECHNIQUES = ("SE", "TSE", "FSE", "GRE", "FLASH", "MEDIC", "VIBE", "FIESTA", "bSSFP", "TRUFI", "MPRAGE", "HASTE", "BLADE")


def family_conflict() -> str:
    """A family other than the technique's that has flags, or else wording, while it has none."""
    arms = []
    for table in ({f: _flags(list(x), "OR") for f, x in FAMILY_FLAGS.items()}, {f: _says(*x) for f, x in FAMILY_WORDS.items()}):
        own = _any([f"(family = '{f}' AND {c})" for f, c in table.items()])
        arms += [f"WHEN family <> '{f}' AND {c} AND NOT {own} THEN '{f}'" for f, c in table.items()]
    return f"CASE WHEN family NOT IN ('SE', 'GRE', 'EPI') THEN NULL {' '.join(arms)} END"


# Output of a branch -> base, construct, technique, modifier, folder. The technique of
# SWI and SyMRI outputs is told by flags.
EPIMIX = {
    "t1_flair": ("T1w", None, "SE-EPI", "FLAIR", "anat"),
    "t2star": ("T2*w", None, "GRE-EPI", None, "anat"),
    "iso_dwi": ("DWI", "isoDWI", "SE-EPI", None, "dwi"),
    "adc": ("DWI", "ADC", "SE-EPI", None, "dwi"),
    "t2_flair_epi": ("T2w", None, "SE-EPI", "FLAIR", "anat"),
    "t2w_epi": ("T2w", None, "SE-EPI", None, "anat"),
    "t2_flair_ssfse": ("T2w", None, "HASTE", "FLAIR", "anat"),
    "t2w_ssfse": ("T2w", None, "HASTE", None, "anat"),
    "t2w_fse": ("T2w", None, "TSE", None, "anat"),
    "t1w_3depi": ("T1w", None, "EPI", None, "anat"),
    "swi_3depi": ("SWI", "SWI", "EPI", None, "anat"),
}
MAPS = ("MyelinMap", "MultiQmap", "T1map", "T2map", "PDmap", "R1map", "R2map", "B1map")
SYNTHETIC = {"SyntheticFLAIR": ("T2w", "FLAIR"), "SyntheticDIR": ("T2w", "DIR"), "SyntheticPSIR": ("T1w", "PSIR"), "SyntheticSTIR": ("T2w", "STIR"), "SyntheticT1w": ("T1w", None), "SyntheticT2w": ("T2w", None), "SyntheticPDw": ("PDw", None)}


# What tells an output of the branch, in order, and how sure it is.
def _swi() -> list[tuple[str, str, float]]:
    return [
        (f"f_has_qsm OR {_says('qsm')}", "QSM", 0.95),
        (f"f_is_minip OR {_says('minip', 'min ip')}", "MinIP", 0.95),
        (f"f_is_mip OR ({_says('mip')} AND NOT {_says('minip')})", "MIP", 0.9),
        (f"(f_has_phase AND NOT f_has_magnitude) OR ({_says('phase')} AND NOT {_says('magnitude')})", "Phase", 0.9),
        ("f_has_swi", "SWI", 0.9),
        ("f_is_projection", "SWI", 0.8),
        (f"f_has_magnitude OR {_says('magnitude')}", "Magnitude", 0.85),
        ("true", "SWI", 0.7),
    ]


# What tells an output of the branch, in order, and how sure it is.
def _symri() -> list[tuple[str, str, float]]:
    synthetic = lambda word, *without: f"({_says(word)} AND {_says('synthetic')}" + "".join(f" AND NOT {_says(w)}" for w in without) + ")"
    return [
        (f"f_has_myelin OR {_says('myelin', 'myc')}", "MyelinMap", 0.95),
        (f"f_has_multi_qmap OR {_says('multi_qmap', 'qmaps')}", "MultiQmap", 0.95),
        (f"f_has_qmap_t1 OR f_derived_t1 OR f_has_t1_map OR {_says('t1 map', 't1map')}", "T1map", 0.95),
        (f"f_has_qmap_t2 OR f_derived_t2 OR f_has_t2_map OR {_says('t2 map', 't2map')}", "T2map", 0.95),
        (f"f_has_qmap_pd OR f_derived_pd OR f_has_pd_map OR {_says('pd map', 'pdmap', 'proton density map')}", "PDmap", 0.95),
        (f"f_has_r1 OR {_says('r1 map', 'r1map')}", "R1map", 0.95),
        (f"f_has_r2 OR {_says('r2 map', 'r2map')}", "R2map", 0.95),
        (f"f_has_b1_map OR {_says('b1 map', 'b1map')}", "B1map", 0.95),
        (f"f_has_flair_synthetic OR {synthetic('flair')}", "SyntheticFLAIR", 0.95),
        (f"f_dir_synthetic OR {synthetic('dir')}", "SyntheticDIR", 0.95),
        (f"f_psir_synthetic OR {synthetic('psir')}", "SyntheticPSIR", 0.95),
        (f"f_stir_synthetic OR {synthetic('stir')}", "SyntheticSTIR", 0.95),
        (f"f_has_t1_synthetic OR f_weighted_t1 OR {synthetic('t1', 'flair', 'dir', 'psir')}", "SyntheticT1w", 0.95),
        (f"f_has_t2_synthetic OR f_weighted_t2 OR {synthetic('t2', 'flair', 'stir')}", "SyntheticT2w", 0.95),
        (f"f_has_pd_synthetic OR f_weighted_pdw OR {synthetic('pd')}", "SyntheticPDw", 0.95),
        (f"(f_has_phase AND NOT f_has_magnitude) OR contains(it_text, 'PHASE MAP') OR ({_says('phase')} AND NOT {_says('magnitude')})", "Phase", 0.9),
        (f"f_has_magnitude OR f_magic_raw OR contains(it_text, 'M_SE') OR {_says('magnitude')}", "Magnitude", 0.85),
        ("true", "Magnitude", 0.7),
    ]


# What tells an output of the branch, in order, and how sure it is.
def _epimix() -> list[tuple[str, str, float]]:
    # A weighting is named by t1 or t2 where a word begins, followed by w, flair, a space, a hyphen or the end.
    weighting = lambda w: f"regexp_like({_TEXT}, '(^|[^\\\\p{{L}}\\\\p{{N}}_]){w}(w|flair|[ -]|$)')"
    t1, star = weighting("t1"), _says("t2star", "t2*", "gradient-echo", "gradient echo")
    t2 = f"({weighting('t2')} AND NOT {_says('t2star', 't2*')})"
    flair, neuromix = _says("flair"), _says("neuromix", "mix2", "mix3")
    ssfse = _says("ssfse", "ss-fse", "haste", "single shot fse", "single-shot fse")
    ti, te = "coalesce(ti, 0)", "coalesce(te, 0)"
    return [
        (f"{t1} AND {flair}", "t1_flair", 0.9),
        (f"{t2} AND {flair} AND ({ssfse} OR ({neuromix} AND NOT {_says('epi')}))", "t2_flair_ssfse", 0.9),
        (f"{t2} AND {flair}", "t2_flair_epi", 0.9),
        (_says("swi"), "swi_3depi", 0.9),
        (f"{_says(' adc', 'adc ')} OR left({_TEXT}, 3) = 'adc'", "adc", 0.9),
        (_says("iso dwi", "isodwi"), "iso_dwi", 0.9),
        (star, "t2star", 0.9),
        (f"{_says('3d-epi', '3depi', '3d epi')} AND {t1}", "t1w_3depi", 0.9),
        (f"{t2} AND {ssfse}", "t2w_ssfse", 0.9),
        (f"{t2} AND {_says('fse')}", "t2w_fse", 0.9),
        (t2, "t2w_epi", 0.9),
        (f"{ti} > 2000 AND {neuromix}", "t2_flair_ssfse", 0.75),
        (f"{ti} > 2000", "t2_flair_epi", 0.75),
        (f"{ti} >= 500 AND {ti} <= 750 AND {te} < 40", "t1_flair", 0.75),
        (f"{ti} = 0 AND {te} > 0 AND {te} < 60", "t2star", 0.75),
        (f"{ti} = 0 AND {te} >= 60 AND {neuromix}", "t2w_ssfse", 0.7),
        (f"{ti} = 0 AND {te} >= 60", "t2w_epi", 0.7),
        ("true", "t2w_epi", 0.6),
    ]


def branch_output() -> str:
    """`branch:output:percent` for the stacks of a branch, null for the others."""
    arms = []
    for branch, ladder in (("swi", _swi()), ("symri", _symri()), ("epimix", _epimix())):
        arms.append(f"WHEN branch = '{branch}' THEN CASE " + " ".join(f"WHEN {c} THEN '{branch}:{o}:{round(100 * p)}'" for c, o, p in ladder) + " END")
    return f"CASE {' '.join(arms)} END"


def _branch_table() -> dict[str, tuple]:
    """branch:output -> (base, construct, modifier, folder)."""
    table = {f"swi:{o}": ("SWI", o, None, "anat") for o in ("QSM", "MinIP", "MIP", "Phase", "SWI", "Magnitude")}
    table |= {f"symri:{m}": (None, m, None, "fmap" if m == "B1map" else "anat") for m in MAPS}
    table |= {f"symri:{o}": (base, o, modifier, "anat") for o, (base, modifier) in SYNTHETIC.items()}
    table |= {f"symri:{o}": (None, o, None, "anat") for o in ("Phase", "Magnitude")}
    return table | {f"epimix:{o}": (base, construct, modifier, folder) for o, (base, construct, _, modifier, folder) in EPIMIX.items()}


def of_branch(field: int) -> str:
    return "CASE branch_key " + " ".join(f"WHEN '{k}' THEN {_quoted(v[field])}" for k, v in _branch_table().items() if v[field]) + " END"


def branch_technique() -> str:
    epimix = " ".join(f"WHEN 'epimix:{o}' THEN {_quoted(v[2])}" for o, v in EPIMIX.items())
    swi = f"CASE WHEN f_has_epi THEN 'EPI' WHEN f_has_gre THEN 'GRE' WHEN {_says('epi')} THEN 'EPI' ELSE 'GRE' END"
    return f"CASE WHEN branch = 'swi' THEN {swi} WHEN branch = 'symri' THEN CASE WHEN f_is_qalas THEN 'QALAS' ELSE 'MDME' END ELSE CASE branch_key {epimix} END END"


# Wording of the acceleration methods; words that only contain them are blanked out first.
ACCELERATION = (
    ("CompressedSensing", "f_cs_options", ("compressed sensing", "compressed_sensing", "compressedsense", "sparse", "wave-caipi", "wave caipi", "caipi"), r"\bcs\[|_cs_|_cs\b", ("csf", "csa"), ""),
    ("ParallelImaging", "f_pi_options", ("grappa", "sense", "asset", "ipat", "msense", "speedup", "accelerat"), r"\barc\b|\barc\[|_arc_|_arc\b", (), ""),
    ("PartialFourier", "f_pf_options", ("partial fourier", "partial_fourier", "half fourier", "half-fourier", "halffourier"), r"\bpf\b|5/8|6/8|7/8", (), ""),
    ("SimultaneousMultiSlice", "false", ("multiband", "multib", "hyperband"), r"\bmb\d|\bmb\[|\bmb=|_mb\d|_mb_|\bsms\b|_sms_|_sms\b", ("combat", "ambig", "membrane", "chamber", "number", "symbol", "assembly", "climbing", "plumb"), "cmrr|hyperband"),
    ("ViewSharing", "false", ("twist", "tricks", "keyhole", "view sharing", "viewsharing", "disco", "4d-trak", "4dtrak", "time-resolved", "differential subsampling"), "", (), "fldyn"),
)


def acceleration(options: dict[str, Column], text: Column, sequence_name: Column) -> Column:
    """CSV of the acceleration methods that options, text or the sequence's name show; '' if none."""
    found = []
    for name, option, words, bounded, hidden, sequences in ACCELERATION:
        own = F.lower(F.coalesce(text, F.lit("")))
        for word in hidden:
            own = F.replace(own, F.lit(word), F.lit(" "))
        tests = [own.contains(w) for w in words] + ([own.rlike(bounded)] if bounded else [])
        tests += [F.lower(F.coalesce(sequence_name, F.lit(""))).rlike(sequences)] if sequences else []
        tests += [options[option]] if option in options else []
        found.append(F.when(reduce(lambda a, b: a | b, tests), name))
    return F.concat_ws(",", *found)


def intent() -> str:
    """The export folder of a stack, first match of provenance, constructs, text and base."""
    constructs = lambda *names: _any([f"contains(concat(',', coalesce(constructs, ''), ','), ',{n},')" for n in names])
    text = lambda *words: _any([f"contains(coalesce(text, ''), '{w}')" for w in words])
    has = lambda *names: constructs(*names)
    # What tells a folder, in order.
    ladder = (
        ("provenance = 'DTIRecon'", "dwi"),
        ("provenance IN ('PerfusionRecon', 'ASLRecon')", "perf"),
        ("provenance = 'BOLDRecon'", "func"),
        (has("ADC", "eADC", "FA", "Trace", "MD", "AD", "RD"), "dwi"),
        (has("CBF", "CBV", "MTT", "Tmax", "TTP"), "perf"),
        (has("B0map"), "fmap"),
        (f"{has('PhaseMap')} AND NOT {has('SWIProcessed', 'QSM', 'MinIP')} AND ({has('InPhase', 'OutPhase')} OR provenance <> 'SWIRecon')", "fmap"),
        (f"{has('InPhase')} AND {has('OutPhase')} AND NOT {has('Water', 'Fat', 'FatFraction')}", "fmap"),
        (f"{text('bold', 'fmri', 'resting state', 'resting-state', 'task-', 'reti', 'retinotopy', 'functional')} AND (technique IN ('EPI', 'GRE-EPI', 'SE-EPI', 'MS-EPI', 'DWI') OR {text('epi')})", "func"),
        ("base = 'DWI'", "dwi"),
        ("base = 'PWI'", "perf"),
        ("base IN ('T1w', 'T2w', 'PDw', 'T2*w', 'SWI', 'MTw', 'T1rho', 'T2rho')", "anat"),
        (has("SWIProcessed", "QSM", "MinIP", "Magnitude", "MIP", "MPR", "T1map", "T2map", "PDmap", "R1map", "R2map", "B1map", "Water", "Fat", "FatFraction"), "anat"),
        ("contains(coalesce(constructs, ''), 'Synthetic')", "anat"),
        ("provenance IN ('SWIRecon', 'SyMRI', 'ProjectionDerived', 'SubtractionDerived')", "anat"),
    )
    return "CASE WHEN provenance = 'Localizer' THEN 'localizer' WHEN branch_output IS NOT NULL THEN " + of_branch(3) + " " + " ".join(f"WHEN {c} THEN '{v}'" for c, v in ladder) + " ELSE 'misc' END"


_PROVENANCE_ORDER, _TECHNIQUE_ORDER = ("exclusive", "any_of", "keywords", "all_of"), ("exclusive", "keywords", "all_of")


#: Stage -> column -> expression. Each stage may use the columns of those before it.
def stages() -> list[dict[str, str]]:
    provenance = first_match("provenances", _PROVENANCE_ORDER, "'RawRecon'")
    technique = first_match("techniques", _TECHNIQUE_ORDER, "'UNKNOWN'")
    csv = lambda column, added: f"nullif(array_join(array_sort(array_distinct(filter(concat(split(coalesce({column}, ''), ','), array({added})), x -> coalesce(x, '') <> ''))), ','), '')"
    return [
        field_flags() | CONTEXT,
        unified_flags() | BRANCH_FLAGS,
        {"provenance": provenance["id"], "provenance_tier": provenance["tier"], "technique_id": technique["id"], "technique_tier": technique["tier"], "detected_modifiers": modifiers(), "detected_constructs": csv_of("constructs", matches("constructs")), "post_contrast": contrast(), "spinal_cord": spinal_cord(), "body_conflict": body_conflict()},
        {
            "branch": named("provenances", "provenance", "branch", "'rawrecon'"),
            "family": named("techniques", "technique_id", "family", "'UNKNOWN'"),
            "detected_technique": named("techniques", "technique_id", "name", "CASE WHEN technique_id = 'UNKNOWN' THEN 'Unknown' ELSE technique_id END"),
            "base_step": base_step(),
            "excluded": "CASE WHEN f_is_screenshot THEN 'screenshot' WHEN f_is_secondary AND NOT f_is_primary THEN 'secondary_reformat' WHEN f_is_error THEN 'error_map' END",
        },
        {"branch_output": branch_output(), "detected_base": _of_step(1, "NULL", True), "detected_base_confidence": _of_step(2, "CAST(0.5 AS DOUBLE)", False), "technique_conflict": family_conflict()},
        {"branch_key": "substring_index(branch_output, ':', 2)", "base_conflict": base_conflict()},
        {
            "technique": f"CASE WHEN branch_output IS NULL THEN detected_technique ELSE {branch_technique()} END",
            "base": f"CASE WHEN branch_output IS NULL THEN detected_base ELSE {of_branch(0)} END",
            "constructs": f"CASE WHEN branch_output IS NULL THEN {csv('detected_constructs', '')} ELSE {of_branch(1)} END".replace("array()", "CAST(array() AS ARRAY<STRING>)"),
            "modifiers": csv("detected_modifiers", of_branch(2)),
            "branch_confidence": "CAST(substring_index(branch_output, ':', -1) AS DOUBLE) / 100",
            "technique_confidence": confidence("technique_tier", 0.0),
            "provenance_confidence": "CASE provenance_tier WHEN 'exclusive' THEN CAST(0.95 AS DOUBLE) WHEN 'any_of' THEN CAST(0.85 AS DOUBLE) WHEN 'keywords' THEN CAST(0.85 AS DOUBLE) WHEN 'all_of' THEN CAST(0.75 AS DOUBLE) ELSE CAST(0.8 AS DOUBLE) END",
        },
        {"intent": intent(), "base_confidence": "coalesce(branch_confidence, detected_base_confidence)"},
    ]


def tokenised(rows: DataFrame) -> DataFrame:
    """Token arrays and texts of the header fields; null fields have none."""
    out = rows
    for field, p in PREFIX.items():
        raw = F.coalesce(F.col(field), F.lit(""))
        text = F.lower(raw) if p == "sn" else F.upper(raw)
        cleaned = F.regexp_replace(text, "[\\[\\]'\"()]", "") if p in ("ss", "sv", "so") else text
        parts = F.split(cleaned, r"[\\/\s]+" if p == "it" else r"[,\s\\]+")
        out = out.withColumns({f"{p}_text": text, f"{p}_tokens": F.array_distinct(F.filter(parts, lambda x: x != ""))})
    return out


#: Bounds that rules compare numbers with.
BOUNDS = {"te": (0, 10, 15, 30, 40, 50, 60), "tr": (1000, 2000), "ti": (0, 300, 500, 750, 1500, 1800, 2000)}
_DETECTED = ["provenance", "provenance_confidence", "technique", "technique_confidence", "technique_conflict", "base", "base_confidence", "base_conflict", "base_step", "modifiers", "constructs", "accelerations", "post_contrast", "spinal_cord", "body_conflict", "branch_output", "branch_confidence", "detected_technique", "excluded", "intent"]


def _profile(rows: DataFrame) -> Column:
    """128 bits of what the rules can tell apart: texts as they are, numbers by their place among the
    bounds. Rows are grouped and joined by this digest, not by the texts."""
    places = [F.when(F.col(n).isNull(), -1).otherwise(sum(((F.col(n) >= b).cast("int") + (F.col(n) > b).cast("int") for b in bounds), F.lit(0))).alias(n) for n, bounds in BOUNDS.items()]
    flags = [F.expr(CONTEXT["cx__positive_b"]).alias("b"), (F.col("acquisition_type") == "3D").alias("d3"), F.col("contrast_agent").isNotNull().alias("agent")]
    keys = F.when(F.col("stack_key").isin("multi_echo", "multi_ti", "multi_flip_angle"), F.col("stack_key")).alias("key")
    return F.md5(F.to_json(F.struct(*PREFIX, "text", *places, *flags, keys)))


def base_method() -> str:
    """The method of a step of the base cascade; null for none."""
    named = len([r for r in ordered_rules("bases") if r.get("keywords")])
    lengths = (("technique", len(TECHNIQUE_BASE)), ("flags", len(BASE_FLAGS)), ("flair", 5), ("dual_echo", 2), ("keywords", named), ("physics", len(base_steps())))
    arms, upto = [], 0
    for method, n in lengths:
        upto += n
        arms.append(f"WHEN base_step < {upto} THEN '{method}'")
    return f"CASE {' '.join(arms)} END"


def base_alternatives() -> str:
    """CSV of the other bases that some step of the cascade would give, in its order."""
    found = ", ".join(f"CASE WHEN ({c}) AND NOT coalesce(detected_base = {_quoted(b)}, false) THEN {_quoted(b)} END" for c, b, *_ in base_steps())
    return f"array_join(array_distinct(array({found})), ',')"


def explain(rows: DataFrame, keep: list[str]) -> DataFrame:
    """keep, and how classify comes to what it says of a row (the same columns are read).

    excluded: why it is left out (all else is null then). For provenance and technique the rule,
    its tier, the flag or word that decided, and the other rules that match; the technique's
    family; the branch with what it overrides and how sure it is; for the base its value, the
    method of the cascade, and the other bases that later steps would give; and the two
    kinds of conflict. All of it comes from the expressions that classify runs.
    """
    rows = rows.withColumn("__profile", _profile(rows))
    out = tokenised(rows.groupBy("__profile").agg(*(F.min(c).alias(c) for c in INPUTS)))
    for stage in stages():
        out = out.withColumns({name: F.expr(test) for name, test in stage.items()})
    shown = {
        "excluded": "excluded",
        "provenance": "provenance", "provenance_tier": "provenance_tier", "provenance_evidence": evidence("provenances", _PROVENANCE_ORDER, "provenance", "provenance_tier"),
        "provenance_alternatives": alternatives("provenances", _PROVENANCE_ORDER, "provenance"),
        "technique_rule": "technique_id", "technique_tier": "technique_tier", "technique_evidence": evidence("techniques", _TECHNIQUE_ORDER, "technique_id", "technique_tier"),
        "technique_alternatives": alternatives("techniques", _TECHNIQUE_ORDER, "technique_id"), "family": "family",
        "branch": "branch", "branch_output": "branch_key", "branch_confidence": "branch_confidence",
        "base_override": f"CASE WHEN branch_output IS NULL THEN '(none)' ELSE {of_branch(0)} END", "construct_override": f"CASE WHEN branch_output IS NULL THEN '(none)' ELSE {of_branch(1)} END",
        "detected_base": "detected_base", "base_method": base_method(), "base_alternatives": base_alternatives(),
        "base_conflict": "base_conflict", "technique_conflict": "technique_conflict",
    }
    traced = out.select("__profile", *(F.expr(e if n == "excluded" else f"CASE WHEN excluded IS NULL THEN {e} END").alias(n) for n, e in shown.items()))
    return rows.select("__profile", *keep).join(traced, "__profile").drop("__profile")


#: What a row that cannot be read is given.
ERROR = "classification:error"


def classify_captured(rows: DataFrame, keep: list[str]) -> DataFrame:
    """As classify, for rows whose numbers may be text: a row with a number that cannot be read is
    not classified but kept in misc with the review reason classification:error, and `error`
    names its fields (null for the others). No row fails the job."""
    numbers = [c for c, t in (*INPUTS.items(), ("aspect", "double"), ("n_instances", "int")) if t in ("double", "int") and c in rows.columns]
    cast = {c: F.expr(f"try_cast(nullif(trim(cast(`{c}` AS STRING)), '') AS {'INT' if c == 'n_instances' else 'DOUBLE'})") for c in numbers}
    bad = F.array_compact(F.array(*(F.when((F.trim(F.col(c).cast("string")) != "") & (cast[c].isNull() | F.isnan(cast[c].cast("double"))), F.lit(c)) for c in numbers)))
    error = F.when(F.size(bad) > 0, F.concat(F.lit("no number in "), F.array_join(bad, ", ")))
    told = rows.withColumn("error", error).withColumns(cast)
    found = classify(told, [*keep, "error"])
    failed, kept = F.col("error").isNotNull(), [c for c in found.columns if c not in (*keep, "error")]
    blank = {c: F.when(~failed, F.col(c)) for c in kept if c not in ("intent", "review_reasons")}
    return found.withColumns({**blank, "intent": F.when(failed, "misc").otherwise(F.col("intent")), "review_reasons": F.when(failed, ERROR).otherwise(F.col("review_reasons"))})


def classify(rows: DataFrame, keep: list[str]) -> DataFrame:
    """rows with columns image_type, scanning_sequence, sequence_variant, scan_options,
    sequence_name, text, te, tr, ti, b_value, acquisition_type, stack_key, contrast_agent, aspect,
    n_instances -> keep and the classification's columns.

    Stacks of one protocol share their headers, so the rules run once for each profile (the
    texts, and the numbers' places among the bounds of the rules) and are joined to the rows.
    Excluded stacks have intent `excluded` and no axes. review_reasons is a sorted CSV, '' if
    there are none; nulls in any column are absent values.
    """
    rows = rows.withColumn("__profile", _profile(rows))
    inputs = [*PREFIX, "text", "te", "tr", "ti", "b_value", "acquisition_type", "stack_key", "contrast_agent"]
    out = tokenised(rows.groupBy("__profile").agg(*(F.min(c).alias(c) for c in inputs)))
    for stage in stages():
        out = out.withColumns({name: F.expr(test) for name, test in stage.items()})
    options = {n: F.col(n) for n in ("f_pi_options", "f_cs_options", "f_pf_options")}
    out = out.withColumn("accelerations", acceleration(options, F.col("text"), F.col("sequence_name")))
    found = rows.select("__profile", *{*keep, "aspect", "n_instances"}).join(out.select("__profile", *_DETECTED), "__profile")
    kept = F.col("excluded").isNull()
    axes = {c: F.when(kept, F.col(c)) for c in ("provenance", "technique", "base", "modifiers", "constructs", "post_contrast", "spinal_cord", "accelerations", "provenance_confidence", "technique_confidence", "base_confidence")}
    found = found.withColumn("review_reasons", F.when(kept, review_reasons()).otherwise(F.concat(F.lit("excluded:"), F.col("excluded"))))
    found = found.withColumns({**axes, "intent": F.when(kept, F.col("intent")).otherwise("excluded")})
    last = ["provenance", "provenance_confidence", "technique", "technique_confidence", "base", "base_confidence", "modifiers", "constructs", "accelerations", "post_contrast", "spinal_cord", "excluded", "intent", "review_reasons"]
    return found.select(*keep, *last)


#: The columns that classify reads, and their types.
INPUTS = {**{f: "string" for f in PREFIX}, "text": "string", "te": "double", "tr": "double", "ti": "double", "b_value": "double", "acquisition_type": "string", "stack_key": "string", "contrast_agent": "string"}


def branch_outcome(rows: DataFrame, branch: str) -> DataFrame:
    """rows with routed_base, routed_constructs, routed_technique and routed_intent: what a branch
    (swi, symri or epimix) makes of them, whatever their provenance. Columns of INPUTS that rows
    lack count as null."""
    out = tokenised(rows.withColumns({c: F.lit(None).cast(t) for c, t in INPUTS.items() if c not in rows.columns}))
    flags = stages()[:2]
    for stage in (*flags, {"branch": f"'{branch}'"}, {"branch_output": branch_output()}, {"branch_key": "substring_index(branch_output, ':', 2)"}):
        out = out.withColumns({name: F.expr(test) for name, test in stage.items()})
    routed = {"routed_base": of_branch(0), "routed_constructs": of_branch(1), "routed_technique": branch_technique(), "routed_intent": of_branch(3)}
    return out.select(*rows.columns, *(F.expr(e).alias(n) for n, e in routed.items()))


def review_reasons() -> Column:
    """CSV of what asks for a look at a stack: axes with conflicts or a confidence below 0.6."""
    low = lambda axis, c: F.when(c < 0.6, f"{axis}:low_confidence")
    raw = F.col("branch_output").isNull()
    unknown_body = F.col("spinal_cord").isNull() & ~F.col("body_conflict")
    stretched = unknown_body & F.coalesce(((F.col("aspect") < 0.8) | (F.col("aspect") > 1.25)) & F.col("detected_technique").isin(*SIMPLE_TECHNIQUES) & (F.col("n_instances") < 80), F.lit(False))
    contrast_confidence = F.when(F.col("post_contrast").isNull(), 0.0).otherwise(0.8)
    reasons = [
        F.when(raw & F.col("base_conflict").isNotNull(), "base:conflict"),
        low("base", F.col("base_confidence")),
        F.when(F.col("base").isNull() & F.col("constructs").isNull() & ~F.col("intent").isin("localizer", "func"), "base:missing"),
        F.when(raw & F.col("technique_conflict").isNotNull(), "technique:conflict"),
        low("technique", F.col("technique_confidence")),
        low("provenance", F.col("provenance_confidence")),
        low("contrast", contrast_confidence),
        F.when(F.col("body_conflict") | stretched, F.lit("body_part:conflict")),
        F.when(F.col("body_conflict") | stretched, F.lit("body_part:heuristic")),
        F.when(unknown_body, "body_part:low_confidence"),
        F.when(F.col("spinal_cord") == 1, "bodypart:spine_detected"),
        low("branch", F.col("branch_confidence")),
    ]
    return F.array_join(F.array_sort(F.array_compact(F.array(*reasons))), ",")
