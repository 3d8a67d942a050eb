"""First matches, multiple matches and branches of the rules over cases reasoned from their meaning.

A line item takes case `l_partkey % number of cases` of a list. Each case is a header and what the
rules' wording has for it: no outcome was taken from a run, and the SQL holds the outcomes as a
table that is joined to the line items.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stackloom.operators import rules


def _header(text=None, it=None, ss=None, sv=None, so=None, sn=None, te=None, ti=None, b=None, acq=None, key=None) -> tuple:
    """A header in the order of rules.INPUTS; parts of an image type are joined by a slash here."""
    return (it and it.replace("/", "\\"), ss, sv, so, sn, text, te, None, ti, b, acq, key, None)


H = _header
_SWI = "swi3d1r"

# header -> provenance, base, construct, technique, modifiers, intent, confidence of the branch
BRANCH_CASES: list[tuple[tuple, tuple]] = [
    # Susceptibility: QSM, then MinIP, MIP, phase, the token SWI, a projection, magnitude, and SWI at last.
    *((H(**h), ("SWIRecon", "SWI", construct, technique, None, "anat", sure)) for h, construct, technique, sure in (
        (dict(it="DERIVED/PRIMARY/QSM", ss="GR", sn=_SWI), "QSM", "GRE", 0.95),
        (dict(it="DERIVED/PRIMARY/SUSCEPTIBILITY", ss="GR", sn=_SWI), "QSM", "GRE", 0.95),
        (dict(it="ORIGINAL/PRIMARY/OTHER", ss="RM", text="swi qsm"), "QSM", "GRE", 0.95),
        (dict(it="DERIVED/PRIMARY/QSM/P", ss="GR", sn=_SWI), "QSM", "GRE", 0.95),
        (dict(it="DERIVED/PRIMARY/M/MNIP/SWI", ss="GR"), "MinIP", "GRE", 0.95),
        (dict(it="DERIVED/PRIMARY/MINIP", ss="GR", sn=_SWI), "MinIP", "GRE", 0.95),
        (dict(it="ORIGINAL/PRIMARY/OTHER", ss="RM", text="swi min ip"), "MinIP", "GRE", 0.95),
        (dict(it="DERIVED/PRIMARY/MIP/SWI", ss="GR"), "MIP", "GRE", 0.9),
        (dict(it="DERIVED/PRIMARY/SWI", ss="GR", text="swi mip thick"), "MIP", "GRE", 0.9),
        (dict(it="ORIGINAL/PRIMARY/P/SWI", ss="GR"), "Phase", "GRE", 0.9),
        (dict(it="ORIGINAL/PRIMARY/P/DIS2D", ss="GR", sn=_SWI, text="phase images swi"), "Phase", "GRE", 0.9),
        (dict(it="ORIGINAL/PRIMARY/SW_P_FFE", ss="GR"), "Phase", "GRE", 0.9),
        (dict(it="ORIGINAL/PRIMARY/M/P/SWI", ss="GR"), "SWI", "GRE", 0.9),
        (dict(it="ORIGINAL/PRIMARY/M/SWI/NORM/DIS2D", ss="GR", text="swi images brain"), "SWI", "GRE", 0.9),
        (dict(it="ORIGINAL/PRIMARY/M/SWI", ss="EP", sn="epfid3d1_15"), "SWI", "EPI", 0.9),
        (dict(it="ORIGINAL/PRIMARY/SW_M_FFE", ss="RM"), "SWI", "GRE", 0.9),
        (dict(it="ORIGINAL/PRIMARY/M/SWI", ss="RM", text="swi ax hr isat"), "SWI", "GRE", 0.9),
        (dict(it="DERIVED/PRIMARY/PROJECTION IMAGE", ss="GR", sn=_SWI), "SWI", "GRE", 0.8),
        (dict(it="ORIGINAL/PRIMARY/M/NORM/DIS2D", ss="GR", sn=_SWI, text="magnitude images swi"), "Magnitude", "GRE", 0.85),
        (dict(it="ORIGINAL/PRIMARY/MAGNITUDE", ss="GR", sn=_SWI), "Magnitude", "GRE", 0.85),
        (dict(it="ORIGINAL/PRIMARY/OTHER", ss="RM", text="swan magnitude and phase"), "Magnitude", "GRE", 0.85),
        (dict(it="ORIGINAL/PRIMARY/OTHER", ss="RM", text="swi ax 3depiks isat hr"), "SWI", "EPI", 0.7),
        (dict(text="susceptibility"), "SWI", "GRE", 0.7),
    )),
    # Synthetic imaging: maps first, then synthetic inversion contrasts, weightings, and raw parts.
    *((H(**h), ("SyMRI", base, construct, "MDME", modifier, intent, sure)) for h, base, construct, modifier, intent, sure in (
        (dict(it="DERIVED/PRIMARY/MYC", text="symri"), None, "MyelinMap", None, "anat", 0.95),
        (dict(it="ORIGINAL/PRIMARY/OTHER", text="symri myelin"), None, "MyelinMap", None, "anat", 0.95),
        (dict(it="DERIVED/PRIMARY/MULTI_QMAP/ENCRYPTED/T1/T2/PD"), None, "MultiQmap", None, "anat", 0.95),
        (dict(it="DERIVED/PRIMARY/QMAP/T1", text="symri"), None, "T1map", None, "anat", 0.95),
        (dict(it="DERIVED/PRIMARY/T1", text="symri"), None, "T1map", None, "anat", 0.95),
        (dict(it="ORIGINAL/PRIMARY/OTHER", text="symri t1map"), None, "T1map", None, "anat", 0.95),
        (dict(it="DERIVED/PRIMARY/QMAP/T2", text="symri"), None, "T2map", None, "anat", 0.95),
        (dict(it="DERIVED/PRIMARY/QMAP/T1/T2", text="symri"), None, "T2map", None, "anat", 0.95),
        (dict(it="DERIVED/PRIMARY/T2", text="magic"), None, "T2map", None, "anat", 0.95),
        (dict(it="DERIVED/PRIMARY/QMAP/PD", text="symri"), None, "PDmap", None, "anat", 0.95),
        (dict(it="DERIVED/PRIMARY/PD", text="symri"), None, "PDmap", None, "anat", 0.95),
        (dict(it="DERIVED/PRIMARY/R1", text="symri"), None, "R1map", None, "anat", 0.95),
        (dict(it="DERIVED/PRIMARY/R2", text="symri"), None, "R2map", None, "anat", 0.95),
        (dict(it="DERIVED/PRIMARY/B1MAP", text="symri"), None, "B1map", None, "fmap", 0.95),
        (dict(it="ORIGINAL/PRIMARY/OTHER", text="symri b1 map"), None, "B1map", None, "fmap", 0.95),
        (dict(it="DERIVED/PRIMARY/T2FLAIR/SYNTHETIC", text="symri"), "T2w", "SyntheticFLAIR", "FLAIR", "anat", 0.95),
        (dict(it="DERIVED/PRIMARY/DIR/SYNTHETIC", text="symri"), "T2w", "SyntheticDIR", "DIR", "anat", 0.95),
        (dict(it="DERIVED/PRIMARY/DIR_SYNTHETIC", text="symri"), "T2w", "SyntheticDIR", "DIR", "anat", 0.95),
        (dict(it="DERIVED/PRIMARY/PSIR/SYNTHETIC", text="symri"), "T1w", "SyntheticPSIR", "PSIR", "anat", 0.95),
        (dict(it="ORIGINAL/PRIMARY/OTHER", text="synthetic psir"), "T1w", "SyntheticPSIR", "PSIR", "anat", 0.95),
        (dict(it="DERIVED/PRIMARY/T2STIR/SYNTHETIC", text="symri"), "T2w", "SyntheticSTIR", "STIR", "anat", 0.95),
        (dict(it="ORIGINAL/PRIMARY/OTHER", text="synthetic t2 stir"), "T2w", "SyntheticSTIR", "STIR", "anat", 0.95),
        (dict(it="DERIVED/PRIMARY/T1/SYNTHETIC", text="symri"), "T1w", "SyntheticT1w", None, "anat", 0.95),
        (dict(it="DERIVED/PRIMARY/T1W_SYNTHETIC", text="symri"), "T1w", "SyntheticT1w", None, "anat", 0.95),
        (dict(it="DERIVED/PRIMARY/T2/SYNTHETIC", text="symri"), "T2w", "SyntheticT2w", None, "anat", 0.95),
        (dict(it="DERIVED/PRIMARY/PD/SYNTHETIC", text="symri"), "PDw", "SyntheticPDw", None, "anat", 0.95),
        (dict(it="DERIVED/PRIMARY/PDW/SYNTHETIC", text="symri"), "PDw", "SyntheticPDw", None, "anat", 0.95),
        (dict(it="ORIGINAL/PRIMARY/OTHER", text="synthetic pd"), "PDw", "SyntheticPDw", None, "anat", 0.95),
        (dict(it="ORIGINAL/PRIMARY/P/MAGIC", text="magic"), None, "Phase", None, "anat", 0.9),
        (dict(it="ORIGINAL/PRIMARY/OTHER", text="symri phase"), None, "Phase", None, "anat", 0.9),
        (dict(it="ORIGINAL/PRIMARY/M/MAGIC", text="magic"), None, "Magnitude", None, "anat", 0.85),
        (dict(it="ORIGINAL/PRIMARY/MAGIC", text="magic"), None, "Magnitude", None, "anat", 0.85),
        (dict(it="ORIGINAL/PRIMARY/OTHER", text="symri phase and magnitude"), None, "Magnitude", None, "anat", 0.85),
        (dict(it="ORIGINAL/PRIMARY/OTHER", text="symri"), None, "Magnitude", None, "anat", 0.7),
    )),
    (H(it="ORIGINAL/PRIMARY/OTHER", sn="qalas3d"), ("SyMRI", None, "Magnitude", "QALAS", None, "anat", 0.7)),
    # Several contrasts at once: words first, then inversion and echo times, and T2 at last.
    *((H(**h), ("EPIMix", *outcome)) for h, outcome in (
        (dict(text="epimix t1 flair"), ("T1w", None, "SE-EPI", "FLAIR", "anat", 0.9)),
        (dict(text="neuromix t2 flair"), ("T2w", None, "HASTE", "FLAIR", "anat", 0.9)),
        (dict(text="neuromix t2 flair epi"), ("T2w", None, "SE-EPI", "FLAIR", "anat", 0.9)),
        (dict(text="epimix t2flair"), ("T2w", None, "SE-EPI", "FLAIR", "anat", 0.9)),
        (dict(text="epimix t2flair haste"), ("T2w", None, "HASTE", "FLAIR", "anat", 0.9)),
        (dict(text="neuromix swi"), ("SWI", "SWI", "EPI", None, "anat", 0.9)),
        (dict(text="epimix adc"), ("DWI", "ADC", "SE-EPI", None, "dwi", 0.9)),
        (dict(text="adc epimix"), ("DWI", "ADC", "SE-EPI", None, "dwi", 0.9)),
        (dict(text="epimix isodwi"), ("DWI", "isoDWI", "SE-EPI", None, "dwi", 0.9)),
        (dict(text="epimix iso dwi"), ("DWI", "isoDWI", "SE-EPI", None, "dwi", 0.9)),
        (dict(text="epimix t2star"), ("T2*w", None, "GRE-EPI", None, "anat", 0.9)),
        (dict(text="t2* epimix"), ("T2*w", None, "GRE-EPI", None, "anat", 0.9)),
        (dict(text="epimix gradient echo"), ("T2*w", None, "GRE-EPI", None, "anat", 0.9)),
        (dict(text="neuromix 3d-epi t1w"), ("T1w", None, "EPI", None, "anat", 0.9)),
        (dict(text="neuromix t2w ssfse"), ("T2w", None, "HASTE", None, "anat", 0.9)),
        (dict(text="neuromix t2 fse"), ("T2w", None, "TSE", None, "anat", 0.9)),
        (dict(text="epimix t2w"), ("T2w", None, "SE-EPI", None, "anat", 0.9)),
        (dict(text="epimix-t2w"), ("T2w", None, "SE-EPI", None, "anat", 0.9)),
        (dict(text="epimix (t1-flair)"), ("T1w", None, "SE-EPI", "FLAIR", "anat", 0.9)),
        (dict(text="epimix", ti=2500.0), ("T2w", None, "SE-EPI", "FLAIR", "anat", 0.75)),
        (dict(text="neuromix", ti=2500.0), ("T2w", None, "HASTE", "FLAIR", "anat", 0.75)),
        (dict(text="epimix", ti=600.0, te=30.0), ("T1w", None, "SE-EPI", "FLAIR", "anat", 0.75)),
        (dict(text="epimix", ti=750.0, te=39.0), ("T1w", None, "SE-EPI", "FLAIR", "anat", 0.75)),
        (dict(text="epimix", ti=600.0, te=50.0), ("T2w", None, "SE-EPI", None, "anat", 0.6)),
        (dict(text="epimix", ti=2000.0, te=30.0), ("T2w", None, "SE-EPI", None, "anat", 0.6)),
        (dict(text="epimix", te=59.5), ("T2*w", None, "GRE-EPI", None, "anat", 0.75)),
        (dict(text="epimix", te=60.0), ("T2w", None, "SE-EPI", None, "anat", 0.7)),
        (dict(text="mix3", te=90.0), ("T2w", None, "HASTE", None, "anat", 0.7)),
        (dict(text="epimix"), ("T2w", None, "SE-EPI", None, "anat", 0.6)),
        (dict(text="epimix t1x"), ("T2w", None, "SE-EPI", None, "anat", 0.6)),
        (dict(text="epimix_t1w"), ("T2w", None, "SE-EPI", None, "anat", 0.6)),
    )),
]

# header -> technique; one flag is surest (0.95), then words (0.85), then flags together (0.75)
TECHNIQUE_CASES: list[tuple[tuple, tuple]] = [
    *((H(**h), (name, 0.95)) for h, name in (
        (dict(sn="re_b1000"), "RESOLVE"), (dict(ss="EP", sn="ep_b0"), "DWI-EPI"), (dict(ss="EP", b=1000.0), "DWI-EPI"),
        (dict(it="ORIGINAL/PRIMARY/FMRI", ss="EP"), "BOLD"), (dict(it="ORIGINAL/PRIMARY/P/FMRI", ss="EP"), "EPI"),
        (dict(it="ORIGINAL/PRIMARY/ASL"), "ASL"), (dict(it="ORIGINAL/PRIMARY/PERFUSION_ASL"), "ASL"), (dict(it="ORIGINAL/PRIMARY/PERFUSION"), "Perfusion"),
        (dict(so="MRF_GEMS"), "MRF"), (dict(sn="spc3d1"), "SPACE"), (dict(sn="h2d1_130"), "HASTE"), (dict(sn="memp"), "MESE"), (dict(sn="tse2d1_15"), "TSE"),
        (dict(ss="SE", sv="SK"), "TSE"), (dict(ss="SE"), "SE"), (dict(sn="tfl3d1_ns"), "MPRAGE"), (dict(sv="TOF"), "TOF"), (dict(so="VASCTOF_GEMS"), "TOF"),
        (dict(sn="pc3d1"), "PC"), (dict(it="ORIGINAL/PRIMARY/M_PCA", ss="GR"), "PC"), (dict(sn="ci3d1"), "CISS"), (dict(sn="tfi2d1"), "FIESTA"),
        (dict(sn="tfl2d1"), "TurboFLASH"), (dict(sn="fl2d1"), "FLASH"), (dict(ss="GR"), "GRE"), (dict(ss="EP"), "EPI"),
    )),
    *((H(text), (name, 0.85)) for text, name in (
        ("resolve", "RESOLVE"), ("diffusion", "DWI-EPI"), ("steam", "DWI-STEAM"), ("resting state", "BOLD"), ("pcasl", "ASL"), ("dsc", "Perfusion"), ("tgse", "GRASE"),
        ("se-epi", "SE-EPI"), ("gre-epi", "GRE-EPI"), ("fingerprinting", "MRF"), ("vista", "SPACE"), ("ssfse", "HASTE"), ("tirm", "TIRM"), ("dual echo se", "MESE"),
        ("hyperecho", "RESTORE"), ("fast spin echo", "TSE"), ("spin-echo", "SE"), ("mp2rage", "MP2RAGE"), ("me-mprage", "MEMPRAGE"), ("bravo", "MPRAGE"),
        ("time of flight", "TOF"), ("phase contrast", "PC"), ("medic", "MEDIC"), ("megre", "MEGRE"), ("fiesta-c", "CISS"), ("trufi", "FIESTA"), ("dess", "DESS"), ("psif", "PSIF"),
        ("despot", "VFA-GRE"), ("lava", "VIBE"), ("turboflash", "TurboFLASH"), ("spgr", "FLASH"), ("grass", "FISP"), ("ffe", "GRE"), ("echo planar", "EPI"),
    )),
    *((H(**h), (name, 0.75)) for h, name in (
        (dict(ss="EP", sv="SK"), "RESOLVE"), (dict(ss="SE\\GR"), "GRASE"), (dict(ss="SE\\EP"), "SE-EPI"), (dict(sn="epse2d1"), "SE-EPI"), (dict(ss="GR\\EP"), "GRE-EPI"),
        (dict(sn="epfid2d1_64"), "GRE-EPI"), (dict(ss="SE", sv="SK", acq="3D"), "SPACE"), (dict(ss="SE\\IR", sn="tse2d1"), "TIRM"), (dict(ss="SE", key="multi_echo"), "MESE"),
        (dict(ss="GR\\IR", acq="3D", key="multi_ti"), "MP2RAGE"), (dict(ss="GR\\IR", acq="3D", key="multi_echo"), "MEMPRAGE"), (dict(ss="GR\\IR", acq="3D"), "MPRAGE"),
        (dict(ss="GR", key="multi_echo"), "MEGRE"), (dict(ss="GR", sv="SS"), "FIESTA"), (dict(ss="GR", acq="3D", key="multi_flip_angle"), "VFA-GRE"),
        (dict(ss="GR", sv="SP", acq="3D"), "VIBE"), (dict(ss="GR", sv="SP"), "FLASH"),
    )),
    (H(ss="RM"), ("Unknown", 0.0)),
]

# header -> constructs and modifiers, all that match; of inversion contrasts, and of trajectories, only the first
MULTI_CASES: list[tuple[tuple, tuple]] = [
    *((H(it=it), (constructs, None)) for it, constructs in (
        ("DERIVED/PRIMARY/ADC", "ADC"), ("DERIVED/PRIMARY/EADC", "eADC"), ("DERIVED/PRIMARY/FA", "FA"), ("DERIVED/PRIMARY/TRACEW", "Trace"), ("DERIVED/PRIMARY/ISODWI", "Trace"),
        ("DERIVED/PRIMARY/RCBF", "CBF"), ("DERIVED/PRIMARY/RELCBV", "CBV"), ("DERIVED/PRIMARY/MTT", "MTT"), ("DERIVED/PRIMARY/TMAX", "Tmax"), ("DERIVED/PRIMARY/TTP", "TTP"),
        ("DERIVED/PRIMARY/CBF/CBV/MTT", "CBF,CBV,MTT"), ("ORIGINAL/PRIMARY/W", "Water"), ("ORIGINAL/PRIMARY/FAT", "Fat"), ("ORIGINAL/PRIMARY/IP", "InPhase"),
        ("ORIGINAL/PRIMARY/OPP_PHASE", "OutPhase"), ("DERIVED/PRIMARY/T1MAP", "T1map,T2map"), ("DERIVED/PRIMARY/R1", "R1map,T1map,T2map"), ("DERIVED/PRIMARY/R2", "R2map,T1map,T2map"),
        ("ORIGINAL/PRIMARY/UNIFORM", "Uniform"), ("ORIGINAL/PRIMARY/PHASE", "Phase"), ("DERIVED/PRIMARY/MIP", "MIP"), ("DERIVED/PRIMARY/MNIP", "MinIP"), ("DERIVED/PRIMARY/MPR", "MPR"),
        ("ORIGINAL/PRIMARY/REAL", "Real"), ("ORIGINAL/PRIMARY/I", "Imaginary"), ("ORIGINAL/PRIMARY/OTHER", None),
    )),
    *((H(text, ti=ti), (constructs, None)) for text, ti, constructs in (
        ("mean diffusivity", None, "MD"), ("pdmap", None, "PDmap"), ("myelin", None, "MyelinMap"), ("field map", None, "B0map"), ("b1map", None, "B1map"), ("magnitude only", None, "Magnitude"),
        ("qsm", None, "QSM"), ("opposed phase", None, "OutPhase,Phase"), ("adc map fa map", None, "ADC,FA"), ("mp2rage", 700.0, "INV1"), ("mp2rage", 2500.0, "INV2"), ("mp2rage inv2", 700.0, "INV1,INV2"),
        ("uniden", None, "Denoised"), ("minip", None, "MinIP"), ("max ip", None, "MIP"),
    )),
    (H(it="ORIGINAL/PRIMARY/IP/OP"), ("InPhase,OutPhase", "Dixon")),
    *((H(**h), (None, modifiers)) for h, modifiers in (
        (dict(so="T2FLAIR_GEMS"), "FLAIR"), (dict(it="ORIGINAL/PRIMARY/DIR"), "DIR"), (dict(it="ORIGINAL/PRIMARY/PSIR"), "PSIR"), (dict(ss="SE\\IR"), "IR"), (dict(ss="SE\\IR", text="stir"), "STIR"),
        (dict(so="FS"), "FatSat"), (dict(so="FSE"), None), (dict(so="WE"), "WaterExc"), (dict(so="DIXF"), "Dixon"), (dict(so="MT"), "MT"), (dict(sv="MTC"), "MT"), (dict(so="FC"), "FlowComp"),
        (dict(so="PROP_GEMS"), "Radial"), (dict(so="SPIRAL_GEMS"), "Spiral"), (dict(so="PROP_GEMS SPIRAL_GEMS"), "Radial"), (dict(it="ORIGINAL/PRIMARY/MOCO"), "MoCo"),
        (dict(text="black blood"), "BlackBlood"), (dict(text="bright blood spair"), "BrightBlood,FatSat"), (dict(text="flair psir"), "FLAIR"), (dict(text="psir stir"), "STIR"),
        (dict(so="FS FC MT", text="flair blade"), "FLAIR,FatSat,FlowComp,MT,Radial"),
    )),
]

# header -> provenance; branches first, then derived images, raw ones at last
PROVENANCE_CASES: list[tuple[tuple, tuple]] = [
    (H(it=it, text=text, ss=ss, sn=sn, so=so), (name, sure))
    for it, text, ss, sn, so, name, sure in (
        ("DERIVED/PRIMARY/MULTI_QMAP", None, None, None, None, "SyMRI", 0.85), (None, None, None, "mdme", None, "SyMRI", 0.85), (None, "syntetisk", None, None, None, "SyMRI", 0.85),
        (None, "symri epimix swi", None, None, None, "SyMRI", 0.85), (None, "epimix swi", None, None, None, "EPIMix", 0.85), (None, "mix2", None, None, None, "EPIMix", 0.85),
        ("ORIGINAL/PRIMARY/SWI", None, "GR", None, None, "SWIRecon", 0.95), (None, None, None, "qswi", None, "SWIRecon", 0.95), (None, "fsbb", None, None, None, "SWIRecon", 0.85),
        ("DERIVED/PRIMARY/ADC", None, None, None, None, "DTIRecon", 0.95), ("DERIVED/PRIMARY/EXP", None, None, None, None, "DTIRecon", 0.95), (None, "tensor", None, None, None, "DTIRecon", 0.85),
        ("DERIVED/PRIMARY/CBF", None, None, None, None, "PerfusionRecon", 0.95), (None, "perfusion map", None, None, None, "PerfusionRecon", 0.85),
        ("ORIGINAL/PRIMARY/ASL", None, None, None, None, "ASLRecon", 0.95), ("DERIVED/PRIMARY/CBF/ASL", None, None, None, None, "PerfusionRecon", 0.95), (None, "arterial spin", None, None, None, "ASLRecon", 0.85),
        ("ORIGINAL/PRIMARY/FMRI", None, None, None, None, "BOLDRecon", 0.95), (None, "resting state", None, None, None, "BOLDRecon", 0.85),
        ("ORIGINAL/PRIMARY/LOCALIZER", None, None, None, None, "Localizer", 0.95), (None, None, None, None, "SCOUT MODE", "Localizer", 0.95), (None, "survey", None, None, None, "Localizer", 0.85),
        ("DERIVED/PRIMARY/MIP", None, None, None, None, "ProjectionDerived", 0.85), ("DERIVED/PRIMARY/PROJECTION IMAGE", None, None, None, None, "ProjectionDerived", 0.85),
        (None, "multiplanar reformat", None, None, None, "ProjectionDerived", 0.85), ("DERIVED/PRIMARY/SUB", None, None, None, None, "SubtractionDerived", 0.95),
        (None, "difference", None, None, None, "SubtractionDerived", 0.85), ("ORIGINAL/PRIMARY/M", "t1 tse", "SE", None, None, "RawRecon", 0.8), (None, None, None, None, None, "RawRecon", 0.8),
    )
]


def _found(spark: SparkSession, sf_dir: str, cases: list[tuple[tuple, tuple]], columns: tuple[str, ...]) -> DataFrame:
    headers = spark.createDataFrame([(i, *header) for i, (header, _) in enumerate(cases)], "case int, " + ", ".join(f"{c} {t}" for c, t in rules.INPUTS.items()))
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.concat_ws(".", "l_orderkey", "l_linenumber").alias("stack_id"), (F.col("l_partkey") % len(cases)).cast("int").alias("case"))
    rows = rows.join(F.broadcast(headers), "case").withColumns({"aspect": F.lit(1.0), "n_instances": F.lit(100)})  # the list of cases is a constant
    return rules.classify(rows, ["stack_id", "case"]).select("stack_id", "case", *columns)


_COLUMNS = {
    "provenance_first_match": (PROVENANCE_CASES, ("provenance", "provenance_confidence")),
    "technique_first_match": (TECHNIQUE_CASES, ("technique", "technique_confidence")),
    "constructs_multi_match": (MULTI_CASES, ("constructs", "modifiers")),
    "branch_override": (BRANCH_CASES, ("provenance", "base", "constructs", "technique", "modifiers", "intent", "base_confidence")),
}


def provenance_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where images come from: the first rule that matches, and how sure it is."""
    return _found(spark, sf_dir, *_COLUMNS["provenance_first_match"])


def technique_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first technique that matches by flag, words or flags together (C11)."""
    return _found(spark, sf_dir, *_COLUMNS["technique_first_match"])


def constructs_multi_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All constructs that match, and modifiers with one of each exclusive group."""
    return _found(spark, sf_dir, *_COLUMNS["constructs_multi_match"])


def branch_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the arms of the three branches put in the place of the axes."""
    return _found(spark, sf_dir, *_COLUMNS["branch_override"])


QUERIES = {f.__name__: f for f in (provenance_first_match, technique_first_match, constructs_multi_match, branch_override)}


def _sql(cases: list[tuple[tuple, tuple]], columns: tuple[str, ...]) -> str:
    shown = lambda v: "NULL" if v is None else f"{v}::DOUBLE" if isinstance(v, float) else f"'{v}'"
    values = ", ".join(f"({i}, {', '.join(map(shown, outcome))})" for i, (_, outcome) in enumerate(cases))
    return f"WITH expected(\"case\", {', '.join(columns)}) AS (VALUES {values}) SELECT concat_ws('.', l_orderkey, l_linenumber) AS stack_id, expected.* FROM lineitem JOIN expected ON l_partkey % {len(cases)} = \"case\""


ORACLE_SQL = {name: _sql(*listed) for name, listed in _COLUMNS.items()}
