"""Protocols of made-up scanners: the headers that the classification queries read.

A line item takes part `l_partkey % len(PROTOCOLS)` of this list; the oracle holds what the
detectors are to make of each.
"""

from __future__ import annotations

FIELDS = "image_type string, scanning_sequence string, sequence_variant string, scan_options string, sequence_name string, text string, te double, tr double, ti double, b_value double, acquisition_type string, stack_key string, contrast_agent string"

PROTOCOLS: tuple[tuple, ...] = (
    ("ORIGINAL\\PRIMARY\\M\\ND", "GR\\IR", "SK\\SP\\MP", "IR", "tfl3d1_ns", "t1 mprage sag brain", 3.0, 2300.0, 900.0, None, "3D", None, None),
    ("ORIGINAL\\PRIMARY\\M\\ND", "SE", "SK\\SP", "FS", "tse2d1_15", "t2 tse tra fs", 90.0, 4000.0, None, None, "2D", None, None),
    ("DERIVED\\PRIMARY\\DIFFUSION\\ADC", "EP", "SK\\SP", "PFP\\FS", "ep_b1000", "ep2d diff adc map", 70.0, 5000.0, None, 1000.0, "2D", None, None),
    ("ORIGINAL\\PRIMARY\\M\\SWI", "GR", "SP", None, "swi3d1r", "t2 swi tra", 20.0, 28.0, None, None, "3D", None, None),
    ("DERIVED\\PRIMARY\\MINIP\\SWI", "GR", "SP", None, "swi3d1r", "minip images", 20.0, 28.0, None, None, "3D", None, None),
    ("ORIGINAL\\PRIMARY\\PHASE", "GR", "SP", None, None, "swan phase", 25.0, 50.0, None, None, "3D", None, None),
    ("DERIVED\\PRIMARY\\QMAP\\T1", "RM", None, None, None, "symri maps", None, None, None, None, None, None, None),
    ("DERIVED\\PRIMARY\\T2\\SYNTHETIC", "RM", None, None, None, "symri synthetic flair", None, None, None, None, None, None, None),
    ("ORIGINAL\\PRIMARY\\OTHER", "EP\\SE", None, None, None, "epimix t1w flair", 30.0, 5000.0, 600.0, None, "2D", None, None),
    ("ORIGINAL\\PRIMARY\\OTHER", "SE", None, None, None, "neuromix t2flair ssfse", 90.0, 8000.0, 2500.0, None, "2D", None, None),
    ("ORIGINAL\\PRIMARY\\OTHER", "EP\\GR", None, None, None, "ksepimix", 20.0, 3000.0, None, None, "2D", None, None),
    ("DERIVED\\SECONDARY\\MPR", "GR", None, None, None, "t1 mpr tra", 3.0, 2000.0, 900.0, None, "3D", None, None),
    ("ORIGINAL\\PRIMARY\\LOCALIZER", "GR", "SP", None, "fl2d1", "localizer", 4.0, 8.0, None, None, "2D", None, None),
    ("ORIGINAL\\PRIMARY\\M", "EP", "SK", None, "epfid2d1_64", "bold resting state mb6", 30.0, 800.0, None, None, "2D", None, None),
    ("ORIGINAL\\PRIMARY\\M", "SE\\IR", "SK\\SP\\MP", "IR\\PFP", "tir2d1_16", "t2 flair fs tirm cervical", 85.0, 9000.0, 2500.0, None, "2D", None, None),
    ("ORIGINAL\\PRIMARY\\M", "GR", "SP", "ACC_GEMS", None, "t1 vibe post gd", 2.4, 6.0, None, None, "3D", None, "gadovist"),
    ("ORIGINAL\\PRIMARY\\M", "SE", None, None, None, "utan kontrast axial", 12.0, 600.0, None, None, "2D", None, None),
    ("ORIGINAL\\PRIMARY\\M", "SE", None, None, None, "gradient echo t2*", 12.0, 600.0, None, None, "2D", None, None),
    ("ORIGINAL\\PRIMARY\\M", "RM", None, None, None, "unknown thing", None, None, None, None, None, None, None),
    ("DERIVED\\PRIMARY\\CBF", "EP", None, None, None, "rcbf", 30.0, 1500.0, None, None, "2D", None, None),
    ("ORIGINAL\\PRIMARY\\M", "SE", "SK", None, "tse2d1_5", "pd t2 dual brain and spine", 14.0, 3000.0, None, None, "2D", "multi_echo", None),
    (None, None, None, None, None, None, None, None, None, None, None, None, None),
    ("ORIGINAL\\PRIMARY\\M", "SE", None, None, None, "number of chamber cs[4] grappa 6/8", 100.0, 5000.0, None, None, "2D", None, None),
)
