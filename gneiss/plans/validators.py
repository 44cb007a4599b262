"""Validator queries: items, objects and frames as scanners write them, given to the rows of `part`, against each contract."""

from __future__ import annotations

from pyspark.sql import functions as F

from gneiss.functions.text import upper_by_character
from gneiss.operators import rules
from gneiss.operators import validators as v
from gneiss.plans.elements import ELEMENTS, NAMES
from gneiss.plans.imaging import _list_sql, literal, samples, samples_sql
from gneiss.plans.registry import query

#: b value, directionality, items and text of the gradient macro (null: absent), the same of the matrix.
ITEMS = [
    (0.0, "NONE", 0, None, 0, None), (1.0, "NONE", 1, "0\\0\\1", 0, None), (1000.0, "DIRECTIONAL", 1, "0.6\\0\\0.8", 0, None), (1000.0, "DIRECTIONAL", 1, "0.1\\0\\0", 0, None), (1000.0, "DIRECTIONAL", 2, "0.6\\0\\0.8", 0, None),
    (1000.0, "ISOTROPIC", 0, None, 0, None), (0.5, "ISOTROPIC", 0, None, 0, None), (700.0, "BMATRIX", 0, None, 1, "1\\2\\3\\4\\5\\6"), (700.0, "BMATRIX", 0, None, 1, "1\\2\\3"), (None, "NONE", 0, None, 0, None), (-5.0, "NONE", 0, None, 0, None), (50.0, "OTHER", 0, None, 0, None),
]
_ITEM_NAMES = "b direction g_items gradient m_items matrix"
_DOUBLES = "list_transform(string_split({0}, '\\'), lambda x: CAST(x AS DOUBLE))"
_UNIT = "(len({0}) = 3 AND len(list_filter({0}, lambda x: x NOT BETWEEN -1.1 AND 1.1)) = 0 AND list_sum(list_transform({0}, lambda x: x * x)) BETWEEN 0.5 AND 1.5)"


def doubles(name: str):
    return F.transform(F.split(name, r"\\"), lambda x: x.cast("double"))


@query(f"""
    WITH {samples_sql(ITEMS, _ITEM_NAMES)}, l AS (SELECT *, {_DOUBLES.format('gradient')} AS g, {_DOUBLES.format('matrix')} AS m FROM s),
    t AS (SELECT *, CASE WHEN gradient IS NULL THEN 'Absent' WHEN g_items = 1 AND {_UNIT.format('g')} THEN 'Valid' ELSE 'Invalid' END AS gs, CASE WHEN matrix IS NULL THEN 'Absent' WHEN m_items = 1 AND len(m) = 6 THEN 'Valid' ELSE 'Invalid' END AS ms FROM l)
    SELECT file, i, gs AS gradient_state, ms AS matrix_state, coalesce(b BETWEEN 0 AND 1e6 AND CASE direction WHEN 'NONE' THEN b <= 1 AND gs || ms = 'AbsentAbsent' WHEN 'ISOTROPIC' THEN b > 1 AND gs || ms = 'AbsentAbsent'
        WHEN 'DIRECTIONAL' THEN b > 1 AND gs || ms = 'ValidAbsent' WHEN 'BMATRIX' THEN b > 1 AND gs || ms = 'AbsentValid' ELSE false END, false) AS valid FROM t""")
def diffusion_items(table):
    """Public diffusion items: three-valued states of both forms of direction, and the item rule."""
    rows = samples(table, ITEMS, _ITEM_NAMES)
    g = v.macro_state(F.col("gradient").isNotNull(), F.col("g_items"), v.unit_vector(doubles("gradient")))
    m = v.macro_state(F.col("matrix").isNotNull(), F.col("m_items"), F.size(doubles("matrix")) == 6)
    return rows.select("file", "i", g.alias("gradient_state"), m.alias("matrix_state"), v.diffusion_item(F.col("b"), F.col("direction"), g, m).alias("valid"))


VENDORS = [
    ("siemens", 0.0, None, None, None), ("siemens", 0.0, "NONE", "0\\0\\0", None), ("siemens", 1000.0, "DIRECTIONAL", "1\\0\\0", None), ("siemens", 1000.0, "DIRECTIONAL", "0\\0\\0", None), ("siemens", 1000.0, "BMATRIX", None, "1\\2\\3\\4\\5\\6"), ("siemens", 1000.0, "ISOTROPIC", None, None),
    ("siemens", 1000.0, None, "1\\0\\0", None), ("philips", 1000.0, "ISOTROPIC", "0\\0\\0", None), ("philips", 1000.0, "RL", "1\\0\\0", None), ("philips", 1000.0, "NONE", "1\\0\\0", None), ("ge", 1000.0, None, "0\\1\\0", None), ("ge", 0.0, None, "0\\1\\0", None), ("ge", 1000.0, None, None, None),
    ("uih", 800.0, None, "0.6\\0.8\\0", None), ("uih", None, None, "0.6\\0.8\\0", None),
]
_VENDOR_NAMES = "vendor b direction gradient matrix"
_ZERO = "({0} IS NULL OR len(list_filter({0}, lambda x: abs(x) > 1e-6)) = 0)"
_VENDOR_SQL = f"""{samples_sql(VENDORS, _VENDOR_NAMES, 2)}, l AS (SELECT *, {_DOUBLES.format('gradient')} AS g, {_DOUBLES.format('matrix')} AS m FROM s),
    t AS (SELECT *, coalesce(b BETWEEN 0 AND 1e6 AND CASE WHEN b <= 1 THEN coalesce(direction, 'NONE') = 'NONE' AND {_ZERO.format('g')} AND {_ZERO.format('m')}
        WHEN vendor = 'siemens' THEN CASE direction WHEN 'DIRECTIONAL' THEN g IS NOT NULL AND {_UNIT.format('g')} AND {_ZERO.format('m')} WHEN 'BMATRIX' THEN m IS NOT NULL AND {_ZERO.format('g')} WHEN 'ISOTROPIC' THEN g IS NULL AND m IS NULL ELSE false END
        WHEN vendor = 'philips' THEN CASE coalesce(direction, '') WHEN 'ISOTROPIC' THEN {_ZERO.format('g')} WHEN 'NONE' THEN false ELSE g IS NOT NULL AND {_UNIT.format('g')} END
        ELSE g IS NOT NULL AND {_UNIT.format('g')} END, false) AS valid FROM l)"""


def _vendor_rows(table):
    rows = samples(table, VENDORS, _VENDOR_NAMES, 2)
    fine = v.vendor_diffusion(F.col("vendor"), F.col("b"), F.col("direction"), doubles("gradient"), doubles("matrix"))
    return rows.withColumn("valid", fine)


@query(f"WITH {_VENDOR_SQL} SELECT file, i, vendor, valid FROM t")
def vendor_diffusion(table):
    """Private diffusion fields by vendor."""
    return _vendor_rows(table).select("file", "i", "vendor", "valid")


@query(f"""
    WITH {_VENDOR_SQL}, p AS (SELECT * FROM t WHERE (file + i) % 7 < 2), w AS (SELECT file, vendor, bool_and(valid) AS valid, bool_or(coalesce(b > 1, false) OR coalesce(direction IN ('ISOTROPIC', 'DIRECTIONAL', 'BMATRIX'), false)) AS semantic FROM p GROUP BY 1, 2)
    SELECT file, count(*) AS present, count(*) = 1 AND bool_and(valid) AS valid, bool_or(semantic) AS semantic FROM w GROUP BY 1""")
def one_vendor(table):
    """A file's private diffusion contract: valid only with exactly one vendor's fields."""
    return v.one_vendor(_vendor_rows(table).filter("(file + i) % 7 < 2"))


ASL = [
    ("LABEL", "NO", None, None, "NO", 0, None, 2), ("CONTROL", "YES", 3.0, "text", "NO", 0, None, 1), ("CONTROL", "YES", None, "text", "NO", 0, None, 1), ("LABEL", "NO", 1.0, None, "NO", 0, None, 1), ("M_ZERO_SCAN", "NO", None, None, "YES", 1, 700, 0),
    ("M_ZERO_SCAN", "NO", None, None, "YES", 2, 700, 0), ("LABEL", "NO", None, None, "NO", 0, None, 0), ("LABEL", "MAYBE", None, None, "NO", 0, None, 1), (None, "NO", None, None, "NO", 0, None, 1), ("LABEL", "NO", None, None, "YES", 1, 200000000, 1), ("LABEL", "NO", None, None, "NO", 1, None, 1), ("LABEL", "YES", 2.0, "", "NO", 0, None, 1),
]
_ASL_NAMES = "context crusher flow description bolus bolus_items delay slabs"


@query(f"""
    WITH {samples_sql(ASL, _ASL_NAMES)} SELECT file, i, coalesce(context IN ('LABEL', 'CONTROL', 'M_ZERO_SCAN') AND CASE crusher WHEN 'YES' THEN flow BETWEEN 0 AND 1e12 AND length(description) BETWEEN 1 AND 64 WHEN 'NO' THEN flow IS NULL AND description IS NULL END
        AND CASE bolus WHEN 'YES' THEN bolus_items = 1 AND delay BETWEEN 0 AND 100000000 WHEN 'NO' THEN bolus_items = 0 END AND (context = 'M_ZERO_SCAN' OR slabs > 0), false) AS valid FROM s""")
def asl_items(table):
    """Perfusion items: flags against the fields they ask for or forbid."""
    c = {n: F.col(n) for n in _ASL_NAMES.split()}
    return samples(table, ASL, _ASL_NAMES).select("file", "i", v.asl_item(*c.values()).alias("valid"))


PIXELS = [
    (v.CLASSIC, 64, 64, 1, "MONOCHROME2", 16, 12, 11, 0, False, None), (v.CLASSIC, 63, 3, 1, "MONOCHROME1", 16, 16, 15, 1, False, 1), (v.CLASSIC, 64, 64, 3, "RGB", 8, 8, 7, 0, True, None), (v.CLASSIC, 64, 64, 1, "MONOCHROME2", 16, 12, 12, 0, False, None), (v.ENHANCED, 7, 3, 1, "MONOCHROME2", 8, 8, 7, 0, False, 5),
    (v.ENHANCED, 64, 64, 1, "MONOCHROME2", 16, 12, 11, 0, False, None), (v.LEGACY, 64, 64, 1, "MONOCHROME2", 16, 16, 15, 0, False, 30), (v.LEGACY, 64, 64, 1, "MONOCHROME1", 16, 16, 15, 0, False, 30), ("1.2.3", 64, 64, 1, "MONOCHROME2", 16, 16, 15, 0, False, 1), (v.CLASSIC, 0, 64, 1, "MONOCHROME2", 16, 12, 11, 0, False, None), (v.CLASSIC, 64, 64, 1, None, 16, 12, 11, 0, False, 2),
]
_PIXEL_NAMES = "sop rows columns samples photometric allocated stored high representation planar frames"


@query(f"""
    WITH {samples_sql(PIXELS, _PIXEL_NAMES)}, t AS (SELECT *, CAST(rows AS BIGINT) * columns * samples * coalesce(frames, 1) * (allocated // 8) AS raw FROM s)
    SELECT file, i, CASE WHEN rows > 0 AND columns > 0 AND samples = 1 AND representation IN (0, 1) AND high + 1 = stored AND NOT planar AND (
        (sop = '{v.CLASSIC}' AND photometric IN ('MONOCHROME1', 'MONOCHROME2') AND allocated = 16 AND stored BETWEEN 1 AND 16 AND coalesce(frames, 1) = 1)
        OR (sop IN ('{v.ENHANCED}', '{v.LEGACY}') AND photometric = 'MONOCHROME2' AND (allocated, stored) IN ((8, 8), (16, 12), (16, 16)) AND frames IS NOT NULL)) THEN raw + raw % 2 END AS bytes FROM t""")
def pixel_module(table):
    """Pixel modules by storage class, and the bytes their pixels must have."""
    c = {n: F.col(n) for n in _PIXEL_NAMES.split()}
    return samples(table, PIXELS, _PIXEL_NAMES).select("file", "i", v.pixel_module(c).alias("bytes"))


TRANSFORMS = [
    ("00280010", True, True, False), ("00281052 00281053 00281054", True, False, False), ("00281052 00281053 00281054", False, False, False), ("00281052 00281053", True, False, True), ("00281050 00281051", False, True, True), ("00281050", True, True, False), ("00281050 00281051 00281055", False, True, True),
    ("00281050 00281051 00281055", False, True, False), ("00283010", True, True, False), ("00281101 00281050", True, True, True), ("00409096", False, False, False), ("", True, True, True),
]
_TRANSFORM_NAMES = "tags rescale_here window_here sanitised"


@query(f"""
    WITH {samples_sql(TRANSFORMS, _TRANSFORM_NAMES)}, t AS (SELECT *, string_split(tags, ' ') AS l FROM s),
    n AS (SELECT *, len(list_filter(l, lambda x: x IN ('00281052', '00281053', '00281054'))) AS r, len(list_filter(l, lambda x: x IN ('00281050', '00281051'))) AS w FROM t)
    SELECT file, i, array_to_string(list_filter([CASE WHEN len(list_filter(l, lambda x: x IN {_list_sql(v.FORBIDDEN.split())})) > 0 THEN 'unsupported' END, CASE WHEN r > 0 AND (NOT rescale_here OR r < 3) THEN 'rescale' END,
        CASE WHEN w = 1 OR (w = 2 AND NOT window_here) THEN 'window' END, CASE WHEN sanitised AND list_contains(l, '00281055') THEN 'explanation' END], lambda x: x IS NOT NULL), ',') AS codes FROM n""")
def pixel_transforms(table):
    """Pixel transforms: forbidden ones, complete rescale triplets and window pairs in their places."""
    rows = samples(table, TRANSFORMS, _TRANSFORM_NAMES)
    codes = v.transform_codes(F.split("tags", " "), F.col("rescale_here"), F.col("window_here"), F.col("sanitised"))
    return rows.select("file", "i", F.array_join(codes, ",").alias("codes"))


@query(f"""
    WITH {samples_sql(ELEMENTS, NAMES)}, t AS (SELECT *, grp * 65536 + elem AS tag FROM s), f AS (SELECT DISTINCT file FROM t), r(tag, vr) AS (VALUES {', '.join(f"({t}, '{k}')" for t, k in v.REQUIRED)}),
    m AS (SELECT f.file, r.tag, bool_or(coalesce(trim(t.value) <> '', false)) AS there FROM f CROSS JOIN r LEFT JOIN t ON t.file = f.file AND t.tag = r.tag AND t.vr = r.vr AND t.depth = 0 GROUP BY 1, 2),
    u AS (SELECT file, count(*) FILTER (WHERE tag IN ({', '.join(map(str, v.PSEUDONYMOUS))}) AND depth = 0 AND NOT (starts_with(value, '2.25.') AND length(value) <= 64)) AS foreign_uids FROM t GROUP BY 1)
    SELECT m.file, coalesce(string_agg(printf('%08X', m.tag), ',' ORDER BY [{', '.join(str(t) for t, _ in v.REQUIRED)}].list_position(m.tag)) FILTER (WHERE NOT there), '') AS missing, any_value(foreign_uids) AS foreign_uids FROM m JOIN u ON u.file = m.file GROUP BY 1""")
def required_attributes(table):
    """Required attributes that are missing, and identifiers that are no pseudonyms."""
    return v.missing_required(samples(table, ELEMENTS, NAMES))


REFERENCES = [(k, t) for k, tags in enumerate(("00081150 00081155", "00081150", "00081150 00081155 00081160 0040A170", "00081150 00081155 00080000", "00081150 00081155 0040A170", "00081150 00081150 00081155")) for t in tags.split()]


@query(f"""
    WITH {samples_sql(REFERENCES, 'item tag', 99)}, g AS (SELECT file, item, list_sort(list(tag)) AS tags FROM s GROUP BY 1, 2)
    SELECT file, item, list_filter(tags, lambda x: x <> '00080000') = ['00081150', '00081155'] AS classic, tags = ['00081150', '00081155', '00081160', '0040A170'] AS enhanced FROM g""")
def reference_items(table):
    """Reference items whose children are exactly those a reference may have."""
    items = v.children(samples(table, REFERENCES, "item tag", 99), ["file", "item"], "tag")
    return items.select("file", "item", v.is_set(F.col("tags"), v.CLASSIC_REFERENCE, "00080000").alias("classic"), v.is_set(F.col("tags"), v.ENHANCED_REFERENCE).alias("enhanced"))


CONTEXTS = [("52009229 00189341", "1.2.840.10008.6.1.4", 0x18, None), ("00189341", "1.2.3", 0x19, "x"), ("00081140 0040A170", "1.2.840.10008.6.1.508", 0x20, None), ("0040A170 00081140", "1.2.840.10008.6.1.508", 0x20, "maker"), ("", "1.2.840.10008.6.1.4", 0x21, None)]


@query(f"""
    WITH {samples_sql(CONTEXTS, 'path value pointed creator')}, t AS (SELECT *, string_split(path, ' ')[-1] AS last FROM s)
    SELECT file, i, coalesce(CASE last {' '.join(f"WHEN '{k}' THEN value = '{x}'" for k, x in v.CONTEXT_PLACES.items())} END, false) AS context_fits, pointed % 2 = 0 AND creator IS NULL AS pointer_fits FROM t""")
def context_places(table):
    """Context identifiers under the sequences that may hold them, and dimension pointers to public groups."""
    rows = samples(table, CONTEXTS, "path value pointed creator")
    return rows.select("file", "i", v.context_places(F.split("path", " "), F.col("value")).alias("context_fits"), v.dimension_pointer(F.col("pointed"), F.col("creator")).alias("pointer_fits"))


@query("""
    WITH m AS (SELECT l_orderkey AS file, l_linenumber AS macro, CASE WHEN l_returnflag = 'A' THEN 'shared' ELSE 'frame' END AS place, 2 AS frames FROM lineitem)
    SELECT file, macro, (count(*) FILTER (WHERE place = 'shared') = 1 AND count(*) FILTER (WHERE place = 'frame') = 0) OR (count(*) FILTER (WHERE place = 'shared') = 0 AND count(*) FILTER (WHERE place = 'frame') = max(frames)) AS fits FROM m GROUP BY 1, 2""")
def frame_macros(table):
    """Macros given once for all frames or once in each."""
    m = table("lineitem").select(F.col("l_orderkey").alias("file"), F.col("l_linenumber").alias("macro"), F.when(F.col("l_returnflag") == "A", "shared").otherwise("frame").alias("place"), F.lit(2).alias("frames"))
    return v.frame_macros(m)


@query("""
    WITH f AS (SELECT o_custkey AS file, CASE WHEN o_orderstatus = 'P' THEN 'DERIVED' ELSE 'ORIGINAL' END AS origin, o_orderstatus <> 'P' OR o_orderkey % 50 = 0 AS macro, CASE WHEN o_custkey % 3 = 0 THEN 'ORIGINAL' ELSE 'MIXED' END AS root FROM orders)
    SELECT file, min(root) = CASE WHEN count(DISTINCT origin) > 1 THEN 'MIXED' ELSE min(origin) END AND bool_and((origin = 'ORIGINAL') = macro) AS fits FROM f GROUP BY 1""")
def frame_origins(table):
    """The root's type against the set of its frames' origins."""
    o = table("orders")
    f = o.select(F.col("o_custkey").alias("file"), F.when(F.col("o_orderstatus") == "P", "DERIVED").otherwise("ORIGINAL").alias("origin"), ((F.col("o_orderstatus") != "P") | (F.col("o_orderkey") % 50 == 0)).alias("macro"), F.when(F.col("o_custkey") % 3 == 0, "ORIGINAL").otherwise("MIXED").alias("root"))
    return v.frame_origins(f)


@query("""
    WITH b AS (SELECT o_custkey AS folder, o_orderkey AS path, o_totalprice AS size, o_orderstatus AS modified FROM orders WHERE o_orderkey % 97 <> 0), a AS (SELECT o_custkey AS folder, o_orderkey AS path, o_totalprice AS size, CASE WHEN o_orderkey % 89 = 0 THEN 'x' ELSE o_orderstatus END AS modified FROM orders WHERE o_orderkey % 101 <> 0)
    SELECT coalesce(b.folder, a.folder) AS folder, bool_and(coalesce(a.size = b.size AND a.modified = b.modified, false)) AS stable FROM b FULL JOIN a ON b.folder = a.folder AND b.path = a.path GROUP BY 1""")
def folder_stability(table):
    """Folders in which nothing changed between two scans."""
    o = table("orders")
    scan = lambda rows, modified: rows.select(F.col("o_custkey").alias("folder"), F.col("o_orderkey").alias("path"), F.col("o_totalprice").alias("size"), modified.alias("modified"))
    return v.stable(scan(o.filter("o_orderkey % 97 <> 0"), F.col("o_orderstatus")), scan(o.filter("o_orderkey % 101 <> 0"), F.when(F.col("o_orderkey") % 89 == 0, "x").otherwise(F.col("o_orderstatus"))))


@query("""
    SELECT doc_id, sha256(encode(substr(coalesce(text, ''), 11, 40))) = sha256(encode(substr(CASE WHEN doc_id % 5 = 0 THEN upper(coalesce(text, '')) ELSE coalesce(text, '') END, 11, 40))) AS same_span FROM documents""")
def span_audit(table):
    """Digests of a span before and after rewriting must be equal. The rewriting keeps places, so only the span is rewritten."""
    span = F.substring(F.coalesce("text", F.lit("")), 11, 40)
    after = F.when(F.col("doc_id") % 5 == 0, upper_by_character(span)).otherwise(span)
    return table("documents").select("doc_id", (F.sha2(span, 256) == F.sha2(after, 256)).alias("same_span"))


MESSAGES = [(m + (" (0008,0016)" if how == "^" else ""),) for how, m, _ in v.HOLDS] + [("some other failure",), ("DICOM contains an invalid UID here",), (None,)]


@query(f"""
    WITH {samples_sql(MESSAGES, 'message')} SELECT file, i, CASE {' '.join(f"WHEN {'message = ' + literal(m) if how == '=' else 'starts_with(message, ' + literal(m) + ')'} THEN '{code}'" for how, m, code in v.HOLDS)} END AS code FROM s""")
def hold_codes(table):
    """Hold codes of messages."""
    return samples(table, MESSAGES, "message").select("file", "i", v.hold_code(F.col("message")).alias("code"))


def _lit_list(values: str) -> list[str]:
    return values.split()


#: One grouped series for each gate and kind: what differs from a series that passes.
SERIES = [
    {}, {"study_uid": ""}, {"duplicate_instance": True}, {"instances": 500001}, {"unreadable": 1}, {"largest": 1 << 37}, {"bytes": 1 << 37}, {"mixed_subject": True}, {"metadata_conflict": True}, {"classes": ""}, {"classes": v.SECONDARY[0]}, {"classes": "1.2.3"}, {"modalities": ""}, {"modalities": "MR CT"},
    {"burned_in": "YES"}, {"overlay_or_graphics": True}, {"burned_in_missing": True, "classes": v.ENHANCED}, {"burned_in_missing": True, "all_original_primary": False}, {"image_type": "original primary mosaic"}, {"grid": True}, {"local": "x dwi 64"}, {"local": "x asl"}, {"local": "x dwi asl", "diffusion_verified": True, "asl_verified": True},
    {"private_scaling": True}, {"image_type": "derived secondary adc", "local": "x dwi"}, {"local": "x dwi", "diffusion_verified": True}, {"local": "x asl", "asl_verified": True}, {"local": "dsc perfusion"}, {"local": "gre_field map"}, {"local": "bold sbref"}, {"local": "localizer"}, {"local": "x mprage"}, {"local": "t2 space"}, {"local": "anatomical"},
    {"image_type": "derived primary"}, {"scanning": "GR", "sequence": "fl3d", "image_type": "original primary m"}, {"temporal": 1}, {"tr": 50.0}, {"local": "rest bold", "echo_planar": "YES"}, {"image_type": "original primary mosaic", "csa_safe": True},
]
PASSING = {
    "study_uid": "1.2", "series_uid": "1.3", "duplicate_instance": False, "instances": 300, "unreadable": 0, "largest": 100000, "bytes": 30000000, "mixed_subject": False, "metadata_conflict": False, "classes": v.CLASSIC, "modalities": "MR", "burned_in": "NO", "overlay_or_graphics": False,
    "burned_in_missing": False, "all_original_primary": True, "image_type": "original primary m fmri", "csa_safe": False, "grid": False, "grid_verified": False, "local": "run 1", "diffusion_verified": False, "asl_verified": False, "private_scaling": False, "private_scaling_verified": False,
    "scanning": "EP", "sequence": "ep2d_bold", "echo_planar": None, "tr": 2000.0, "temporal": 100,
}
SERIES_ROWS = [tuple((PASSING | s).values()) for s in SERIES]
_SERIES_NAMES = " ".join(PASSING)


def _has(column: str, needles: str) -> str:
    return "(" + " OR ".join(f"contains({column}, '{n}')" for n in needles.split("|")) + ")"


_ALL = "(image_type || ' ' || lower(scanning) || ' ' || sequence || ' ' || local)"
_GATE_SQL = [
    ("study_uid = '' OR series_uid = ''", "missing_required_uid"), ("duplicate_instance", "invalid_sop_instance_identity"), ("instances > 500000", "series_exceeds_dicom_instance_limit"), ("unreadable > 0", "source_file_changed_or_unreadable"), ("largest > 68719476736", "dicom_instance_exceeds_64_gib"),
    ("bytes > 68719476736", "series_exceeds_64_gib_uncompressed_dicom_limit"), ("mixed_subject", "mixed_subject_series"), ("metadata_conflict", "inconsistent_series_metadata"), ("classes = ''", "missing_required_sop_class"), (f"classes IN {_list_sql(v.SECONDARY)}", "secondary_capture"),
    (f"classes NOT IN {_list_sql((v.CLASSIC, v.ENHANCED, v.LEGACY))}", "unsupported_sop_class"), ("modalities = ''", "missing_required_modality"), ("modalities <> 'MR'", "not_mr"), ("burned_in <> 'NO'", "burned_in_annotation"), ("overlay_or_graphics", "overlay_or_graphics"),
    (f"burned_in_missing AND classes <> '{v.CLASSIC}'", "enhanced_mr_burned_in_annotation_not_declared"), ("burned_in_missing AND NOT all_original_primary", "burned_in_annotation_not_declared_unsafe_image_type"), ("contains(image_type, 'mosaic') AND NOT csa_safe", "classic_mosaic_requires_safe_csa"),
    ("grid AND NOT grid_verified", "uih_grid_slice_count_missing_or_invalid"), ("acquired AND NOT diffusion_verified", "diffusion_scientific_metadata_incomplete"), ("asl AND NOT asl_verified", "asl_scientific_metadata_incomplete"), ("diffusion AND asl", "ambiguous_diffusion_and_asl_scientific_context"),
    ("private_scaling AND NOT private_scaling_verified", "philips_private_scientific_metadata_incomplete"),
]
_KIND_SQL = [
    ("derived_diffusion", "derived_mr", "0.99"), ("diffusion", "diffusion", "0.99"), ("asl", "asl_perfusion", "0.99"), (_has(_ALL, "perfusion| dsc| dce"), "perfusion", "0.98"), (_has(_ALL, "fieldmap|field map| fmap|topup|pepolar|blip|gre_field|b0map|se ap|se pa"), "fieldmap", "0.98"), (_has(_ALL, "sbref|single band ref|single-band ref"), "sbref", "0.99"),
    (_has(_ALL, "localizer|scout|survey|locator|three plane|3-plane"), "localizer", "0.99"), (f"{_has(_ALL, 'mprage|mp-rage|t1w|spgr|bravo')} OR list_contains(regexp_split_to_array({_ALL}, '[^A-Za-z0-9]'), 't1')", "structural_t1w", "0.98"),
    (f"{_has(_ALL, 't2w|flair')} OR list_has_any(regexp_split_to_array({_ALL}, '[^A-Za-z0-9]'), ['t2', 'space'])", "structural_t2w", "0.98"), (_has(_ALL, "structural|anatomical"), "structural_other", "0.95"), ("derived", "derived_mr", "0.99"),
    ("strong AND temporal >= 2 AND tr BETWEEN 100 AND 20000", "functional_epi", "least(0.95, 0.90 + 0.01 * least(score, 5))"), ("true", "other_mr", "0.90"),
]


@query(f"""
    WITH {samples_sql(SERIES_ROWS, _SERIES_NAMES)}, d AS (SELECT *, {_has('image_type', 'derived|secondary|adc|tracew|fa map|overlay|graphic|presentation')} OR {_has(_ALL, 'screensave|secondary capture|derived')} AS derived, {_has(_ALL, 'diffusion| dwi|dti|b0 map|tracew')} AS diffusion,
        {_has(_ALL, ' arterial spin| asl|pcasl|pasl')} AS asl, {_has('image_type', 'original|mixed')} AS kept, scanning = 'EP' OR coalesce(echo_planar = 'YES', false) OR {_has('image_type', 'epi|bold|fmri')} OR {_has('sequence', 'ep2d|epfid|epi|bold')} AS strong,
        CASE WHEN scanning = 'EP' THEN 2 ELSE 0 END + CASE WHEN echo_planar = 'YES' THEN 2 ELSE 0 END + CASE WHEN {_has('image_type', 'epi|bold|fmri')} THEN 2 ELSE 0 END + CASE WHEN {_has('sequence', 'ep2d|epfid|epi|bold')} THEN 2 ELSE 0 END
        + CASE WHEN {_has('local', 'bold|fmri|functional|rest|task|movie|retinotopy')} THEN 3 ELSE 0 END + CASE WHEN tr BETWEEN 100 AND 20000 THEN 1 ELSE 0 END + CASE WHEN temporal >= 2 THEN 2 ELSE 0 END AS score FROM s),
    e AS (SELECT *, diffusion AND derived AND NOT kept AS derived_diffusion, diffusion AND NOT (derived AND NOT kept) AS acquired FROM d),
    g AS (SELECT *, CASE {' '.join(f"WHEN {w} THEN '{k}'" for w, k in _GATE_SQL)} END AS gate, CASE {' '.join(f"WHEN {w} THEN '{k}'" for w, k, _ in _KIND_SQL)} END AS detected, CASE {' '.join(f"WHEN {w} THEN {x}" for w, _, x in _KIND_SQL)} END AS how FROM e)
    SELECT file, i, CASE WHEN gate = 'not_mr' THEN 'excluded' WHEN gate IS NOT NULL THEN 'held' WHEN detected = 'functional_epi' THEN 'accepted' ELSE 'excluded' END AS decision, coalesce(gate, CASE WHEN detected = 'functional_epi' THEN detected ELSE 'not_functional_epi' END) AS kind,
        CASE WHEN gate IS NULL THEN detected END AS detected, CAST(CASE WHEN gate IS NULL THEN how ELSE 1.0 END AS DOUBLE) AS confidence FROM g""")
def series_gates(table):
    """Grouped series through all gates and the detected kind, with its confidence."""
    rows = samples(table, SERIES_ROWS, _SERIES_NAMES)
    words = lambda n: F.filter(F.split(n, " "), lambda x: x != "")
    rows = rows.select("*", F.array(*map(F.lit, v.SECONDARY)).alias("secondary_classes"), F.array(*map(F.lit, (v.CLASSIC, v.ENHANCED, v.LEGACY))).alias("allowed_classes"))
    rows = rows.withColumn("classes", words("classes")).withColumn("modalities", words("modalities")).withColumn("burned_in", words("burned_in"))
    return rules.classified(rows).select("file", "i", "decision", "kind", "detected", "confidence")
