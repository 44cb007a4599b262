"""Sanitiser queries: header elements as scanners write them, given to the rows of `part` as files, through each value rule."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from gneiss.operators import sanitise as s
from gneiss.plans.imaging import _list_sql, _model_sql, _sequence_sql, _vendor_sql, literal, samples, samples_sql
from gneiss.plans.registry import query
from gneiss.plans.series import KEY, _hmac_sql, _pseudonym_sql
from gneiss.functions import canonical as c

NAMES = "depth grp elem vr creator value"
METHOD = "local policy 1"
#: depth, group, element, kind, creator, value
ELEMENTS = [
    (0, 0x0040, 0x9210, "SH", None, "Philips"), (0, 0x0040, 0x9210, "SH", None, "Other"), (1, 0x0018, 0x9152, "SQ", None, "items"), (0, 0x0018, 0x0081, "DS", None, ""), (0, 0x0018, 0x0081, "DS", None, "30.5"), (1, 0x0008, 0x0008, "CS", None, "ORIGINAL\\PRIMARY\\M"),
    (0, 0x0008, 0x0008, "CS", None, "ORIGINAL\\PRIMARY\\M\\secret"), (0, 0x0008, 0x0008, "CS", None, "DERIVED\\PRIMARY\\DIFFUSION\\ADC"), (0, 0x7FE0, 0x0001, "OV", None, "0\\100"), (1, 0x7FE0, 0x0001, "OV", None, "0\\100"), (0, 0x7FE0, 0x0010, "OW", None, "pixels"),
    (0, 0x0018, 0x1060, "DS", None, "12"), (0, 0x0018, 0x9074, "DT", None, "20240102030405"), (0, 0x0008, 0x0020, "DA", None, "20240102"), (0, 0x0008, 0x0030, "TM", None, "101010"), (0, 0x0010, 0x0010, "PN", None, "Doe^Jane"), (0, 0x0010, 0x0020, "LO", None, "ID7"),
    (0, 0x0008, 0x0080, "LO", None, "A clinic"), (0, 0x0018, 0x1000, "LO", None, " 123456 "), (0, 0x0018, 0x1000, "LO", None, ""), (0, 0x0020, 0x000D, "UI", None, "1.2.3.4"), (0, 0x0020, 0x000E, "UI", None, "1.2.3.5\\1.2.3.6"), (0, 0x0008, 0x0016, "UI", None, "1.2.840.10008.5.1.4.1.1.4"),
    (0, 0x0008, 0x0016, "UI", None, "1.2.840.10008.5.1.4.1.1.7"), (1, 0x0008, 0x1150, "UI", None, "1.2.840.10008.5.1.4.1.1.7"), (1, 0x0008, 0x1150, "UI", None, "1.9.1"), (1, 0x0020, 0x9056, "SH", None, "stack 1"), (1, 0x0020, 0x9056, "SH", None, "a\\b"),
    (1, 0x0018, 0x9252, "LO", None, "our own labelling"), (1, 0x0018, 0x925B, "LO", None, "crusher by Jane"), (1, 0x0018, 0x925E, "LO", None, "q2"), (1, 0x0018, 0x9041, "LO", None, "Coil Works"), (1, 0x0008, 0x0104, "LO", None, "Brain of Doe"), (1, 0x0008, 0x0100, "SH", None, "T-A0100"),
    (1, 0x0008, 0x0102, "SH", None, "bad code"), (1, 0x0018, 0x9087, "FD", None, "1000.0"), (1, 0x0018, 0x9087, "FD", None, "-1"), (1, 0x0018, 0x9087, "DS", None, "10"), (1, 0x0018, 0x9089, "FD", None, "0.5\\0.5\\0.7"), (1, 0x0018, 0x9089, "FD", None, "0.5\\2"), (1, 0x0018, 0x9255, "FD", None, "1\\0\\0"),
    (1, 0x0018, 0x9255, "FD", None, "0.1\\0\\0"), (1, 0x0018, 0x9254, "FD", None, "0"), (1, 0x0018, 0x9253, "US", None, "12"), (1, 0x0020, 0x9157, "UL", None, "1\\2\\3"), (1, 0x0020, 0x9157, "UL", None, "1\\0"), (1, 0x0020, 0x9165, "AT", None, "00189087"), (1, 0x0020, 0x9162, "US", None, "0"),
    (0, 0x0008, 0x0070, "LO", None, "Siemens Healthineers"), (0, 0x0008, 0x1090, "LO", None, "prisma_fit"), (0, 0x0018, 0x0024, "SH", None, "*ep2d_bold"), (0, 0x0018, 0x0024, "SH", None, "own"), (0, 0x0018, 0x9005, "SH", None, "own"), (0, 0x0018, 0x0020, "CS", None, "EP\\XX\\GR"),
    (0, 0x0008, 0x9205, "CS", None, "monochrome"), (0, 0x0008, 0x9205, "CS", None, "secret"), (0, 0x0020, 0x0013, "IS", None, " 7 "), (0, 0x0020, 0x0013, "IS", None, "seven"), (0, 0x0020, 0x0032, "DS", None, "1.5\\-2e1\\.5"), (0, 0x0020, 0x0032, "DS", None, "1\\\\2"), (0, 0x0028, 0x0010, "US", None, "64"),
    (0, 0x0019, 0x100C, "IS", "SIEMENS MR HEADER", "1000"), (0, 0x0019, 0x100C, "IS", "Someone", "1000"), (0, 0x0019, 0x100D, "CS", "siemens mr header", "directional"), (0, 0x0019, 0x100E, "FD", "SIEMENS MR HEADER", "1\\0\\0"), (0, 0x0019, 0x100E, "FD", "SIEMENS MR HEADER", "9\\0\\0"), (0, 0x0019, 0x1027, "FD", "SIEMENS MR HEADER", "1\\2\\3\\4\\5\\6"),
    (0, 0x0065, 0x1050, "DS", "Image Private Header", "64"), (0, 0x0065, 0x1050, "DS", "Image Private Header", "64.5"), (0, 0x2001, 0x1003, "FL", "Philips Imaging DD 001", "700"), (0, 0x2001, 0x1004, "CS", "Philips Imaging DD 001", "I"), (0, 0x2005, 0x10B1, "FL", "Philips MR Imaging DD 001", "0.7"), (1, 0x2005, 0x1412, "IS", "Philips MR Imaging DD 005", "3"),
    (0, 0x0019, 0x10BC, "DS", "GEMS_ACQU_01", "-0.5"), (0, 0x0043, 0x1039, "IS", "GEMS_PARM_01", "1000\\8\\0\\0"), (0, 0x0043, 0x1039, "IS", "GEMS_PARM_01", "-4\\8\\0\\0"), (0, 0x0043, 0x10A3, "CS", "GEMS_PARM_01", "PULSED"), (0, 0x0043, 0x10A5, "IS", "GEMS_PARM_01", "1.5"), (0, 0x0043, 0x10B0, "LO", "GEMS_PARM_01", "free text"),
]


def _rows(table):
    return samples(table, ELEMENTS, NAMES)


def _flagged(table):
    file = F.col("file")
    return _rows(table).withColumn("enhanced", file % 2 == 0).withColumn("trigger_redundant", file % 3 == 0).withColumn("offsets_valid", file % 5 == 0).withColumn("vendor", F.when(file % 2 == 0, "Philips Medical Systems").otherwise("SIEMENS"))


_SAMPLES = samples_sql(ELEMENTS, NAMES)
_NUMBERS = "list_transform(string_split(value, '\\'), lambda x: TRY_CAST(trim(x) AS DOUBLE))"
_PRIVATE = f"""pt(p_creator, p_grp, p_low, p_high, p_vr, p_n, p_least, p_most, p_codes) AS (VALUES {', '.join('(' + ', '.join(map(literal, r)) + ')' for r in s.PRIVATE)}),
    pk AS (SELECT s.*, {_NUMBERS} AS v, pt.* FROM s LEFT JOIN pt ON upper(trim(creator)) = upper(p_creator) AND grp = p_grp AND elem % 256 BETWEEN p_low AND p_high AND vr = p_vr WHERE grp % 2 = 1),
    pv AS (SELECT file, i, grp, elem, creator, value, coalesce(CASE WHEN p_codes = '' THEN len(v) = p_n AND len(list_filter(v, lambda x: x IS NULL OR x NOT BETWEEN p_least AND p_most OR (p_vr = 'IS' AND x <> floor(x)))) = 0
        AND (p_grp <> 101 OR p_low <> 80 OR v[1] = floor(v[1])) AND (p_grp <> 67 OR p_low <> 57 OR v[1] BETWEEN 0 AND 1e6) ELSE list_contains(string_split(p_codes, ' '), upper(trim(value))) END, false) AS kept FROM pk)"""


@query(f"WITH {_SAMPLES}, {_PRIVATE} SELECT file, i, creator, kept FROM pv")
def private_allowlist(table):
    """Private elements by creator, kind, number and bounds of values; all others are dropped."""
    return s.private_value(_rows(table)).select("file", "i", "creator", "kept")


@query(f"WITH {_SAMPLES} SELECT file, i, {s.public_rule()} AS allowed FROM s WHERE grp % 2 = 0")
def public_allowlist(table):
    """Public elements by group, element ranges and kind."""
    return _rows(table).filter("grp % 2 = 0").select("file", "i", F.expr(s.public_rule()).alias("allowed"))


def _bounds_sql() -> str:
    parts = []
    for t, kind, few, many, least, most, extra in s.BOUNDS:
        bad = ["x IS NULL"] if kind != "AT" else ["false"]
        if least is not None:
            bad.append(f"x NOT BETWEEN {least} AND {most}")
        if extra == "positive":
            bad.append("x <= 0")
        fine = f"vr = '{kind}' AND len(v) BETWEEN {few} AND {many} AND len(list_filter(v, lambda x: {' OR '.join(bad)})) = 0"
        if extra == "unit":
            fine += " AND list_sum(list_transform(v, lambda x: x * x)) BETWEEN 0.5 AND 1.5"
        parts.append(f"WHEN {t} THEN ({fine})")
    return "CASE tag " + " ".join(parts) + " END"


def _uid_sql(value: str) -> str:
    h = _pseudonym_sql("uid", value)
    return f"'2.25.' || CAST(('0x' || substr({h}, 1, 12))::HUGEINT * 281474976710656 + ('0x' || substr({h}, 13, 12))::HUGEINT AS VARCHAR)"


_CODES = "CASE tag " + " ".join(f"WHEN {(g << 16) + e} THEN [{', '.join(map(literal, c.codes_of((g, e))))}]" for g, e in c.CODES) + " END"
_RULES = [
    ("R1", "tag = 0x00409210 AND depth = 0 AND enhanced AND trim(value) = 'Philips'", "NULL"),
    ("R4", "tag = 0x00189152 AND enhanced", "'WATER'"),
    ("R5", "tag = 0x00180081 AND depth = 0 AND enhanced AND trim(value) = ''", "NULL"),
    ("R6", "tag = 0x00080008 AND depth > 0", "NULL"),
    ("R7", "tag IN (0x7FE00001, 0x7FE00002)", "CASE WHEN depth = 0 AND offsets_valid THEN value END"),
    ("R8", "tag = 0x00181060 AND trigger_redundant", "NULL"),
    ("R9", "grp % 2 = 1", "CASE WHEN private_kept THEN value END"),
    ("R10", "vr = 'DT' AND tag IN (0x00189074, 0x00189151) AND enhanced", "'19000101000000'"),
    ("P4", "vr IN ('DA', 'DT', 'TM')", "NULL"),
    ("P2", f"NOT {s.public_rule()}", "NULL"),
    ("X34", "tag = 0x00181000 AND vr = 'LO'", f"CASE WHEN length(trim(value)) BETWEEN 1 AND 64 THEN 'SN-' || {_pseudonym_sql('dicom-device-serial-v1', 'value')} END"),
    ("R11", f"vr = 'UI' AND tag NOT IN ({', '.join(map(str, s.MEANT_UIDS))})", "uids"),
    ("R11", "vr = 'UI'", "CASE WHEN CASE WHEN tag = 0x00080016 AND depth = 0 THEN value IN ('1.2.840.10008.5.1.4.1.1.4', '1.2.840.10008.5.1.4.1.1.4.1', '1.2.840.10008.5.1.4.1.1.4.4') ELSE starts_with(value, '1.2.840.10008.') END THEN value END"),
    ("X34", "tag = 0x00209056 AND vr = 'SH'", f"CASE WHEN length(trim(value)) BETWEEN 1 AND 16 AND NOT contains(value, '\\') THEN substr({_pseudonym_sql('dicom-stack-id-v1', 'value')}, 1, 16) END"),
    ("X17", "tag = 0x00080008 AND vr = 'CS'", f"CASE WHEN enhanced THEN CASE WHEN value = 'DERIVED\\PRIMARY\\DIFFUSION\\ADC' THEN value END ELSE array_to_string(list_transform(string_split(value, '\\'), lambda x, j: CASE WHEN j < 3 OR upper(x) IN {_list_sql(c.CLASSIC_TERMS)} THEN upper(x) ELSE 'OTHER' END), '\\') END"),
    ("R12", "tag IN (0x00189252, 0x0018925B, 0x0018925E, 0x00189041, 0x00189050, 0x00080104) AND vr = 'LO'", "CASE tag WHEN 0x0018925B THEN 'REDACTED' WHEN 0x00080104 THEN 'ANATOMY' ELSE '' END"),
    ("X45", f"tag IN ({', '.join(str(b[0]) for b in s.BOUNDS)})", f"CASE WHEN {_bounds_sql()} THEN value END"),
    ("X8", f"tag IN ({', '.join(map(str, s.NAMED))})", f"CASE tag WHEN 0x00080070 THEN {_vendor_sql('value')} WHEN 0x00081090 THEN {_model_sql('value')} WHEN 0x00180024 THEN {_sequence_sql('value')} WHEN 0x00189005 THEN coalesce({_sequence_sql('value')}, 'OTHER') ELSE CASE WHEN regexp_full_match(trim(value), '[A-Za-z0-9_.-]{{1,16}}') THEN trim(value) END END"),
    ("X16", "vr = 'CS'", f"nullif(array_to_string(list_filter(list_transform(string_split(value, '\\'), lambda x: upper(trim(x))), lambda x: list_contains({_CODES}, x)), '\\'), '')"),
    ("R13", "vr = 'IS'", "CASE WHEN regexp_full_match(trim(value), '[+-]?[0-9]{1,18}') THEN trim(value) END"),
    ("R13", "vr = 'DS'", "CASE WHEN len(list_filter(v, lambda x: x IS NULL)) = 0 THEN array_to_string(list_transform(string_split(value, '\\'), lambda x: trim(x)), '\\') END"),
    ("R13", "true", "CASE WHEN vr IN ('US', 'SS', 'UL', 'SL', 'FL', 'FD', 'SQ', 'OB', 'OW', 'OV', 'AT') THEN value END"),
]
_RULES = [(name, *(re.sub("0x[0-9A-F]{8}", lambda m: str(int(m[0], 16)), x) for x in (when, then))) for name, when, then in _RULES]
_MARKED = f"""{_SAMPLES}, {_PRIVATE},
    u AS (SELECT s.*, s.grp * 65536 + s.elem AS tag, {_NUMBERS.replace('value', 's.value')} AS v, s.file % 2 = 0 AS enhanced, s.file % 3 = 0 AS trigger_redundant, s.file % 5 = 0 AS offsets_valid, coalesce(pv.kept, false) AS private_kept,
        CASE WHEN contains(s.value, '\\') THEN {_uid_sql("split_part(s.value, chr(92), 1)")} || '\\' || {_uid_sql("split_part(s.value, chr(92), 2)")} ELSE {_uid_sql('s.value')} END AS uids FROM s LEFT JOIN pv ON pv.file = s.file AND pv.i = s.i),
    m AS (SELECT file, i, grp, elem, vr, creator, value, CASE {' '.join(f"WHEN coalesce({w}, false) THEN '{n}'" for n, w, _ in _RULES)} END AS rule, CASE {' '.join(f"WHEN coalesce({w}, false) THEN {t}" for _, w, t in _RULES)} END AS kept FROM u)"""


@query(f"WITH {_MARKED} SELECT file, i, rule, kept FROM m")
def value_rules(table):
    """Every element through the ordered value rules: which rule decides, and what is kept."""
    return s.sanitised(_flagged(table), KEY).select("file", "i", "rule", "kept")


@query(f"WITH {_MARKED}, k AS (SELECT * FROM m WHERE kept IS NOT NULL) SELECT file, grp, elem, vr, kept AS value FROM k UNION ALL SELECT DISTINCT file, grp, elem // 256, 'LO', min(creator) OVER (PARTITION BY file, grp, elem // 256) FROM k WHERE grp % 2 = 1")
def creators_back(table):
    """Kept elements with the creators of the private ones put back, once a block."""
    kept = s.sanitised(_flagged(table), KEY).filter("kept is not null").drop("value").withColumnRenamed("kept", "value")
    return s.with_creators(kept)


@query(f"""
    WITH f AS (SELECT p_partkey AS file, {_pseudonym_sql('subject', "CAST(p_partkey % 50 AS VARCHAR)")} AS subject, p_partkey % 3 = 0 AS declared FROM part), {_MARKED},
    k AS (SELECT file, grp, elem, vr, kept AS value FROM m WHERE kept IS NOT NULL AND grp NOT IN (16, 18))
    SELECT * FROM k UNION ALL SELECT file, 16, 16, 'PN', subject FROM f UNION ALL SELECT file, 16, 32, 'LO', subject FROM f UNION ALL SELECT file, 18, 98, 'CS', 'YES' FROM f
    UNION ALL SELECT file, 18, 99, 'LO', '{METHOD}' FROM f UNION ALL SELECT file, 40, 771, 'CS', 'REMOVED' FROM f UNION ALL SELECT file, 40, 769, 'CS', 'NO' FROM f WHERE declared""")
def root_rewrites(table):
    """The root of each file rewritten: subject for name and id, method, marks."""
    from gneiss.functions import ids

    kept = s.sanitised(_flagged(table), KEY).filter("kept is not null").select("file", "grp", "elem", "vr", F.col("kept").alias("value"))
    files = table("part").select(F.col("p_partkey").alias("file"), ids.pseudonym(KEY, "subject", (F.col("p_partkey") % 50).cast("string")).alias("subject"), (F.col("p_partkey") % 3 == 0).alias("declared"))
    return s.with_root(kept, files, METHOD)


@query(f"WITH {_MARKED} SELECT file, array_to_string(list_sort(list(DISTINCT rule)), ',') AS exceptions FROM m WHERE kept IS DISTINCT FROM value GROUP BY 1")
def rule_exceptions(table):
    """Which rules changed or dropped something in each file."""
    return s.exceptions(s.sanitised(_flagged(table), KEY))


@query(f"""
    SELECT p_partkey, CASE WHEN length(trim(p_brand)) BETWEEN 1 AND 16 THEN substr({_pseudonym_sql('dicom-stack-id-v1', 'p_brand')}, 1, 16) END AS stack_id, 'SN-' || {_pseudonym_sql('dicom-device-serial-v1', "'dev' || p_partkey")} AS serial,
        substr({_hmac_sql("'protocol-group-v1'::BLOB || encode(p_type)")}, 1, 24) AS group_id FROM part""")
def stack_ids(table):
    """Stack identifiers, device serials and protocol group identifiers."""
    from gneiss.functions import ids

    name = F.trim("p_brand")
    stack = F.when(F.length(name).between(1, 16), F.substring(ids.pseudonym(KEY, "dicom-stack-id-v1", name), 1, 16))
    serial = F.concat(F.lit("SN-"), ids.pseudonym(KEY, "dicom-device-serial-v1", F.concat(F.lit("dev"), F.col("p_partkey").cast("string"))))
    group = F.substring(ids.keyed_digest(KEY, F.concat(F.lit(b"protocol-group-v1"), F.encode("p_type", "UTF-8"))), 1, 24)
    return table("part").select("p_partkey", stack.alias("stack_id"), serial.alias("serial"), group.alias("group_id"))
