"""Imaging attributes: canonical forms on raw values as scanners write them, given to the rows of `part`."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.functions import canonical as c
from gneiss.plans.registry import query


def literal(v) -> str:
    """A value as SQL."""
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).lower()
    return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else repr(v)


def samples(table, rows: list[tuple], names: str, step: int = 4) -> DataFrame:
    """(file, i, *names): each part's share of the sample rows, without a join."""
    cells = [F.struct(F.lit(i).alias("i"), *[F.lit(v).alias(n) for n, v in zip(names.split(), r)]) for i, r in enumerate(rows)]
    # each key becomes many rows, so the keys, a small column, are dealt out over all cores before that
    keys = table("part").select(F.col("p_partkey").alias("file"))
    exploded = keys.repartition(keys.sparkSession.sparkContext.defaultParallelism).select("file", F.explode(F.array(*cells)).alias("s")).select("file", "s.*")
    return exploded.filter(F.expr(f"(file + i) % {step} <> 0"))


def samples_sql(rows: list[tuple], names: str, step: int = 4) -> str:
    values = ", ".join("(" + ", ".join([str(i), *map(literal, r)]) + ")" for i, r in enumerate(rows))
    return f"s AS (SELECT p_partkey AS file, v.* FROM part, (VALUES {values}) v(i, {', '.join(names.split())}) WHERE (p_partkey + i) % {step} <> 0)"


def bounded_sql(x: str, limit: int = 64) -> str:
    t = f"trim(regexp_replace(trim({x}), '[ \\t\\n\\f\\r]+', ' ', 'g'))"
    personal = f"(^|[^A-Z0-9])({'|'.join(c.PERSONAL)})"
    return (
        f"(CASE WHEN length({t}) BETWEEN 1 AND {limit} AND regexp_full_match({t}, '[A-Za-z0-9 .,_+&()/-]+') AND regexp_matches({t}, '[A-Za-z]') AND NOT regexp_matches({t}, ' / |^/|\\.\\.')"
        f" AND NOT regexp_matches(upper({t}), '{personal}') AND NOT regexp_matches({t}, '(^|[^A-Za-z0-9])[0-9]{{7,}}($|[^A-Za-z0-9])') THEN {t} END)"
    )


EQUIPMENT = [
    ("Siemens Healthineers", "magnetom PRISMA"), ("SIEMENS MEDICAL SYSTEMS", "Prisma_fit"), ("Siemenss", "  MAGNETOM   Vida "), ("Philips Medical Systems", "ACHIEVA dstream"), ("GE MEDICAL SYSTEMS", "Signa Hero"),
    ("A General Electric unit", "DISCOVERY MR750W"), ("ge", "Optima"), ("Toshiba_MEC", "vantage titan"), ("UnitedImaging", "uMR 790"), ("UIH", "umr omega"), ("Bruker BioSpin", "biospec"),
    ("Own Works / lab", "/etc/model"), ("Dr. Patient-Name", "Model 12345678"), ("x@y.example", "C:model"), ("Small Vendor (2)", "Ingenia"), ("", "  "), (None, None), ("12345", "a..b"), ("V" * 70, "M&M, 3+4"),
]


def _vendor_sql(x: str) -> str:
    b = bounded_sql(x)
    return "CASE " + " ".join(f"WHEN regexp_matches(upper({b}), '{p}') THEN '{n}'" for p, n in c.VENDORS) + f" ELSE {b} END"


def _model_sql(x: str) -> str:
    known = {m.upper(): m for m in c.MODELS} | c.MODEL_ALIASES
    return f"coalesce(map_extract(MAP {{{', '.join(f'{literal(k)}: {literal(v)}' for k, v in known.items())}}}, upper({bounded_sql(x)}))[1], {bounded_sql(x)})"


@query(f"WITH {samples_sql(EQUIPMENT, 'vendor model')} SELECT file, i, {_vendor_sql('vendor')} AS vendor, {_model_sql('model')} AS model FROM s")
def equipment_names(table):
    """Canonical vendors and models; what is no known name stays only as bounded text."""
    return samples(table, EQUIPMENT, "vendor model").select("file", "i", c.manufacturer(F.col("vendor")).alias("vendor"), c.model(F.col("model")).alias("model"))


SMALL_TEXTS = [
    ("1h", "T-11.2", " HU "), ("23Na ", "A/B", "US"), ("129XE", "x" * 17, "10^-3 mm"), ("2H", "113092", "a/b %"), ("", "", ""), (None, None, None), ("31P", "a b", "normalized"), (" 13c", "SRT_2.1", "NAME 1"), ("17O", "9", "1234567"),
]


@query(rf"""
    WITH {samples_sql(SMALL_TEXTS, 'nucleus code rescale')}
    SELECT file, i, CASE upper(trim(nucleus)) WHEN '1H' THEN '1H' WHEN '13C' THEN '13C' WHEN '17O' THEN '17O' WHEN '19F' THEN '19F' WHEN '23NA' THEN '23Na' WHEN '31P' THEN '31P' WHEN '129XE' THEN '129Xe' END AS nucleus,
        CASE WHEN regexp_full_match(trim(code), '[A-Za-z0-9_.-]{{1,16}}') THEN trim(code) END AS code,
        CASE WHEN regexp_full_match(trim(regexp_replace(rescale, '[ \t]+', ' ', 'g')), '[A-Za-z0-9 _./%-]{{1,16}}') AND {bounded_sql('rescale', 16)} IS NOT NULL THEN trim(regexp_replace(rescale, '[ \t]+', ' ', 'g')) END AS rescale FROM s""")
def short_codes(table):
    """Nuclei, code identifiers and rescale types."""
    rows = samples(table, SMALL_TEXTS, "nucleus code rescale")
    return rows.select("file", "i", c.nucleus(F.col("nucleus")).alias("nucleus"), c.code_identifier(F.col("code")).alias("code"), c.rescale_type(F.col("rescale")).alias("rescale"))


VERSIONS = [
    ("SIEMENS", "syngo MR E11"), ("SIEMENS", "syngo MR VB17A; xa30"), ("SIEMENS", "VE11C\\VE11C\\N4_VE11C"), ("Philips Medical Systems", "5.7.1\\5.7.1.2\\build_900"), ("GE MEDICAL SYSTEMS", "27\\LX\\DV26.0_R03,29.1"), ("Canon/Toshiba", "V6.0 6.0.12"),
    ("United Imaging", "(9.5.1)"), ("Bruker", "PV 6.0.1/7.0"), (None, "1.2.3\\tool one"), ("Other", "release 1.2\\Patient x\\b"), ("SIEMENS", "N4 LATEST"), ("Philips Medical Systems", "1.2.3.4.5\\1234.5"), ("SIEMENS", ""),
]


@query(rf"""
    WITH {samples_sql(VERSIONS, 'vendor raw')},
    t AS (SELECT *, list_filter(list_transform(regexp_split_to_array(raw, '[ \t\n\f\r\\,;/_]'), lambda x: regexp_replace(x, '^[^A-Za-z0-9.]+|[^A-Za-z0-9.]+$', '', 'g')), lambda x: x <> '') AS tokens FROM s),
    k AS (SELECT *, list_filter(list_transform(tokens, lambda x: CASE
        WHEN vendor = 'SIEMENS' AND regexp_matches(upper(x), '{c.SIEMENS_VERSION}') THEN 'Siemens ' || upper(x)
        WHEN vendor = 'Philips Medical Systems' AND regexp_matches(x, '{c.NUMERIC_VERSION}') THEN 'Philips ' || x
        WHEN vendor = 'GE MEDICAL SYSTEMS' AND regexp_matches(upper(x), '^(DV)?[0-9]{{1,3}}(\.[0-9]{{1,3}}){{1,3}}$') THEN 'GE ' || upper(x)
        WHEN vendor IN ('Canon/Toshiba', 'United Imaging', 'Bruker') AND regexp_matches(x, '{c.NUMERIC_VERSION}') THEN vendor || ' ' || x END), lambda x: x IS NOT NULL) AS l FROM t),
    d AS (SELECT *, list_filter(l, lambda x, j: list_position(l, x) = j) AS known, list_filter(list_transform(string_split(raw, '\'), lambda x: {bounded_sql('x')}), lambda x: x IS NOT NULL) AS plain FROM k)
    SELECT file, i, array_to_string(CASE WHEN len(known) > 0 THEN known[1:16] ELSE plain[1:16] END, '|') AS versions FROM d""")
def software_versions(table):
    """Version tokens by the vendor's grammar, else bounded text."""
    rows = samples(table, VERSIONS, "vendor raw")
    return rows.select("file", "i", F.array_join(c.software_versions(F.col("raw"), F.col("vendor")), "|").alias("versions"))


NAMES = [
    ("*ep2d_BOLD_p2",), ("epfid2d1_64 bold",), ("cmrr BOLD",), ("fMRI_se",), ("ep2d_diff",), ("*epfid",), ("EPI 3",), ("tfl MP-RAGE",), ("t2 FLAIR",), ("BRAVO",), ("spgr",), ("SPACE_t2",), ("dti 64",), ("PCASL",),
    ("pasl3",), ("gre field_map",), ("gre\\se",), ("unknown",), ("  ",), (None,),
]
COILS = [
    ("HeadNeck_64",), ("Head_32CH",), ("HNU 12",), ("SENSE-Head-8 neck",), ("SURFACE",), ("32Ch Body_512",), ("spine 0 24",), ("multi coil",), ("BREAST 16ch",), ("nothing",), ("shoulderarray",), (" flex Large 4 ",), ("knee_300CH_12",), ("",), (None,),
]


def _sequence_sql(x: str) -> str:
    low = f"lower(trim({x}))"
    return "CASE " + " ".join("WHEN " + " AND ".join(f"contains({low}, '{n}')" for n in needles) + f" THEN '{name}'" for needles, name in c.SEQUENCES) + " END"


@query(rf"""
    WITH {samples_sql(NAMES, 'raw')} SELECT file, i, {_sequence_sql('raw')} AS sequence,
        CASE WHEN trim(raw) <> '' AND NOT contains(raw, '\') THEN coalesce({_sequence_sql('raw')}, 'OTHER') END AS pulse FROM s""")
def sequence_names(table):
    """Sequence names by ordered rules, and pulse sequence names."""
    return samples(table, NAMES, "raw").select("file", "i", c.sequence_name(F.col("raw")).alias("sequence"), c.pulse_sequence_name(F.col("raw")).alias("pulse"))


@query(rf"""
    WITH {samples_sql(COILS, 'raw')},
    t AS (SELECT *, list_filter(regexp_split_to_array(upper(trim(raw)), '[^A-Z0-9]'), lambda x: x <> '') AS tokens FROM s), j AS (SELECT *, array_to_string(tokens, '_') AS joined FROM t),
    b AS (SELECT *, CASE WHEN contains(joined, 'HEAD') AND contains(joined, 'NECK') THEN 'HEAD_NECK' WHEN contains(joined, 'HEAD') OR list_contains(tokens, 'HNU') THEN 'HEAD'
        {' '.join(f"WHEN contains(joined, '{p}') THEN '{p}'" for p in c.COIL_PARTS)} END AS base,
        list_filter(list_transform(tokens, lambda x: TRY_CAST(regexp_extract(x, '^([0-9]{{1,5}})(CH)?$', 1) AS INT)), lambda n: n BETWEEN 1 AND 256)[1] AS channels FROM j)
    SELECT file, i, CASE WHEN regexp_replace(upper(trim(raw)), '[ _]', '') = 'MULTICOIL' THEN 'MULTI_COIL' WHEN trim(raw) = 'SURFACE' THEN 'SURFACE' WHEN base IS NOT NULL THEN base || coalesce('_' || channels, '') END AS coil FROM b""")
def coil_names(table):
    """Coil names as body part and channel count."""
    return samples(table, COILS, "raw").select("file", "i", c.coil_name(F.col("raw")).alias("coil"))


TYPES = [
    ("ORIGINAL\\PRIMARY\\M\\ND\\secret name",), ("original\\primary\\FMRI\\NONE",), ("DERIVED\\SECONDARY\\ \\OTHER\\x",), ("DERIVED\\PRIMARY\\DIFFUSION\\ADC",), ("MIXED\\PRIMARY\\T1\\MIXED",), ("ORIGINAL\\PRIMARY\\T1\\",), ("ORIGINAL",),
    ("ORIGINAL\\PRIMARY\\T1\\ADC",), ("DERIVED\\PRIMARY\\VOLUME\\MIXED",), ("a\\b",), ("ORIGINAL\\PRIMARY\\M\\SE\\M\\SE",), ("",), (None,),
]


def _list_sql(values) -> str:
    return "(" + ", ".join(map(literal, values)) + ")"


def _enhanced_sql(frame: bool, legacy: bool) -> str:
    first = ("ORIGINAL", "DERIVED") if frame and not legacy else ("ORIGINAL", "DERIVED", "MIXED")
    fourth = list(c.ENHANCED_FOURTH) + ([] if frame else ["MIXED"]) + ([""] if legacy else [])
    last = "('NONE', '')" if legacy else "('NONE')"
    return f"CASE WHEN len(v) = 4 AND v[1] IN {_list_sql(first)} AND v[2] = 'PRIMARY' AND v[3] IN {_list_sql(c.ENHANCED_THIRD)} AND v[4] IN {_list_sql(fourth)} AND (v[1] <> 'ORIGINAL' OR v[4] IN {last}) THEN array_to_string(v, '\\') END"


@query(rf"""
    WITH {samples_sql(TYPES, 'raw')}, t AS (SELECT *, list_transform(string_split(raw, '\'), lambda x: upper(trim(x))) AS v FROM s),
    k AS (SELECT *, CASE WHEN len(v) BETWEEN 2 AND 64 AND v[1] IN ('ORIGINAL', 'DERIVED') AND v[2] IN ('PRIMARY', 'SECONDARY') THEN array_to_string(list_transform(v, lambda x, j: CASE WHEN j < 3 OR x = '' OR x IN {_list_sql(c.CLASSIC_TERMS)} THEN x ELSE 'OTHER' END), '\') END AS classic FROM t)
    SELECT file, i, classic, CASE WHEN classic IS NOT NULL THEN CAST(len(list_filter(list_zip(v[3:], string_split(classic, '\')[3:]), lambda p: p[2] = 'OTHER' AND p[1] <> 'OTHER')) AS BIGINT) END AS replaced,
        {_enhanced_sql(False, False)} AS enhanced, {_enhanced_sql(True, False)} AS frame, {_enhanced_sql(True, True)} AS legacy_frame FROM k""")
def image_types(table):
    """Classic image types with unknown terms replaced in place, and enhanced types of closed lists."""
    raw = F.col("raw")
    rows = samples(table, TYPES, "raw").withColumn("classic", c.image_type(raw))
    replaced = F.when(F.col("classic").isNotNull(), c.replaced_terms(raw, F.col("classic")))
    return rows.select("file", "i", "classic", replaced.alias("replaced"), c.enhanced_type(raw).alias("enhanced"), c.enhanced_type(raw, True).alias("frame"), c.enhanced_type(raw, True, True).alias("legacy_frame"))


CODE_ROWS = [(g << 16 | e, raw) for (g, e), codes in c.CODES.items() for raw in (" x\\" + codes.replace("~", " ").split(" ")[0].lower() + "\\" + codes.replace("~", " ").split(" ")[-1], codes.replace("~", " ").split(" ")[0])] + [(0x00180020, "EP\\GR\\EP"), (0x00181111, "EP"), (0x00189257, "LABEL\\CONTROL"), (0x00280004, "palette color"), (0x00180020, None)]


@query(rf"""
    WITH {samples_sql(CODE_ROWS, 'tag raw', 8)}, a(tag, codes) AS (VALUES {', '.join(f"({(g << 16) + e}, [{', '.join(map(literal, c.codes_of((g, e))))}])" for g, e in c.CODES)}),
    t AS (SELECT s.*, codes, list_filter(list_transform(string_split(raw, '\'), lambda x: upper(trim(x))), lambda x: list_contains(codes, x)) AS l FROM s LEFT JOIN a USING (tag))
    SELECT file, i, tag, CASE WHEN tag IN ({', '.join(str((g << 16) + e) for g, e in c.SINGLE)}) THEN CASE WHEN list_contains(codes, upper(trim(raw))) THEN upper(trim(raw)) END
        WHEN len(l) > 0 THEN array_to_string(list_filter(l, lambda x, j: list_position(l, x) = j), '\') END AS code FROM t""")
def code_strings(table):
    """Code strings by the closed list of their tag."""
    return samples(table, CODE_ROWS, "tag raw", 8).select("file", "i", "tag", c.code_string(F.col("raw"), F.col("tag")).alias("code"))
