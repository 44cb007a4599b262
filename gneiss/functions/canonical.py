"""Canonical forms of imaging attributes: equipment, software, sequences, coils, code strings and image types.

Tables are data; each function is one column expression over them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gneiss.functions.text import ascii_lower, ascii_upper

# Names, terms and patterns that results must agree with.
VENDORS = (
    (r"^(SIEMENS|SIEMENS HEALTHCARE|SIEMENS HEALTHINEERS|SIEMENS MEDICAL .*)$", "SIEMENS"),
    (r"^(PHILIPS|PHILIPS MEDICAL .*|PHILIPS HEALTHCARE .*)$", "Philips Medical Systems"),
    (r"GENERAL ELECTRIC|^GE$|^GE MEDICAL|^GE HEALTHCARE", "GE MEDICAL SYSTEMS"),
    (r"CANON|TOSHIBA", "Canon/Toshiba"),
    (r"UNITED ?IMAGING|^UIH$|^UIH ", "United Imaging"),
    (r"BRUKER", "Bruker"),
)
MODEL_ALIASES = {"PRISMA_FIT": "MAGNETOM Prisma_fit", "ACHIEVA DSTREAM": "Achieva dStream"}
MODELS = (
    "MAGNETOM Prisma_fit", "MAGNETOM Prisma", "MAGNETOM Skyra", "MAGNETOM TrioTim", "MAGNETOM Trio", "MAGNETOM Vida", "MAGNETOM Verio", "MAGNETOM Terra",
    "MAGNETOM Cima.X", "MAGNETOM Connectom", "MAGNETOM Sola", "MAGNETOM Aera", "MAGNETOM Avanto", "MAGNETOM Allegra", "MAGNETOM Espree", "Biograph mMR",
    "Ingenia Elition X", "Ingenia Ambition X", "Ingenia CX", "Ingenia", "Achieva dStream", "Achieva", "Intera", "MR 7700",
    "Discovery MR750w", "Discovery MR750", "Optima MR450w", "SIGNA Premier", "SIGNA Architect", "SIGNA PET/MR", "SIGNA HDxt", "SIGNA Voyager",
    "SIGNA Artist", "SIGNA Hero", "Vantage Galan", "Vantage Titan", "Vantage Orian", "Vantage Elan", "uMR Jupiter", "uMR Omega",
    "uMR 790", "uMR 780", "uMR 770", "uMR 670", "uMR 570", "uMR 560", "BioSpec", "PharmaScan",
)
#: All needles of a rule must occur; the first rule that holds names the sequence.
SEQUENCES = (
    (("ep2d", "bold"), "ep2d_bold"), (("epfid", "bold"), "epfid_bold"), (("bold",), "bold"), (("fmri",), "fmri"), (("ep2d",), "ep2d"), (("epfid",), "epfid"), (("epi",), "epi"),
    (("mprage",), "mprage"), (("mp-rage",), "mprage"), (("flair",), "flair"), (("bravo",), "bravo"), (("spgr",), "spgr"), (("space",), "space"),
    (("diff",), "diffusion"), (("dwi",), "diffusion"), (("dti",), "diffusion"), (("pcasl",), "pcasl"), (("pasl",), "pasl"), (("field", "map"), "fieldmap"),
)
COIL_PARTS = ("NECK", "BODY", "SPINE", "KNEE", "FLEX", "BREAST", "CARDIAC", "FOOT", "ANKLE", "SHOULDER", "WRIST")
NUCLEI = {"1H": "1H", "13C": "13C", "17O": "17O", "19F": "19F", "23NA": "23Na", "31P": "31P", "129XE": "129Xe"}
SIEMENS_VERSION, NUMERIC_VERSION = r"^(E11|(VA|VB|VC|VD|VE|XA|XB)[0-9]{2}[A-Za-z]?)$", r"^[0-9]{1,3}(\.[0-9]{1,3}){1,3}$"
PERSONAL = ("EMAIL", "NAME", "MRN", "PATIENT", "PARTICIPANT", "SUBJECT", "BIRTH", "DOB", "SSN", "ACCESSION")
CLASSIC_TERMS = (
    "OTHER", "M", "MAGNITUDE", "P", "PHASE", "R", "REAL", "I", "IMAGINARY", "MIXED", "ND", "NORM", "MOSAIC", "GRID", "VFRAME", "DIS2D", "FMRI", "BOLD", "EPI",
    "T1", "T1W", "T2", "T2W", "T2_STAR", "T2STAR", "FLAIR", "DIFFUSION", "DWI", "ADC", "TRACEW", "FA", "DTI", "ASL", "PERFUSION", "FIELD_MAP", "FIELDMAP",
    "PHASEDIFF", "SBREF", "LOCALIZER", "SCOUT", "SURVEY", "REF", "REFERENCE", "NONE", "FFE", "FFE_IP", "WATER", "FAT", "DENSITY MAP", "DIFFUSION MAP",
    "IMAGE ADDITION", "MODULUS SUBTRACT", "MPR", "PHASE MAP", "PHASE SUBTRACT", "PROJECTION IMAGE", "T1 MAP", "T2 MAP", "VELOCITY MAP",
)
ENHANCED_THIRD = (
    "ANGIO", "CARDIAC", "CARDIAC_GATED", "CARDRESP_GATED", "DYNAMIC", "FLUOROSCOPY", "LOCALIZER", "MOTION", "PERFUSION", "PRE_CONTRAST", "POST_CONTRAST", "RESP_GATED",
    "REST", "STATIC", "STRESS", "VOLUME", "NON_PARALLEL", "PARALLEL", "WHOLE_BODY", "ANGIO_TIME", "ASL", "CINE", "DIFFUSION", "DIXON", "FLOW_ENCODED", "FLUID_ATTENUATED",
    "FMRI", "MAX_IP", "MIN_IP", "M_MODE", "METABOLITE_MAP", "MULTIECHO", "PROTON_DENSITY", "REALTIME", "STIR", "TAGGING", "TEMPERATURE", "T1", "T2", "T2_STAR", "TOF", "VELOCITY",
)
ENHANCED_FOURTH = (
    "ADDITION", "DIVISION", "MASKED", "MAXIMUM", "MEAN", "MINIMUM", "MULTIPLICATION", "RESAMPLED", "STD_DEVIATION", "SUBTRACTION", "NONE", "QUANTITY",
    "ADC", "DIFFUSION", "DIFFUSION_ANISO", "DIFFUSION_ATTNTD", "DIFFUSION_ISO", "ATTNTD", "FA", "TRACEW", "FAT", "FAT_FRACTION", "FIELD_MAP", "IN_PHASE", "METABOLITE_MAP",
    "NEI", "OUT_OF_PHASE", "PERFUSION_ASL", "R_COEFFICIENT", "R2_MAP", "R2_STAR_MAP", "RHO", "SCM", "SNR_MAP", "T1_MAP", "T2_STAR_MAP", "T2_MAP", "TCS", "TEMPERATURE", "VELOCITY", "WATER", "WATER_FRACTION",
)
YES_NO = "YES NO"
#: Allowed codes by (group, element); a tilde is a space within a code.
CODES = {
    (0x0008, 0x0060): "MR", (0x0008, 0x9205): "COLOR MONOCHROME MIXED", (0x0008, 0x9206): "VOLUME SAMPLED DISTORTED MIXED",
    (0x0008, 0x9207): "MAX_IP MIN_IP VOLUME_RENDER SURFACE_RENDER MPR CURVED_MPR NONE MIXED", (0x0008, 0x9208): "MAGNITUDE PHASE REAL IMAGINARY MIXED",
    (0x0008, 0x9209): "UNKNOWN T1 T2 T2_STAR PROTON_DENSITY DIFFUSION FLOW_ENCODED FLUID_ATTENUATED PERFUSION STIR TAGGING TOF MIXED",
    (0x0018, 0x0020): "SE IR GR EP RM", (0x0018, 0x0021): "SK MTC SS TRSS SP MP OSP NONE", (0x0018, 0x0022): "PER RG CG PPG FC PFF PFP SP FS", (0x0018, 0x0023): "2D 3D",
    (0x0018, 0x0025): "Y N", (0x0018, 0x1312): "ROW COL COLUMN OTHER", (0x0018, 0x5100): "HFP HFS HFDR HFDL FFDR FFDL FFP FFS", (0x0018, 0x9008): "SPIN GRADIENT BOTH",
    (0x0018, 0x9009): YES_NO, (0x0018, 0x9010): "ACCELERATION VELOCITY OTHER NONE", (0x0018, 0x9011): YES_NO, (0x0018, 0x9012): YES_NO, (0x0018, 0x9014): YES_NO, (0x0018, 0x9015): YES_NO,
    (0x0018, 0x9016): "RF GRADIENT RF_AND_GRADIENT NONE", (0x0018, 0x9017): "FREE_PRECESSION TRANSVERSE TIME_REVERSED LONGITUDINAL NONE", (0x0018, 0x9018): YES_NO,
    (0x0018, 0x9020): "ON_RESONANCE OFF_RESONANCE NONE", (0x0018, 0x9021): YES_NO, (0x0018, 0x9022): YES_NO, (0x0018, 0x9024): YES_NO,
    (0x0018, 0x9025): "FAT WATER FAT_AND_WATER SILICON_GEL NONE", (0x0018, 0x9026): "WATER FAT NONE", (0x0018, 0x9027): "SLAB NONE", (0x0018, 0x9028): "GRID LINE NONE",
    (0x0018, 0x9029): "2D 3D 2D_3D NONE", (0x0018, 0x9032): "RECTILINEAR RADIAL SPIRAL", (0x0018, 0x9033): "SINGLE PARTIAL FULL",
    (0x0018, 0x9034): "LINEAR REVERSE_LINEAR CENTRIC REVERSE_CENTRIC SEGMENTED UNKNOWN", (0x0018, 0x9036): "PHASE FREQUENCY SLICE COMBINATION",
    (0x0018, 0x9043): "BODY VOLUME SURFACE MULTICOIL", (0x0018, 0x9044): YES_NO, (0x0018, 0x9048): YES_NO, (0x0018, 0x9051): "BODY VOLUME SURFACE MULTICOIL",
    (0x0018, 0x9075): "NONE ISOTROPIC DIRECTIONAL BMATRIX", (0x0018, 0x9077): YES_NO, (0x0018, 0x9078): "PILS SENSE GRAPPA ASSET SMASH OTHER NONE", (0x0018, 0x9081): YES_NO,
    (0x0018, 0x9183): "PHASE FREQUENCY SLICE_SELECT SLICE_AND_FREQ SLICE_FREQ_PHASE PHASE_AND_FREQ SLICE_AND_PHASE OTHER", (0x0018, 0x9250): "CONTINUOUS PULSED PSEUDOCONTINUOUS",
    (0x0018, 0x9257): "LABEL CONTROL M_ZERO_SCAN", (0x0018, 0x9259): YES_NO, (0x0018, 0x925C): YES_NO, (0x0018, 0x9624): YES_NO, (0x0020, 0x9072): "R L U B",
    (0x0028, 0x0004): "MONOCHROME1 MONOCHROME2 PALETTE~COLOR RGB YBR_FULL YBR_FULL_422 YBR_ICT YBR_RCT YBR_PARTIAL_420", (0x0028, 0x0301): "NO", (0x0028, 0x0303): "REMOVED", (0x0028, 0x2110): "00 01",
    (0x0028, 0x2114): "ISO_10918_1 ISO_14495_1 ISO_15444_1 ISO_15444_2 ISO_13818_2 ISO_14496_10", (0x2050, 0x0020): "IDENTITY INVERSE LIN~OD",
}
#: Attributes of one value; their text is no list.
SINGLE = ((0x0018, 0x9257), (0x0018, 0x9259), (0x0018, 0x925C))
# End of fixed values.


def codes_of(tag: tuple[int, int]) -> list[str]:
    """Allowed codes of a tag; a tilde in the table is a space within a code."""
    return [c.replace("~", " ") for c in CODES[tag].split()]


def bounded(x: Column, limit: int = 64) -> Column:
    """Collapsed text of at most `limit` bytes that can be neither a path, an address nor personal data, else null."""
    text = F.regexp_replace(F.regexp_replace(x, r"^[ \x00]+|[ \x00]+$", ""), r"[ \t\n\f\r]+", " ")
    text = F.trim(text)
    shape = F.length(text).between(1, limit) & text.rlike(r"^[A-Za-z0-9 .,_+&()/-]+$") & text.rlike("[A-Za-z]")
    path = text.rlike(r" / |^/|\.\.")
    tokens = F.split(ascii_upper(text), "[^A-Z0-9]+")
    personal = F.exists(tokens, lambda t: t.rlike("^(" + "|".join(PERSONAL) + ")") | t.rlike("^[0-9]{7,}$"))
    return F.when(shape & ~path & ~personal, text)


def manufacturer(x: Column) -> Column:
    text = bounded(x)
    result = None
    for pattern, name in VENDORS:
        hit = ascii_upper(text).rlike(pattern)
        result = F.when(hit, name) if result is None else result.when(hit, name)
    return result.otherwise(text)


def model(x: Column) -> Column:
    names = F.create_map(*[F.lit(v) for pair in ({m.upper(): m for m in MODELS} | MODEL_ALIASES).items() for v in pair])
    return F.coalesce(F.try_element_at(names, ascii_upper(bounded(x))), bounded(x))


def software_versions(x: Column, vendor: Column) -> Column:
    """Version tokens in the vendor's grammar, each once, 16 at most; without any the bounded parts of the list."""
    tokens = F.filter(F.transform(F.split(x, r"[ \t\n\f\r\\,;/_]"), lambda t: F.regexp_replace(t, r"^[^A-Za-z0-9.]+|[^A-Za-z0-9.]+$", "")), lambda t: t != "")
    vendor = F.coalesce(vendor, F.lit("Scanner"))

    def one(t: Column) -> Column:
        upper, number = ascii_upper(t), t.rlike(NUMERIC_VERSION)
        return (
            F.when((vendor == "SIEMENS") & upper.rlike(SIEMENS_VERSION), F.concat(F.lit("Siemens "), upper))
            .when((vendor == "Philips Medical Systems") & number, F.concat(F.lit("Philips "), t))
            .when((vendor == "GE MEDICAL SYSTEMS") & (number | F.regexp_replace(upper, "^DV", "").rlike(NUMERIC_VERSION)), F.concat(F.lit("GE "), upper))
            .when(vendor.isin("Canon/Toshiba", "United Imaging", "Bruker") & number, F.concat(vendor, F.lit(" "), t))
        )

    known = F.slice(F.array_distinct(F.array_compact(F.transform(tokens, one))), 1, 16)
    plain = F.slice(F.array_compact(F.transform(F.split(x, r"\\"), lambda p: bounded(p))), 1, 16)
    return F.when(F.size(known) > 0, known).otherwise(plain)


def sequence_name(x: Column) -> Column:
    low, result = ascii_lower(F.trim(x)), None
    for needles, name in SEQUENCES:
        hit = F.lit(True)
        for n in needles:
            hit = hit & low.contains(n)
        result = F.when(hit, name) if result is None else result.when(hit, name)
    return result


def pulse_sequence_name(x: Column) -> Column:
    """The sequence's name, or OTHER; null for empty texts and lists."""
    text = F.trim(x)
    return F.when((text != "") & ~text.contains("\\"), F.coalesce(sequence_name(text), F.lit("OTHER")))


def coil_name(x: Column) -> Column:
    """Body part and channel count (1 to 256) of a coil's name; null without a known part."""
    tokens = F.filter(F.split(ascii_upper(F.trim(x)), "[^A-Z0-9]"), lambda t: t != "")
    joined = F.array_join(tokens, "_")
    base = F.when(joined.contains("HEAD") & joined.contains("NECK"), "HEAD_NECK").when(joined.contains("HEAD") | F.array_contains(tokens, "HNU"), "HEAD")
    for part in COIL_PARTS:
        base = base.when(joined.contains(part), part)
    counts = F.transform(tokens, lambda t: F.when(t.rlike(r"^[0-9]{1,5}(CH)?$"), F.regexp_extract(t, "^([0-9]+)", 1).cast("int")))
    channels = F.try_element_at(F.filter(counts, lambda n: n.between(1, 256)), F.lit(1))
    surface = F.regexp_replace(x, r"^[ \x00]+|[ \x00]+$", "") == "SURFACE"
    several = F.regexp_replace(ascii_upper(F.trim(x)), "[ _]", "") == "MULTICOIL"
    return F.when(several, "MULTI_COIL").when(surface, "SURFACE").when(base.isNotNull(), F.concat_ws("_", base, channels.cast("string")))


def nucleus(x: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(v) for pair in NUCLEI.items() for v in pair]), ascii_upper(F.trim(x)))


def code_identifier(x: Column) -> Column:
    text = F.regexp_replace(x, r"^[ \x00]+|[ \x00]+$", "")
    return F.when(text.rlike(r"^[A-Za-z0-9_.-]{1,16}$"), text)


def rescale_type(x: Column) -> Column:
    text = F.trim(F.regexp_replace(F.regexp_replace(x, r"^[ \x00]+|[ \x00]+$", ""), r"[ \t\n\f\r]+", " "))
    return F.when(text.rlike(r"^[A-Za-z0-9 _./%-]{1,16}$") & bounded(text, 16).isNotNull(), text)


def code_string(x: Column, tag: Column) -> Column:
    """Allowed codes of the tag's text, in order, each once; of tags of one value, that value. Null for other tags."""
    table = F.create_map(*[v for (g, e) in CODES for v in (F.lit((g << 16) + e), F.array(*map(F.lit, codes_of((g, e)))))])
    allowed = F.try_element_at(table, tag)
    parts = F.transform(F.split(x, r"\\"), lambda p: ascii_upper(F.trim(p)))
    found = F.array_intersect(parts, allowed)
    one = ascii_upper(F.trim(x))
    single = tag.isin([(g << 16) + e for g, e in SINGLE])
    return F.when(single, F.when(F.array_contains(allowed, one), one)).when(F.size(found) > 0, F.array_join(found, "\\"))


def numeric_text(x: Column, integer: bool) -> Column:
    """Up to 64 numbers of a list, trimmed; null if one is empty or none."""
    parts = F.transform(F.split(x, r"\\"), lambda p: F.trim(p))
    number = (lambda p: p.rlike("^[+-]?[0-9]{1,18}$")) if integer else (lambda p: p.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]{1,2})?$"))
    return F.when((F.size(parts) <= 64) & F.forall(parts, number), F.array_join(parts, "\\"))


def image_type(x: Column) -> Column:
    """Classic image type: two enumerated values; later ones are known terms or OTHER in their place."""
    values = F.transform(F.split(x, r"\\"), lambda p: ascii_upper(F.trim(p)))
    fine = F.size(values).between(2, 64) & values[0].isin("ORIGINAL", "DERIVED") & F.get(values, F.lit(1)).isin("PRIMARY", "SECONDARY")
    kept = F.transform(values, lambda v, i: F.when((i < 2) | (v == "") | v.isin(*CLASSIC_TERMS), v).otherwise("OTHER"))
    return F.when(fine, F.array_join(kept, "\\"))


def replaced_terms(source: Column, canonical: Column) -> Column:
    """How many optional values of a classic image type became OTHER."""
    pairs = F.slice(F.zip_with(F.split(source, r"\\"), F.split(canonical, r"\\"), lambda s, c: (c == "OTHER") & (ascii_upper(F.trim(s)) != "OTHER")), 3, 64)
    return F.size(F.filter(pairs, lambda p: p)).cast("long")


def enhanced_type(x: Column, frame: bool = False, legacy: bool = False) -> Column:
    """Enhanced image or frame type: exactly four values of closed lists, NONE last for originals; null if not."""
    values = F.transform(F.split(x, r"\\"), lambda p: ascii_upper(F.trim(p)))
    at = lambda i: F.get(values, F.lit(i))
    first = ("ORIGINAL", "DERIVED") if frame and not legacy else ("ORIGINAL", "DERIVED", "MIXED")
    fourth = at(3).isin(*ENHANCED_FOURTH)
    if not frame:
        fourth = fourth | (at(3) == "MIXED")
    if legacy:
        fourth = fourth | (at(3) == "")
    original = (at(0) != "ORIGINAL") | (at(3) == "NONE") | (F.lit(legacy) & (at(3) == ""))
    return F.when((F.size(values) == 4) & at(0).isin(*first) & (at(1) == "PRIMARY") & at(2).isin(*ENHANCED_THIRD) & fourth & original, F.array_join(values, "\\"))
