"""Contracts over an object's fields, items and frames: diffusion, perfusion, pixel module, transforms, references, frames.

Each is a column expression over one row (an item or an object) or an aggregation over a file's rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Storage classes, required attributes, transforms that are never kept, what hold messages mean.
CLASSIC, ENHANCED, LEGACY = "1.2.840.10008.5.1.4.1.1.4", "1.2.840.10008.5.1.4.1.1.4.1", "1.2.840.10008.5.1.4.1.1.4.4"
SECONDARY = tuple("1.2.840.10008.5.1.4.1.1.7" + x for x in ("", ".1", ".2", ".3", ".4"))
REQUIRED = ((0x00080008, "CS"), (0x00080016, "UI"), (0x00080018, "UI"), (0x00080060, "CS"), (0x00100010, "PN"), (0x00100020, "LO"), (0x0020000D, "UI"), (0x0020000E, "UI"))
PSEUDONYMOUS = (0x00080018, 0x0020000D, 0x0020000E, 0x00200052)
FORBIDDEN = (
    "00283000 00283010 20500010 00283002 00283003 00283004 00283006 00281056 00282000 00281100 00281101 00281102 00281103 00281104 00281111 00281112 00281113 00281114 00281199 00281200 00281201 00281202 00281203 00281204 "
    "00281211 00281212 00281213 00281214 00281221 00281222 00281223 00281224 00409094 00409096 00409098 00409211 00409212 00409213 00409214 00409216 00409220 00409224 00409225"
)
HOLDS = (
    ("=", "dicom_instance_exceeds_64_gib", "dicom_instance_exceeds_64_gib"),
    ("=", "series_exceeds_64_gib_uncompressed_dicom_limit", "series_exceeds_64_gib_uncompressed_dicom_limit"),
    ("=", "dicom_archive_expansion_ratio_exceeded", "dicom_archive_expansion_ratio_exceeded"),
    ("=", "DICOM contains overlay or graphic data and was held locally", "dicom_overlay_or_graphics_present"),
    ("=", "DICOM transfer syntax is not supported for bounded pixel copying", "unsupported_transfer_syntax"),
    ("=", "DICOM has no readable PixelData element", "dicom_pixel_data_unreadable"),
    ("=", "DICOM contains an unsupported pixel transform", "dicom_pixel_transform_unsupported"),
    ("=", "DICOM ImageType failed positional validation", "dicom_image_type_invalid"),
    ("=", "DICOM contains an invalid UID", "dicom_invalid_uid"),
    ("^", "DICOM contains an incomplete or invalid rescale transform", "dicom_pixel_transform_invalid"),
    ("^", "DICOM ASL ", "asl_scientific_metadata_incomplete"),
    ("^", "sanitized DICOM omitted required Type", "dicom_iod_contract_invalid"),
    ("^", "sanitized DICOM has an invalid required Type", "dicom_iod_contract_invalid"),
    ("^", "sanitized DICOM has a non-pseudonymous required UID", "dicom_iod_contract_invalid"),
)
#: A reference item's own attributes, exactly: class and instance, and after rewriting of an enhanced reference its frame and purpose.
CLASSIC_REFERENCE, ENHANCED_REFERENCE = ("00081150", "00081155"), ("00081150", "00081155", "00081160", "0040A170")
CONTEXT_PLACES = {"00189341": "1.2.840.10008.6.1.4", "00409210": "1.2.840.10008.6.1.918", "0040A170": "1.2.840.10008.6.1.508"}
# End of fixed values.


def unit_vector(v: Column) -> Column:
    return (F.size(v) == 3) & F.forall(v, lambda x: x.between(-1.1, 1.1)) & F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x).between(0.5, 1.5)


def zero_vector(v: Column) -> Column:
    return v.isNull() | F.forall(v, lambda x: F.abs(x) <= 1e-6)


def macro_state(present: Column, items: Column, valid: Column) -> Column:
    """Absent, Valid (one item that holds) or Invalid."""
    return F.when(~present, "Absent").when((items == 1) & F.coalesce(valid, F.lit(False)), "Valid").otherwise("Invalid")


def diffusion_item(b: Column, direction: Column, gradient: Column, matrix: Column) -> Column:
    """Whether an item's b value, directionality and the states of its two forms of direction fit together."""
    forms = {"NONE": (b <= 1, "Absent", "Absent"), "ISOTROPIC": (b > 1, "Absent", "Absent"), "DIRECTIONAL": (b > 1, "Valid", "Absent"), "BMATRIX": (b > 1, "Absent", "Valid")}
    fine = F.lit(False)
    for name, (range_, g, m) in forms.items():
        fine = fine | ((direction == name) & range_ & (gradient == g) & (matrix == m))
    return F.coalesce(b.between(0, 1e6) & fine, F.lit(False))


def vendor_diffusion(vendor: Column, b: Column, direction: Column, gradient: Column, matrix: Column) -> Column:
    """Whether one vendor's private diffusion fields fit together; small b values carry no direction."""
    weak = (b <= 1) & F.coalesce(direction.isin("NONE"), F.lit(True)) & zero_vector(gradient) & zero_vector(matrix)
    one = F.coalesce(unit_vector(gradient), F.lit(False))
    siemens = ((direction == "DIRECTIONAL") & one & zero_vector(matrix)) | ((direction == "BMATRIX") & matrix.isNotNull() & zero_vector(gradient)) | ((direction == "ISOTROPIC") & gradient.isNull() & matrix.isNull())
    philips = ((direction == "ISOTROPIC") & zero_vector(gradient)) | (~direction.eqNullSafe(F.lit("ISOTROPIC")) & ~direction.eqNullSafe(F.lit("NONE")) & one)
    strong = F.when(vendor == "siemens", siemens).when(vendor == "philips", philips).otherwise(one)
    return F.coalesce(b.between(0, 1e6) & F.when(b <= 1, weak).otherwise(strong), F.lit(False))


def one_vendor(rows: DataFrame) -> DataFrame:
    """(file, present, valid, semantic) from (file, vendor, valid, b, direction): valid only if exactly one vendor is present."""
    semantic = (F.col("b") > 1) | F.col("direction").isin("ISOTROPIC", "DIRECTIONAL", "BMATRIX")
    vendors = rows.groupBy("file", "vendor").agg(F.bool_and("valid").alias("valid"), F.bool_or(F.coalesce(semantic, F.lit(False))).alias("semantic"))
    return vendors.groupBy("file").agg(F.count("*").alias("present"), ((F.count("*") == 1) & F.bool_and("valid")).alias("valid"), F.bool_or("semantic").alias("semantic"))


def asl_item(context: Column, crusher: Column, flow: Column, description: Column, bolus: Column, bolus_items: Column, delay: Column, slabs: Column) -> Column:
    """Whether a perfusion item's flags agree with what they ask for; label and control images need slabs."""
    crushed = F.when(crusher == "YES", flow.between(0, 1e12) & (F.length(description).between(1, 64))).when(crusher == "NO", flow.isNull() & description.isNull())
    cut = F.when(bolus == "YES", (bolus_items == 1) & delay.between(0, 100_000_000)).when(bolus == "NO", bolus_items == 0)
    return F.coalesce(context.isin("LABEL", "CONTROL", "M_ZERO_SCAN") & crushed & cut & ((context == "M_ZERO_SCAN") | (slabs > 0)), F.lit(False))


def pixel_module(c: dict[str, Column]) -> Column:
    """Bytes of uncompressed pixels, padded to an even number; null where the module does not fit its storage class."""
    every = (c["rows"] > 0) & (c["columns"] > 0) & (c["samples"] == 1) & c["representation"].isin(0, 1) & (c["high"] + 1 == c["stored"]) & ~c["planar"]
    frames = F.coalesce(c["frames"], F.lit(1))
    classic = (c["sop"] == CLASSIC) & c["photometric"].isin("MONOCHROME1", "MONOCHROME2") & (c["allocated"] == 16) & c["stored"].between(1, 16) & (frames == 1)
    pair = F.concat_ws("/", c["allocated"].cast("string"), c["stored"].cast("string")).isin("8/8", "16/12", "16/16")
    enhanced = c["sop"].isin(ENHANCED, LEGACY) & (c["photometric"] == "MONOCHROME2") & pair & c["frames"].isNotNull()
    raw = F.expr("1L") * c["rows"] * c["columns"] * c["samples"] * frames * F.shiftright(c["allocated"], 3)
    return F.when(F.coalesce(every & (classic | enhanced), F.lit(False)), raw + raw % 2)


def transform_codes(tags: Column, rescale_here: Column, window_here: Column, sanitised: Column) -> Column:
    """What is wrong with an item's pixel transforms, from the set of its tags (eight hex digits each)."""
    count = lambda names: F.size(F.array_intersect(tags, F.array(*map(F.lit, names))))
    rescale, window = count(["00281052", "00281053", "00281054"]), count(["00281050", "00281051"])
    return F.array_compact(F.array(
        F.when(F.arrays_overlap(tags, F.array(*map(F.lit, FORBIDDEN.split()))), "unsupported"),
        F.when((rescale > 0) & (~rescale_here | (rescale < 3)), "rescale"),
        F.when((window == 1) | ((window == 2) & ~window_here), "window"),
        F.when(sanitised & F.array_contains(tags, F.lit("00281055")), "explanation"),
    ))


def missing_required(elements: DataFrame) -> DataFrame:
    """(file, missing, foreign_uids): required attributes absent, empty or of another kind, and required UIDs that are no pseudonyms."""
    tag = F.shiftleft(F.col("grp").cast("long"), 16) + F.col("elem")
    full = F.coalesce(F.trim("value"), F.lit("")) != ""
    present = [F.bool_or((tag == t) & (F.col("vr") == vr) & (F.col("depth") == 0) & full) for t, vr in REQUIRED]
    missing = F.array_compact(F.array(*[F.when(~p, F.lit(f"{t:08X}")) for (t, _), p in zip(REQUIRED, present)]))
    own = F.col("value").startswith("2.25.") & (F.length("value") <= 64)
    foreign = F.count_if(tag.isin(*PSEUDONYMOUS) & (F.col("depth") == 0) & ~F.coalesce(own, F.lit(False)))
    return elements.groupBy("file").agg(F.array_join(missing, ",").alias("missing"), foreign.alias("foreign_uids"))


def children(rows: DataFrame, key: list[str], tag: str) -> DataFrame:
    """(key, tags): an item's tags in order, each as often as it occurs."""
    return rows.groupBy(*key).agg(F.array_sort(F.collect_list(tag)).alias("tags"))


def is_set(tags: Column, wanted: tuple[str, ...], optional: str | None = None) -> Column:
    """Whether an item's children are exactly the wanted ones, with an optional one more."""
    kept = F.array_remove(tags, optional) if optional else tags
    return kept == F.array(*map(F.lit, sorted(wanted)))


def context_places(path: Column, value: Column) -> Column:
    """Whether a context UID lies under a sequence that may hold one, with that sequence's value."""
    allowed = F.create_map(*[F.lit(x) for pair in CONTEXT_PLACES.items() for x in pair])
    return F.coalesce(F.try_element_at(allowed, F.element_at(path, -1)) == value, F.lit(False))


def dimension_pointer(group: Column, creator: Column) -> Column:
    return (group % 2 == 0) & creator.isNull()


def frame_macros(macros: DataFrame) -> DataFrame:
    """(file, macro, fits): from (file, macro, place, frames) with place shared or frame: once for all, or once in every frame."""
    return macros.groupBy("file", "macro").agg((
        ((F.count_if(F.col("place") == "shared") == 1) & (F.count_if(F.col("place") == "frame") == 0))
        | ((F.count_if(F.col("place") == "shared") == 0) & (F.count_if(F.col("place") == "frame") == F.max("frames")))
    ).alias("fits"))


def frame_origins(frames: DataFrame) -> DataFrame:
    """(file, fits): the root's type is MIXED for frames of both origins, else their one origin; original frames have the macro, derived not."""
    origin = F.when(F.count_distinct("origin") > 1, "MIXED").otherwise(F.min("origin"))
    return frames.groupBy("file").agg(((F.min("root") == origin) & F.bool_and((F.col("origin") == "ORIGINAL") == F.col("macro"))).alias("fits"))


def stable(before: DataFrame, after: DataFrame) -> DataFrame:
    """(folder, stable): nothing of (folder, path, size, modified) came, went or changed between two scans."""
    b = before.select(F.col("folder").alias("_f"), F.col("path").alias("_p"), F.struct("size", "modified").alias("_b"))
    a = after.select("folder", "path", F.struct("size", "modified").alias("_a"))
    both = b.join(a, (F.col("_f") == F.col("folder")) & (F.col("_p") == F.col("path")), "full")
    return both.groupBy(F.coalesce("_f", "folder").alias("folder")).agg(F.bool_and(F.coalesce(F.col("_a") == F.col("_b"), F.lit(False))).alias("stable"))


def hold_code(message: Column) -> Column:
    """The hold code of a message; null for messages that hold nothing."""
    result = None
    for how, text, code in HOLDS:
        hit = message == text if how == "=" else message.startswith(text)
        result = F.when(hit, code) if result is None else result.when(hit, code)
    return result
