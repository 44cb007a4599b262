"""From header elements to series: one row a file, then what the gates ask of each series, by mergeable aggregates and running windows.

Files of a series are compared with a running representative, in order of path: the file with the least instance number so far, its gaps
filled from the others. For exact attributes that is the same as asking for two different values; for measured ones the value that
the representative has before each file is a running window, so the order matters exactly as it does to a loop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gneiss.functions import canonical
from gneiss.operators import validators

# Where attributes lie.
SINGLE = {
    "sop_class": (0x0008, 0x0016), "sop_instance": (0x0008, 0x0018), "modality": (0x0008, 0x0060), "manufacturer": (0x0008, 0x0070), "model": (0x0008, 0x1090),
    "description": (0x0008, 0x103E), "patient_id": (0x0010, 0x0020), "issuer": (0x0010, 0x0021), "sequence_name": (0x0018, 0x0024), "mr_type": (0x0018, 0x0023),
    "protocol": (0x0018, 0x1030), "receive_coil": (0x0018, 0x1250), "transmit_coil": (0x0018, 0x1251), "position": (0x0018, 0x5100), "echo_planar": (0x0018, 0x9018),
    "study_uid": (0x0020, 0x000D), "series_uid": (0x0020, 0x000E), "series_number": (0x0020, 0x0011), "instance_number": (0x0020, 0x0013), "temporal": (0x0020, 0x0105),
    "field_strength": (0x0018, 0x0087), "tr": (0x0018, 0x0080), "burned_in_value": (0x0028, 0x0301),
}
LISTS = {"image_types": (0x0008, 0x0008), "scanning_list": (0x0018, 0x0020), "variant": (0x0018, 0x0021), "options": (0x0018, 0x0022), "software": (0x0018, 0x1020)}
NUMERIC = ("series_number", "instance_number", "temporal", "field_strength", "tr")
#: Attributes of which a series may have one value: exact, as normal text, in canonical form, as sets of normal texts, and measured.
EXACT, NORMAL, SETS, MEASURED = ("sop_class", "modality", "series_number"), ("position", "mr_type", "sequence_name", "receive_coil", "transmit_coil"), ("scanning_list", "variant", "options"), ("field_strength",)
#: Distinct values that a series keeps of a list, and the mark for more.
MOST, OVERFLOW = 64, {"classes": "unsupported-overflow", "modalities": "unsupported-overflow", "burned_in": "UNKNOWN"}
# End of fixed values.


def _attributes(best, any_) -> dict[str, Column]:
    """Attributes of a file's root, and what its elements show anywhere. best(tag, value) is the greatest value of the root's elements with a tag,
    any_(condition) whether it holds somewhere; both take functions of an element, whose fields are its items."""
    root, tag = lambda r: r["depth"] == 0, lambda r, g, e: (r["grp"] == g) & (r["elem"] == e)
    head = lambda r: F.get(r["values"], F.lit(0))
    private = lambda r, creator, g, low: (r["grp"] == g) & (r["elem"].bitwiseAND(0xFF) == low) & (F.upper(F.trim(r["creator"])) == creator.upper())
    number = lambda r: head(r).try_cast("double")
    philips = "Philips MR Imaging DD 001"
    found = {n: best(t, lambda v: F.when(F.get(v, F.lit(0)) != "", F.get(v, F.lit(0)))) for n, t in SINGLE.items()}
    found |= {n: best(t, lambda v: F.filter(v, lambda x: x != "")) for n, t in LISTS.items()}
    return found | {
        "overlay": any_(lambda r: root(r) & (r["grp"].between(0x6000, 0x60FF) | (r["grp"] == 0x0070))),
        "csa": any_(lambda r: private(r, "SIEMENS CSA HEADER", 0x0029, 0x10) & F.startswith(head(r), F.lit("53563130"))),
        "slices": any_(lambda r: private(r, "Image Private Header", 0x0065, 0x50) & number(r).between(1, 4096)),
        "b_value": any_(lambda r: tag(r, 0x0018, 0x9087) & (number(r) >= 0)),
        "diffused": any_(lambda r: tag(r, 0x0018, 0x9087) & (number(r) > 1)),
        "asl_technique": any_(lambda r: tag(r, 0x0018, 0x9250)),
        "asl_context": any_(lambda r: tag(r, 0x0018, 0x9257)),
        "scaling": any_(lambda r: private(r, philips, 0x2005, 0x0D) | private(r, philips, 0x2005, 0x0E)),
        "scaling_usable": any_(lambda r: private(r, philips, 0x2005, 0x0D)) & any_(lambda r: private(r, philips, 0x2005, 0x0E) & (number(r) > 0)),
    }


def _numbered(rows: DataFrame) -> DataFrame:
    return rows.withColumns({name: F.trim(name).try_cast("double") for name in NUMERIC})


def header_rows(elements: DataFrame) -> DataFrame:
    """One row for each file (column `file`) of parsed elements: attributes of its root, and what its elements show anywhere."""
    row = {c: F.col(c) for c in ("depth", "grp", "elem", "values", "creator")}
    at = lambda t: (F.col("depth") == 0) & (F.col("grp") == t[0]) & (F.col("elem") == t[1])
    found = _attributes(lambda t, value: F.max(F.when(at(t), value(F.col("values")))), lambda when: F.coalesce(F.bool_or(when(row)), F.lit(False)))
    return _numbered(elements.groupBy("file").agg(F.max("error").alias("error"), *[v.alias(n) for n, v in found.items()]))


#: The tags whose root elements give an attribute, and the names of their columns where these are set apart.
TAGS = {f"{g:04X}{e:04X}": (g, e) for g, e in (*SINGLE.values(), *LISTS.values())}


def header_rows_whole(files: DataFrame) -> DataFrame:
    """As header_rows, of files (file, elements) whose elements are one array each; nothing is shuffled.

    Root elements of TAGS may be set apart in columns (see writer.parsed_whole), so that they are not looked for once an attribute; other columns stay.
    """
    apart, own = "00080016" in files.columns, {"elements", *TAGS}

    def best(t, value):
        lists = F.col(f"{t[0]:04X}{t[1]:04X}") if apart else F.transform(F.filter("elements", lambda r: (r["depth"] == 0) & (r["grp"] == t[0]) & (r["elem"] == t[1])), lambda r: r["values"])
        return F.array_max(F.transform(lists, value))

    found = _attributes(best, lambda when: F.exists("elements", lambda r: F.coalesce(when(r), F.lit(False))))
    return _numbered(files.select(*[c for c in files.columns if c not in own], F.array_max(F.transform("elements", lambda r: r["error"])).alias("error"), *[v.alias(n) for n, v in found.items()]))


def normal(value: Column) -> Column:
    return F.upper(F.trim(F.regexp_replace(value, r"[ \t\n\f\r]+", " ")))


def differs(value: Column) -> Column:
    """Whether a group has two different values; missing ones agree with all. Minimum and maximum merge; no set is kept."""
    return F.coalesce(F.min(value) != F.max(value), F.lit(False))


def with_drift(rows: DataFrame, names: tuple[str, ...], order: str = "file") -> DataFrame:
    """Rows (series, order, instance_number, names) with `drift`: whether a measured value is out of tolerance of the running representative's."""
    before = Window.partitionBy("series").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    place = F.struct(F.coalesce("instance_number", F.lit(float("inf"))).alias("n"), F.col(order).alias("p"))
    rows = rows.withColumn("_leads", F.coalesce(place < F.min(place).over(before), F.lit(True)))
    drift = F.lit(False)
    for name in names:
        value = F.col(name)
        first = F.last(value, ignorenulls=True).over(before).isNull()
        rows = rows.withColumn(f"_{name}", F.when(value.isNotNull() & (F.col("_leads") | first), value))
        held = F.last(f"_{name}", ignorenulls=True).over(before)
        inexact = F.isnan(value) | F.isnan(held) | (F.abs(value) == float("inf")) | (F.abs(held) == float("inf"))
        apart = F.abs(value - held) > F.greatest(F.lit(1e-6), F.greatest(F.abs(value), F.abs(held)) * 1e-6)
        drift = drift | F.coalesce(held.isNotNull() & value.isNotNull() & (inexact | apart), F.lit(False))
    return rows.withColumn("drift", drift).drop("_leads", *[f"_{n}" for n in names])


def bounded_lists(rows: DataFrame, fields: dict[str, str]) -> DataFrame:
    """(series, one array for each field): its distinct values in order of first sight, MOST of them and a mark for more.

    All fields go through one shuffle by value and one by series; a series never holds more than MOST + 1 values of a field.
    """
    pairs = F.array(*[F.struct(F.lit(name).alias("field"), F.col(column).alias("value")) for name, column in fields.items()])
    seen = rows.select("series", "file", F.inline(pairs)).filter("value is not null").groupBy("series", "field", "value").agg(F.min("file").alias("first"))
    rank = F.row_number().over(Window.partitionBy("series", "field").orderBy("first", "value"))
    marks = F.create_map(*[F.lit(x) for pair in OVERFLOW.items() for x in pair])
    few = seen.withColumn("rank", rank).filter(F.col("rank") <= MOST + 1).withColumn("value", F.when(F.col("rank") > MOST, marks[F.col("field")]).otherwise(F.col("value")))
    cells = lambda name: F.transform(F.array_sort(F.collect_list(F.when(F.col("field") == name, F.struct("rank", "value")))), lambda x: x.value)
    return few.groupBy("series").agg(*[cells(name).alias(name) for name in fields])


def series_rows(headers: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """One row for each series with the columns that rules.classified asks for.

    headers: header_rows; sizes: (file, bytes) of all files, unless headers have `bytes`. A file without study or series is a series of its own; files that
    cannot be read count against the series that share their folder.
    """
    folder = F.regexp_extract("file", "^(.*)/", 1)
    good = headers.filter("error is null").withColumn("folder", folder)
    good = good if sizes is None else good.join(sizes, "file", "left")
    identified = F.col("study_uid").isNotNull() & F.col("series_uid").isNotNull()
    good = good.withColumn("series", F.when(identified, F.concat_ws("/", "study_uid", "series_uid")).otherwise(F.concat(F.lit("alone:"), "file")))
    texts = F.concat_ws(" ", "protocol", "description", "sequence_name")
    has = lambda word: F.exists("image_types", lambda v: F.upper(F.trim(v)) == word)
    original = F.coalesce(has("ORIGINAL") & has("PRIMARY") & ~has("DERIVED") & ~has("SECONDARY"), F.lit(False))
    good = good.withColumn("kinds", F.lower(F.concat_ws(" ", "image_types"))).withColumn("texts", F.lower(texts)).withColumn("original", original)
    versions = F.array_join(F.array_sort(canonical.software_versions(F.array_join("software", "\\"), canonical.manufacturer(F.col("manufacturer")))), "\\")
    for name in SETS:
        parts = F.array_sort(F.array_distinct(F.filter(F.transform(name, normal), lambda v: v != "")))
        good = good.withColumn(f"_{name}", F.when(F.size(parts) > 0, F.array_join(parts, "\\")))
    # forms that are compared, once a file: minimum and maximum would each have them anew
    forms = {n: normal(F.col(n)) for n in NORMAL} | {n: F.coalesce(getattr(canonical, n)(F.col(n)), normal(F.col(n))) for n in ("manufacturer", "model")}
    order = F.struct(F.coalesce("instance_number", F.lit(float("inf"))).alias("n"), "file")
    good = good.withColumns({"_versions": F.when(F.col("software").isNotNull(), versions), "_order": order, **{f"_{n}": v for n, v in forms.items()}})
    good = with_drift(good, MEASURED)
    conflicts = [differs(F.col(n)) for n in EXACT] + [differs(F.col(f"_{n}")) for n in (*forms, *SETS, "versions")] + [F.bool_or("drift")]
    conflict = conflicts[0]
    for c in conflicts[1:]:
        conflict = conflict | c
    of_first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("_order")))
    yes = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    grid = F.col("kinds").rlike("grid|vframe")
    grouped = good.groupBy("series").agg(
        F.min("study_uid").alias("study_uid"), F.min("series_uid").alias("series_uid"), F.count("*").alias("instances"), F.max("bytes").alias("largest"), F.sum("bytes").alias("bytes"), F.min("folder").alias("folder"),
        (differs(F.coalesce("patient_id", F.lit("\0"))) | differs(F.col("issuer"))).alias("mixed_subject"), conflict.alias("metadata_conflict"),
        yes(F.col("overlay")).alias("overlay_or_graphics"), yes(F.col("burned_in_value").isNull()).alias("burned_in_missing"), F.bool_and(F.col("burned_in_value").isNotNull() | F.col("original")).alias("all_original_primary"),
        F.bool_and("csa").alias("csa_safe"), yes(grid | F.col("slices")).alias("grid"), F.bool_and(~(grid | F.col("slices")) | F.col("slices")).alias("grid_verified"),
        F.bool_and("b_value").alias("diffusion_verified"), yes(F.col("diffused")).alias("diffused"), F.bool_and("asl_context").alias("asl_verified"), yes(F.col("asl_technique")).alias("asl_technique"),
        yes(F.col("scaling")).alias("private_scaling"), F.bool_and(~F.col("scaling") | F.col("scaling_usable")).alias("private_scaling_verified"),
        of_first("kinds").alias("image_type"), of_first("texts").alias("local"), F.lower(F.coalesce(of_first("sequence_name"), F.lit(""))).alias("sequence"),
        F.coalesce(F.array_join(of_first("scanning_list"), " "), F.lit("")).alias("scanning"), of_first("echo_planar").alias("echo_planar"), of_first("tr").alias("tr"), of_first("temporal").alias("temporal"),
    )
    # an instance that occurs twice, or has no number of its own: counted by number first, so that no series' numbers lie in one task
    numbers = good.groupBy("series", "sop_instance").agg(F.count("*").alias("n")).groupBy("series").agg(F.bool_or(F.col("sop_instance").isNull() | (F.col("n") > 1)).alias("duplicate_instance"))
    lists = bounded_lists(good, {"classes": "sop_class", "modalities": "modality", "burned_in": "burned_in_value"})
    broken = headers.filter("error is not null").withColumn("folder", folder).groupBy("folder").agg(F.count("*").alias("unreadable"))
    rows = grouped.join(numbers, "series").join(lists, "series", "left").join(broken, "folder", "left").withColumn("unreadable", F.coalesce("unreadable", F.lit(0)))
    for name in OVERFLOW:
        rows = rows.withColumn(name, F.coalesce(name, F.array().cast("array<string>")))
    return rows.withColumn("secondary_classes", F.array(*map(F.lit, validators.SECONDARY))).withColumn("allowed_classes", F.array(*map(F.lit, (validators.CLASSIC, validators.ENHANCED, validators.LEGACY))))
