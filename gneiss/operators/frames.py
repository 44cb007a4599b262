"""Frames of multi-frame files: what is said once for all frames, overridden by what each frame says, as one row a frame.

Rows are parsed elements. A frame's macro counts as a whole: if the frame has it, nothing of the shared one is taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gneiss.operators import validators

# The two functional group sequences, the diffusion macro and its attributes.
SHARED, PER_FRAME = "52009229", "52009230"
DIFFUSION = "00189117"
B_VALUE, DIRECTIONALITY, DIRECTION, ORIENTATION = "00189087", "00189075", "00189076", "00189089"
DIRECTIONS = ("NONE", "ISOTROPIC", "DIRECTIONAL", "BMATRIX")
# End of fixed values.


def tag_of(grp: str = "grp", elem: str = "elem") -> Column:
    return F.concat(F.lpad(F.hex(grp), 4, "0"), F.lpad(F.hex(elem), 4, "0"))


def storage_kind(rows: DataFrame) -> DataFrame:
    """(file, kind): classic, enhanced or other, by the class of the file's root."""
    named = F.max(F.when((F.col("depth") == 0) & (F.col("grp") == 0x0008) & (F.col("elem") == 0x0016), F.get("values", F.lit(0))))
    kind = F.when(named == validators.CLASSIC, "classic").when(named.isin(validators.ENHANCED, validators.LEGACY), "enhanced").otherwise("other")
    return rows.groupBy("file").agg(kind.alias("kind"))


def frame_macros(rows: DataFrame, macro: str) -> DataFrame:
    """(file, frame, source, items, values) for each frame of each file with functional groups.

    source: `frame`, `shared` or null where neither has the macro; items: of the macro's sequence; values: a map from an attribute's path below the macro's
    first item (tags joined by slashes, items left out) to its values. Only the shared macro is copied, to the frames that lack their own.
    """
    tag, first = tag_of(), F.get("item_path", F.lit(0))
    group, index = F.substring(first, 1, 8), F.regexp_extract(first, r"\[(\d+)\]", 1)
    frames = rows.filter((F.col("depth") == 0) & (tag == PER_FRAME)).select("file", F.explode(F.sequence(F.lit(0), F.col("items") - 1)).alias("frame"), "items").filter("items > 0").drop("items")
    inside = rows.filter((F.col("depth") > 0) & group.isin(SHARED, PER_FRAME)).withColumn("at", F.when(group == PER_FRAME, index.cast("int")).otherwise(-1)).withColumn("tag", tag)
    heads = inside.filter((F.col("depth") == 1) & (F.col("tag") == macro)).select("file", "at", F.col("items"))
    below = inside.filter((F.col("depth") > 1) & (F.get("item_path", F.lit(1)) == f"{macro}[0]") & (F.col("vr") != "SQ"))
    path = F.array_join(F.array_append(F.transform(F.slice("item_path", 3, F.size("item_path")), lambda p: F.substring(p, 1, 8)), F.col("tag")), "/")
    values = below.groupBy("file", "at").agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct(path.alias("key"), F.array_join("values", "\\").alias("value"))))).alias("values"))
    macros = heads.join(values, ["file", "at"], "left")
    own = macros.filter("at >= 0").select("file", F.col("at").alias("frame"), F.col("items").alias("_own"), F.col("values").alias("_values"))
    shared = macros.filter("at < 0").select("file", F.col("items").alias("_shared"), F.col("values").alias("_default"))
    both = frames.join(own, ["file", "frame"], "left").join(shared, "file", "left")
    mine = F.col("_own").isNotNull()
    source = F.when(mine, "frame").when(F.col("_shared").isNotNull(), "shared")
    return both.select("file", "frame", source.alias("source"), F.when(mine, F.col("_own")).otherwise(F.col("_shared")).alias("items"), F.when(mine, F.col("_values")).otherwise(F.col("_default")).alias("values"))


def root_macro(rows: DataFrame) -> DataFrame:
    """The diffusion attributes at a file's root as a macro of one frame, numbered 0; files without any give no row."""
    tag = tag_of()
    at_root = rows.filter((F.col("depth") == 0) & tag.isin(B_VALUE, DIRECTIONALITY, ORIENTATION))
    key = F.when(tag == ORIENTATION, f"{DIRECTION}/{ORIENTATION}").otherwise(tag)
    values = F.map_from_entries(F.array_sort(F.collect_set(F.struct(key.alias("key"), F.array_join("values", "\\").alias("value")))))
    return at_root.groupBy("file").agg(values.alias("values")).select("file", F.lit(0).alias("frame"), F.lit("root").alias("source"), F.lit(1).alias("items"), "values")


def diffusion_complete(items: Column, values: Column) -> Column:
    """Whether a frame's macro says enough: one item, a weighting from 0 on, a known directionality, and a unit vector if it is directional."""
    numbers = lambda key: F.transform(F.split(F.get(F.filter(F.map_entries(values), lambda e: e.key == key), F.lit(0)).value, r"\\"), lambda x: x.try_cast("double"))
    kind, weight = F.try_element_at(values, F.lit(DIRECTIONALITY)), F.try_element_at(values, F.lit(B_VALUE)).try_cast("double")
    directed = F.coalesce(validators.unit_vector(numbers(f"{DIRECTION}/{ORIENTATION}")), F.lit(False))
    return F.coalesce((items == 1) & (weight >= 0) & ~F.isnan(weight) & kind.isin(*DIRECTIONS) & ((kind != "DIRECTIONAL") | directed), F.lit(False))


def frame_contracts(rows: DataFrame) -> DataFrame:
    """(file, kind, present, frames, shared, valid): the diffusion contract by storage kind.

    Classic files state it at their root, in one frame; enhanced ones in every frame, and never at the root; others cannot keep it.
    """
    kinds = storage_kind(rows)
    judged = lambda m: m.withColumn("fine", diffusion_complete(F.col("items"), F.col("values")))
    many = judged(frame_macros(rows, DIFFUSION)).groupBy("file").agg(F.count("source").alias("n"), F.count("*").alias("frames"), F.count_if(F.col("source") == "shared").alias("shared"), F.bool_and("fine").alias("all_fine"))
    root = judged(root_macro(rows)).select("file", F.col("fine").alias("root_fine"))
    any_tag = rows.filter(tag_of().isin(DIFFUSION, B_VALUE, DIRECTIONALITY, DIRECTION, ORIENTATION)).groupBy("file").agg(F.lit(True).alias("anywhere"))
    whole = kinds.join(many, "file", "left").join(root, "file", "left").join(any_tag, "file", "left")
    kind, at_root = F.col("kind"), F.col("root_fine").isNotNull()
    return whole.select(
        "file", "kind",
        F.when(kind == "enhanced", True).when(kind == "classic", at_root).otherwise(F.coalesce("anywhere", F.lit(False))).alias("present"),
        F.when(kind == "enhanced", F.coalesce("frames", F.lit(0))).otherwise(1).cast("long").alias("frames"),
        F.when(kind == "enhanced", F.coalesce("shared", F.lit(0))).otherwise(0).cast("long").alias("shared"),
        F.when(kind == "enhanced", ~at_root & F.coalesce("all_fine", F.lit(False))).when(kind == "classic", F.coalesce("root_fine", F.lit(False))).otherwise(False).alias("valid"),
    )
