"""Ordered rules: the first that holds decides. Rules are data; the plan is one CASE expression."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gneiss.functions.text import contains_any


@dataclass(frozen=True)
class Rule:
    when: Column
    decision: str
    kind: str


def decide(rules: list[Rule], decision: str, kind: str) -> Column:
    """A struct (decision, kind) of the first rule that holds, else the given one. Unknown (null) does not hold."""
    pick = lambda d, k: F.struct(F.lit(d).alias("decision"), F.lit(k).alias("kind"))
    result = None
    for r in rules:
        hit = F.coalesce(r.when, F.lit(False))
        result = F.when(hit, pick(r.decision, r.kind)) if result is None else result.when(hit, pick(r.decision, r.kind))
    return result.otherwise(pick(decision, kind)) if result is not None else pick(decision, kind)


def evidence(codes: dict[str, Column]) -> Column:
    """The codes whose conditions hold, in order, as an array."""
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(code)) for code, c in codes.items()]))


#: The hold and exclusion gates of a series, in order: condition over the columns of a grouped series, decision, kind.
GATES = (
    ("coalesce(study_uid, '') = '' or coalesce(series_uid, '') = ''", "held", "missing_required_uid"),
    ("duplicate_instance", "held", "invalid_sop_instance_identity"),
    ("instances > 500000", "held", "series_exceeds_dicom_instance_limit"),
    ("unreadable > 0", "held", "source_file_changed_or_unreadable"),
    ("largest > 68719476736", "held", "dicom_instance_exceeds_64_gib"),
    ("bytes > 68719476736", "held", "series_exceeds_64_gib_uncompressed_dicom_limit"),
    ("mixed_subject", "held", "mixed_subject_series"),
    ("metadata_conflict", "held", "inconsistent_series_metadata"),
    ("size(classes) = 0", "held", "missing_required_sop_class"),
    ("arrays_overlap(classes, secondary_classes)", "held", "secondary_capture"),
    ("size(array_except(classes, allowed_classes)) > 0", "held", "unsupported_sop_class"),
    ("size(modalities) = 0", "held", "missing_required_modality"),
    ("exists(modalities, m -> m <> 'MR')", "excluded", "not_mr"),
    ("exists(burned_in, b -> b <> 'NO')", "held", "burned_in_annotation"),
    ("overlay_or_graphics", "held", "overlay_or_graphics"),
    ("burned_in_missing and enhanced", "held", "enhanced_mr_burned_in_annotation_not_declared"),
    ("burned_in_missing and not all_original_primary", "held", "burned_in_annotation_not_declared_unsafe_image_type"),
    ("mosaic and not csa_safe", "held", "classic_mosaic_requires_safe_csa"),
    ("grid and not grid_verified", "held", "uih_grid_slice_count_missing_or_invalid"),
    ("acquired_diffusion and not diffusion_verified", "held", "diffusion_scientific_metadata_incomplete"),
    ("asl and not asl_verified", "held", "asl_scientific_metadata_incomplete"),
    ("diffusion and asl", "held", "ambiguous_diffusion_and_asl_scientific_context"),
    ("private_scaling and not private_scaling_verified", "held", "philips_private_scientific_metadata_incomplete"),
)


def series_gates() -> list[Rule]:
    return [Rule(F.expr(condition), decision, kind) for condition, decision, kind in GATES]


def classify_series(functional: Column) -> Column:
    """Decision and kind of a grouped series: the gates, then functional or not."""
    rules = [*series_gates(), Rule(functional, "accepted", "functional_epi")]
    return decide(rules, "excluded", "not_functional_epi")


def confidence(score: Column) -> Column:
    """0.90 and 0.01 for each point of score, five at most, never over 0.95."""
    return F.least(F.lit(0.95), 0.90 + 0.01 * F.least(score, F.lit(5)))


# What texts say about a series, in order of precedence, with the confidence of each kind.
DERIVED_TYPES, DERIVED_TEXTS = "derived|secondary|adc|tracew|fa map|overlay|graphic|presentation", "screensave|secondary capture|derived"
DIFFUSION_TEXTS, ASL_TEXTS, FUNCTIONAL_TYPES, FUNCTIONAL_SEQUENCES = "diffusion| dwi|dti|b0 map|tracew", " arterial spin| asl|pcasl|pasl", "epi|bold|fmri", "ep2d|epfid|epi|bold"
FUNCTIONAL_LABELS = "bold|fmri|functional|rest|task|movie|retinotopy"
KIND_TEXTS = (
    ("perfusion", 0.98, "perfusion| dsc| dce", ()),
    ("fieldmap", 0.98, "fieldmap|field map| fmap|topup|pepolar|blip|gre_field|b0map|se ap|se pa", ()),
    ("sbref", 0.99, "sbref|single band ref|single-band ref", ()),
    ("localizer", 0.99, "localizer|scout|survey|locator|three plane|3-plane", ()),
    ("structural_t1w", 0.98, "mprage|mp-rage|t1w|spgr|bravo", ("t1",)),
    ("structural_t2w", 0.98, "t2w|flair", ("t2", "space")),
    ("structural_other", 0.95, "structural|anatomical", ()),
)
# End of fixed values.


def contexts(series: DataFrame) -> DataFrame:
    """Grouped series with what their texts say: derived, diffusion, asl, strong evidence, score, and the columns of the gates.

    image_type, sequence and local are lower-cased texts; scanning, echo_planar, tr and temporal come from the representative.
    Columns diffused and asl_technique, where there are any, tell what files' elements show.
    """
    every = F.concat_ws(" ", "image_type", F.lower("scanning"), "sequence", "local")
    says = lambda x, needles: contains_any(x, needles.split("|"))
    kind, sequence, local = F.col("image_type"), F.col("sequence"), F.col("local")
    ep, yes = F.upper("scanning") == "EP", F.coalesce(F.upper("echo_planar") == "YES", F.lit(False))
    points = [(ep, 2), (yes, 2), (says(kind, FUNCTIONAL_TYPES), 2), (says(sequence, FUNCTIONAL_SEQUENCES), 2), (says(local, FUNCTIONAL_LABELS), 3), (F.col("tr").between(100, 20_000), 1), (F.col("temporal") >= 2, 2)]
    score = F.lit(0)
    for hit, worth in points:
        score = score + F.when(F.coalesce(hit, F.lit(False)), worth).otherwise(0)
    rows = series.withColumn("every", every).withColumn("score", score).withColumn("strong", ep | yes | says(kind, FUNCTIONAL_TYPES) | says(sequence, FUNCTIONAL_SEQUENCES))
    rows = rows.withColumn("derived", says(kind, DERIVED_TYPES) | says(F.col("every"), DERIVED_TEXTS)).withColumn("diffusion", says(F.col("every"), DIFFUSION_TEXTS)).withColumn("asl", says(F.col("every"), ASL_TEXTS))
    for context, shown in (("diffusion", "diffused"), ("asl", "asl_technique")):
        if shown in series.columns:
            rows = rows.withColumn(context, F.col(context) | F.col(shown))
    rows = rows.withColumn("derived_diffusion", F.col("diffusion") & F.col("derived") & ~says(kind, "original|mixed"))
    rows = rows.withColumn("acquired_diffusion", F.col("diffusion") & ~F.col("derived_diffusion")).withColumn("mosaic", kind.contains("mosaic"))
    return rows.withColumn("enhanced", F.arrays_overlap("classes", F.slice("allowed_classes", 2, 2)))


def classified(series: DataFrame) -> DataFrame:
    """Grouped series with decision, kind, detected kind and confidence: the gates in order, then kinds in order of precedence."""
    rows = contexts(series)
    tokens = F.split("every", "[^A-Za-z0-9]")
    kinds = [(F.col("derived_diffusion"), "derived_mr", F.lit(0.99)), (F.col("diffusion"), "diffusion", F.lit(0.99)), (F.col("asl"), "asl_perfusion", F.lit(0.99))]
    for name, sure, needles, words in KIND_TEXTS:
        hit = contains_any(F.col("every"), needles.split("|"))
        kinds.append((hit | F.arrays_overlap(tokens, F.array(*map(F.lit, words))) if words else hit, name, F.lit(sure)))
    timed = F.col("strong") & (F.col("temporal") >= 2) & F.col("tr").between(100, 20_000)
    kinds += [(F.col("derived"), "derived_mr", F.lit(0.99)), (timed, "functional_epi", confidence(F.col("score"))), (F.lit(True), "other_mr", F.lit(0.9))]
    found = F.lit(None).cast("struct<kind: string, sure: double>")
    for hit, name, sure in reversed(kinds):
        found = F.when(F.coalesce(hit, F.lit(False)), F.struct(F.lit(name).alias("kind"), sure.cast("double").alias("sure"))).otherwise(found)
    rows = rows.withColumn("found", found).withColumn("gate", decide(series_gates(), "", ""))
    held, functional = F.col("gate.kind") != "", F.col("found.kind") == "functional_epi"
    return rows.select(
        *series.columns,
        F.when(held, F.col("gate.decision")).when(functional, "accepted").otherwise("excluded").alias("decision"),
        F.when(held, F.col("gate.kind")).when(functional, "functional_epi").otherwise("not_functional_epi").alias("kind"),
        F.when(~held, F.col("found.kind")).alias("detected"),
        F.when(held, 1.0).otherwise(F.col("found.sure")).alias("confidence"),
    )
