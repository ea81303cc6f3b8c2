"""Governed ingest of raw transition records: provenance, quality flags, duplicates, audit, sidecars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from ..functions import text as T
from ..functions import vectors as V
from ..operators import checks, stats
from ..schemas import STRUCTURE
from ..shared import stored

FIELDS = ("jid", "formula", "target", "XC", "bibtex", "crystal_class", "sys_name", "space_group", "structure_ini", "structure_fin")
RAW = StructType(
    [StructField("raw_index", LongType()), *[StructField(c, DoubleType() if c == "target" else STRUCTURE if c.startswith("structure") else StringType()) for c in FIELDS]]
)


# The quality flags, in the order in which they are given.
MISSING_METADATA = "MISSING_METADATA_"
STRUCTURE_FLAGS = {"structure_ini": ("MISSING_STRUCTURE_INI", "INVALID_STRUCTURE_INI"), "structure_fin": ("MISSING_STRUCTURE_FIN", "INVALID_STRUCTURE_FIN")}
BARRIER_FLAGS = ("BARRIER_NOT_NUMERIC", "BARRIER_NOT_FINITE", "BARRIER_NEGATIVE", "BARRIER_IQR_OUTLIER")
FORMULA_FLAG = "FORMULA_REDUCTION_FAILED"
ORDER_FLAG, UNRESOLVED_FLAG, AMBIGUOUS_FLAG = "STRUCTURE_ELEMENT_ORDER_MISMATCH", "MIGRATING_SPECIES_UNRESOLVED", "MIGRATING_SPECIES_AMBIGUOUS"
SOURCE_FLAG = "MISSING_BIBTEX_CITATION_KEY"
REPEATED_FLAGS = {"structure_ini_hash": ("initial_structure", "REPEATED_INITIAL_STRUCTURE"), "structure_fin_hash": ("final_structure", "REPEATED_FINAL_STRUCTURE")}
TRANSITION_FLAG, JID_FLAG = "DUPLICATE_TRANSITION_RECORD", "DUPLICATE_JID"
UNRESOLVED = "UNRESOLVED"
#: A greatest displacement up to this many angstrom moves nothing.
MINIMUM_DISPLACEMENT = 0.05


def barrier_flag(column: str, lower: Column, upper: Column) -> Column:
    """The flag of a barrier, null where there is none: missing, not finite, negative, or beyond the fences."""
    x = F.col(column)
    wrong = F.when(x.isNull(), BARRIER_FLAGS[0]).when(F.isnan(x) | (F.abs(x) == float("inf")), BARRIER_FLAGS[1]).when(x < 0, BARRIER_FLAGS[2])
    return F.coalesce(wrong, F.when((x < lower) | (x > upper), BARRIER_FLAGS[3]))


def migration(before: Column, after: Column, sound: Column, least: float) -> Column:
    """struct(species, displacement, flags) from the greatest wrapped displacement between two structures."""
    moved = F.transform(
        F.arrays_zip(before["elements"].alias("e"), before["coords"].alias("x"), after["coords"].alias("y")),
        lambda s: F.struct(s["e"].alias("e"), V.norm(V.to_cartesian(V.wrap_half_up(V.subtract3(s["y"], s["x"])), before["lattice_mat"])).alias("d")),
    )
    most = F.array_max(F.transform(moved, lambda s: s["d"]))
    close = F.greatest(F.lit(1e-12), most * 1e-9)
    species = F.array_sort(F.array_distinct(F.transform(F.filter(moved, lambda s: F.abs(s["d"] - most) <= close), lambda s: s["e"])))

    def said(name: Column | str, displacement: Column, *flags: str) -> Column:
        name = F.lit(name) if isinstance(name, str) else name
        return F.struct(name.alias("species"), displacement.cast("double").alias("displacement"), F.array(*[F.lit(f) for f in flags]).cast("array<string>").alias("flags"))

    nothing = F.lit(None).cast("double")
    same = (before["elements"] == after["elements"]) & (F.size(before["coords"]) == F.size(after["coords"]))
    return (
        F.when(~sound, said(UNRESOLVED, nothing, UNRESOLVED_FLAG))
        .when(~same, said(UNRESOLVED, nothing, ORDER_FLAG, UNRESOLVED_FLAG))
        .when(F.isnan(most) | (most <= least), said(UNRESOLVED, most, UNRESOLVED_FLAG))
        .when(F.size(species) != 1, said(UNRESOLVED, most, AMBIGUOUS_FLAG))
        .otherwise(said(species[0], most))
    )


def provenance(raw: DataFrame, fallback: str = "unresolved", least: float = MINIMUM_DISPLACEMENT) -> DataFrame:
    """One row a record: ids, reduced formula, migrating species, group, hashes, completeness, duplicates and flags.

    Hashes are over canonical JSON, so equal structures have equal hashes; one that isn't sound has none.
    Duplicates are counted per key first.  Flags review, they drop no record.
    """
    kinds = dict(raw.dtypes)
    there = {c: T.present(F.col(c), kinds[c]) for c in FIELDS}
    sound = {c: checks.sound_structure(F.col(c)) for c in STRUCTURE_FLAGS}
    rows = raw.select(
        "raw_index", T.record_id(F.col("raw_index"), F.col("jid")).alias("record_id"), F.coalesce("jid", F.lit("None")).alias("jid"), T.text_number(F.col("formula")).alias("formula"),
        F.coalesce(T.reduced_formula("formula"), F.lit(UNRESOLVED)).alias("reduced_formula"), migration(F.col("structure_ini"), F.col("structure_fin"), sound["structure_ini"] & sound["structure_fin"], least).alias("_m"),
        F.col("target").alias("barrier_eV"), T.text_number(F.col("XC")).alias("XC"), T.text_number(F.col("bibtex")).alias("bibtex"), T.source_group(F.col("bibtex"), F.lit(fallback)).alias("source_group"),
        *[T.text_number(F.col(c)).alias(c) for c in ("crystal_class", "sys_name", "space_group")],
        *[F.when(sound[c], T.json_sha256(F.to_json(c))).alias(f"{c}_hash") for c in STRUCTURE_FLAGS],
        (sum((x.cast("int") for x in there.values()), F.lit(0)) / len(FIELDS)).alias("metadata_completeness"), T.json_sha256(F.to_json(F.struct(*FIELDS), {"ignoreNullFields": "false"})).alias("raw_record_sha256"),
        F.array_compact(F.array(*[F.when(~x, F.lit(c)) for c, x in there.items()])).alias("_missing"), T.source_resolved(F.col("bibtex")).alias("_resolved"),
        *[F.when(~there[c], F.lit(missing)).when(~sound[c], F.lit(wrong)).alias(f"_{c}") for c, (missing, wrong) in STRUCTURE_FLAGS.items()],
    )
    transition = F.when(F.col("structure_ini_hash").isNotNull(), T.json_sha256(F.to_json(F.array(F.col("structure_ini_hash"), F.coalesce("structure_fin_hash", F.lit("")), T.float_text("barrier_eV")))))
    rows = rows.withColumn("_transition", transition)
    for key, size in ((["structure_ini_hash"], "_ini"), (["structure_fin_hash"], "_fin"), (["_transition"], "_same"), (["jid"], "_jid")):
        rows = stats.duplicate_groups(rows, key, size)
    rows = rows.crossJoin(F.broadcast(stats.fences(raw.select(F.col("target")), "target").select("lower", "upper")))  # one row of fences
    again = {"structure_ini_hash": F.col("structure_ini_hash").isNotNull() & (F.col("_ini") > 1), "structure_fin_hash": F.col("structure_fin_hash").isNotNull() & (F.col("_fin") > 1)}
    same = F.col("_transition").isNotNull() & (F.col("_same") > 1)
    flags = F.concat(
        F.array(
            F.when(F.size("_missing") > 0, F.concat(F.lit(MISSING_METADATA), F.array_join("_missing", "_"))), F.col("_structure_ini"), F.col("_structure_fin"),
            barrier_flag("barrier_eV", F.col("lower"), F.col("upper")), F.when(F.col("reduced_formula") == UNRESOLVED, FORMULA_FLAG),
        ),
        F.col("_m.flags"),
        F.array(F.when(~F.col("_resolved"), SOURCE_FLAG), *[F.when(again[c], flag) for c, (_, flag) in REPEATED_FLAGS.items()], F.when(same, TRANSITION_FLAG), F.when(F.col("_jid") > 1, JID_FLAG)),
    )
    groups = [F.when(again[c], F.concat(F.lit(f"{prefix}_"), F.substring(c, 1, 16))) for c, (prefix, _) in REPEATED_FLAGS.items()]
    groups.append(F.when(same, F.concat(F.lit("transition_"), F.substring("_transition", 1, 16))))
    return rows.select(
        "record_id", "raw_index", "jid", "formula", "reduced_formula", F.col("_m.species").alias("migrating_species"), "barrier_eV", "XC", "bibtex", "source_group", "crystal_class", "sys_name", "space_group",
        *[T.text_number(F.col(f"{c}_hash")).alias(f"{c}_hash") for c in STRUCTURE_FLAGS], F.format_string("%.3f", "metadata_completeness").alias("metadata_completeness"),
        F.array_join(F.array_compact(F.array(*groups)), ";").alias("duplicate_group_id"), T.packed_flags(F.array_distinct(F.array_compact(flags))).alias("quality_flag"),
        F.col("_m.displacement").alias("migration_displacement_A"), "raw_record_sha256",
    )


def _has(*flags: str) -> Column:
    return F.exists(F.split("quality_flag", ";"), lambda f: f.isin(*flags))


def audit(rows: DataFrame) -> DataFrame:
    """Counts over all records in one aggregate."""
    count = lambda *flags: F.count_if(_has(*flags))
    structures = [f for pair in STRUCTURE_FLAGS.values() for f in pair] + [ORDER_FLAG]
    return rows.agg(
        F.count("*").alias("records"), F.countDistinct("jid").alias("jids"), F.count_if(F.col("metadata_completeness").cast("double") < 1).alias("metadata_incomplete_records"),
        count(*structures).alias("missing_or_invalid_structure_records"), count(UNRESOLVED_FLAG, AMBIGUOUS_FLAG).alias("migrating_species_unresolved_records"),
        count(FORMULA_FLAG).alias("formula_reduction_failure_records"), count(*BARRIER_FLAGS[:3]).alias("invalid_barrier_records"), count(BARRIER_FLAGS[3]).alias("barrier_iqr_outlier_records"),
        count(TRANSITION_FLAG).alias("exact_duplicate_transition_records"), count("REPEATED_INITIAL_STRUCTURE").alias("repeated_initial_structure_records"),
        count("REPEATED_FINAL_STRUCTURE").alias("repeated_final_structure_records"), F.count_if(F.col("quality_flag") != "OK").alias("records_requiring_manual_confirmation"),
    )


def value_counts(rows: DataFrame) -> DataFrame:
    """(kind, value, n) of the functional, the source group, the migrating species and the flags."""
    parts = [stats.count_by(rows, c).select(F.lit(f"by_{c}").alias("kind"), F.col(c).alias("value"), "n") for c in ("XC", "source_group", "migrating_species")]
    parts.append(stats.flag_counts(rows).select(F.lit("quality_flags").alias("kind"), F.col("flag").alias("value"), "n"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


#: What to do about a flag, by the first pattern that it matches.
GUIDANCE = (
    ("^BARRIER_IQR_OUTLIER$", "Check the barrier and its unit against the cited source; the flag is statistical and excludes nothing."),
    ("^REPEATED_", "Compare structures, route and end points; a structure may rightly be used by several transitions."),
    ("^DUPLICATE_", "Find out whether the record was repeated on purpose or by accident."),
    ("STRUCTURE|MIGRATING", "Look at the raw structures and at the species assigned before using the record."),
    ("", "Look at the raw record and keep the finding with it."),
)


def guidance(flag: Column) -> Column:
    out = F.lit(GUIDANCE[-1][1])
    for pattern, advice in reversed(GUIDANCE[:-1]):
        out = F.when(flag.rlike(pattern), advice).otherwise(out)
    return out


def review(rows: DataFrame) -> DataFrame:
    """One row per (record, flag) with what to do about it."""
    keys = ["record_id", "raw_index", "jid", "formula", "migrating_species", "barrier_eV", "duplicate_group_id"]
    return stats.review_rows(rows, keys).withColumnRenamed("flag", "review_reason").withColumn("review_guidance", guidance(F.col("review_reason")))


def markdown(counts: dict, checksums: dict[str, dict]) -> str:
    """The audit as a page: counts, then every table with its checksum and rows."""
    lines = ["# Data governance", "", *[f"- {name.replace('_', ' ')}: {n}" for name, n in counts.items()], "", "## Tables", ""]
    lines += [f"- `{name}`: `{x['checksum']}` ({x['rows']} rows)" for name, x in checksums.items()]
    return "\n".join([*lines, "", "Flags mark records for review; none is dropped."]) + "\n"


def run(raw: DataFrame, folder: str) -> dict[str, DataFrame]:
    """The whole job: rows, audit and review written with their sidecars."""
    from ..sources import sinks

    require = checks.missing_columns(raw, ["raw_index", *FIELDS])
    if require:
        raise checks.CheckError(f"columns are missing: {require}")
    checks.require_none(checks.duplicate_keys(raw, ["raw_index"]), "repeated raw_index")
    rows = stored(provenance(raw))  # read by every table that follows
    out = {"provenance": rows, "audit": audit(rows), "review": review(rows), "counts": value_counts(rows)}
    notes = {name: sinks.write_csv_artifacts(df, f"{folder}/{name}") for name, df in out.items()}
    page = markdown(out["audit"].first().asDict(), {name: x["audit"] for name, x in notes.items()})
    sinks.write_text(raw.sparkSession, page, f"{folder}/audit_page")
    return out
