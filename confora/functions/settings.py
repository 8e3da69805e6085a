"""Spellings of configured choices, and ids of structures from file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: For each setting its default, its values, and other spellings of them.
CHOICES = {
    "score_scope": ("source_if_available", ("input", "source_if_available", "source_required"), {
        "legacy": "input", "current": "input", "trimmed": "input", "source": "source_if_available", "original": "source_if_available",
        "full_length": "source_if_available", "full_length_required": "source_required",
    }),
    "clash_method": ("standard", ("standard", "vdw"), {
        "collision_py_exact": "standard", "collision_py": "standard", "colision_py": "standard", "colision_py_exact": "standard", "legacy": "standard",
        "legacy_exact": "standard", "manuscript": "standard", "article": "standard", "current": "vdw", "optimized_vdw": "vdw",
    }),
    "profile": ("standard", ("standard", "general"), {
        "manuscript_legacy": "standard", "legacy": "standard", "manuscript": "standard", "article": "standard", "article_reproduction": "standard",
        "manuscript_strict": "standard", "general_v1": "general", "generalized": "general", "batch": "general",
    }),
    "contact_units": ("universal_rules", ("universal_rules", "guided_review", "conservative_manual"), {
        "universal": "universal_rules", "s4": "universal_rules", "s4_rules": "universal_rules", "automatic": "universal_rules", "auto_merge": "universal_rules",
        "guided": "guided_review", "recommendations": "guided_review", "chemistry_guided": "guided_review", "manual": "conservative_manual",
        "conservative": "conservative_manual", "atom_level": "conservative_manual",
    }),
    "alignment": ("auto", ("auto", "coordinate_matching", "sequence_aware"), {
        "compatible_auto": "auto", "dock_py_exact": "coordinate_matching", "legacy": "coordinate_matching", "original": "coordinate_matching", "general": "sequence_aware",
    }),
}
#: Endings of file stems that are no part of an id, by the stage that reads them.
ENDINGS = {
    "classify": ("_final", "_trimmed_complex", "_filtered_complex", "_passed_complex", "_complex"),
    "export": ("_final", "_trimmed_complex", "_filtered_complex", "_passed_complex", "_protonated", "_xcbrefx", "_complex"),
}


def choice(setting: str, value: object = None) -> str:
    """The canonical spelling of a configured value; an unknown one raises."""
    default, values, spellings = CHOICES[setting]
    raw = str(value or default).strip().lower()
    found = spellings.get(raw, raw)
    if found not in values:
        raise ValueError(f"{setting} must be one of {', '.join(values)}, not {value!r}")
    return found


def choice_column(setting: str, value: Column) -> Column:
    """``choice`` of a column of spellings; unknown ones are null."""
    default, values, spellings = CHOICES[setting]
    raw = F.lower(F.trim(F.coalesce(F.nullif(value, F.lit("")), F.lit(default))))
    known = F.create_map(*[F.lit(x) for kv in ({v: v for v in values} | spellings).items() for x in kv])
    return F.element_at(known, raw)


def stem(path: Column) -> Column:
    """The file name without its last suffix."""
    return F.regexp_replace(F.regexp_replace(path, r"^.*/", ""), r"(?<=.)\.[^.]*$", "")


def structure_id(path: Column, stage: str = "classify") -> Column:
    """The id in a path or file name: its stem less all endings of the stage."""
    ends = "|".join(ENDINGS[stage])
    return F.regexp_replace(stem(F.trim(path)), f"(?:{ends})+$", "")
