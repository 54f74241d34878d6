"""Endurance-training analytics on Spark: loads, ratios, efficiency, records, quality and cohorts as lazy DataFrame plans."""

from __future__ import annotations

from importlib import import_module

#: public names by module; loaded when first used, so that Python workers import only what they run
_PUBLIC = {
    "sources.activities": ("load_local_activities", "write_table"),
    "sources.tracks": ("activity_streams", "parse_activity_file", "read_tracks"),
    "operators.acwr": ("calculate_acwr", "calculate_exposure"),
    "operators.ewma": ("calculate_acwr_ewma",),
    "operators.efficiency": ("calculate_decoupling", "calculate_ef", "decoupling_from_streams", "ef_from_streams"),
    "operators.pbs": ("best_efforts", "calculate_pbs"),
    "operators.quality": ("flag_quality", "quality_summary", "summarize_quality"),
    "operators.cohort": ("calculate_cohort_reference", "cohort_reference"),
    "checks": ("check_history", "described", "require_rows"),
    "samples": ("sample_acwr", "sample_decoupling", "sample_ef", "sample_exposure", "sample_pbs"),
    "charts": (
        "add_reference_bands", "palette_nature", "palette_vibrant", "plot_acwr", "plot_acwr_comparison", "plot_acwr_enhanced",
        "plot_decoupling", "plot_ef", "plot_exposure", "plot_pbs", "plot_with_reference", "render", "theme",
    ),
}
_WHERE = {name: module for module, names in _PUBLIC.items() for name in names}
__all__ = sorted(_WHERE)


def __getattr__(name: str):
    if name not in _WHERE:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    return getattr(import_module(f".{_WHERE[name]}", __name__), name)
