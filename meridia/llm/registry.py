"""The subpackage's queries and their SQL, by name."""

from __future__ import annotations

from meridia.llm import leaks, matching, packing, places, residue, survivors, variants


def queries() -> dict:
    return {
        "p1_found": matching.p1_found,
        "p1_scored": matching.p1_scored,
        "p4_found": survivors.p4_found,
        "p4_truth": survivors.p4_truth,
        "p5_found": variants.p5_found,
        "p6_found": places.p6_found,
        "p8_packed": packing.p8_packed,
        "p8_fill": packing.p8_fill,
        "p8_checked": packing.p8_checked,
        "p9_found": leaks.p9_found,
        "p10_found": residue.p10_found,
    }


def oracle_sql() -> dict:
    return {"p4_found": survivors.P4_SQL, "p8_checked": packing.P8_SQL}
