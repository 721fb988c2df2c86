"""Every constant of the cleaning pipeline, as one frozen value that callers may replace in part."""

from __future__ import annotations

from dataclasses import dataclass, field

# Vocabularies, ranges and rules that results depend on.
NULL_TOKENS = ("", "na", "n/a", "n.a.", "null", "none", "nil", "-", "--", "?", "unknown", "unk", "not available", "not applicable", "#n/a", "nan")
DEPARTMENTS = {
    "cardiology": "Cardiology", "cardio": "Cardiology", "oncology": "Oncology", "onc": "Oncology", "onco": "Oncology",
    "orthopaedics": "Orthopaedics", "orthopedics": "Orthopaedics", "ortho": "Orthopaedics",
    "paediatrics": "Paediatrics", "pediatrics": "Paediatrics", "peds": "Paediatrics", "paeds": "Paediatrics",
    "neurology": "Neurology", "neuro": "Neurology", "emergency": "Emergency", "er": "Emergency", "a&e": "Emergency",
    "general medicine": "General Medicine", "gen med": "General Medicine", "genmed": "General Medicine",
}
GENDERS = {"m": "M", "male": "M", "man": "M", "f": "F", "female": "F", "woman": "F"}
SMOKERS = {"y": "Y", "yes": "Y", "true": "Y", "1": "Y", "smoker": "Y", "n": "N", "no": "N", "false": "N", "0": "N", "non-smoker": "N"}
BLOOD_TYPES = ("A+", "A-", "B+", "B-", "AB+", "AB-", "O+", "O-")
RANGES = {"height_cm": (30.0, 250.0), "weight_kg": (1.0, 400.0), "systolic_bp": (60.0, 260.0), "diastolic_bp": (30.0, 160.0), "total_charges": (0.0, 1_000_000.0)}
AGE_BANDS = ((13, "0-12"), (18, "13-17"), (40, "18-39"), (65, "40-64"), (None, "65+"))
CONSTANT_FILLS = {"gender": "Unknown", "department": "Unknown", "insurance_provider": "Self-Pay", "smoker": "Unknown"}
MEDIAN_GROUPS = {c: ("age_band", "gender") for c in ("height_cm", "weight_kg", "systolic_bp", "diastolic_bp")} | {"total_charges": ("department",)}
NEVER_FILLED = ("date_of_birth", "blood_type", "discharge_date", "diagnosis_code", "first_name", "last_name", "email", "phone")
DATE_COLUMNS = ("date_of_birth", "admission_date", "discharge_date")
BLOCKING_CHECKS = ("dob_missing", "age_out_of_range", "admission_missing", "discharge_before_admission", "bp_inverted", "bmi_implausible")


@dataclass(frozen=True)
class Config:
    key: str = "patient_id"
    null_tokens: tuple[str, ...] = NULL_TOKENS
    vocabularies: dict = field(default_factory=lambda: {"gender": GENDERS, "department": DEPARTMENTS, "smoker": SMOKERS})
    blood_types: tuple[str, ...] = BLOOD_TYPES
    ranges: dict = field(default_factory=lambda: dict(RANGES))
    constant_fills: dict = field(default_factory=lambda: dict(CONSTANT_FILLS))
    median_groups: dict = field(default_factory=lambda: dict(MEDIAN_GROUPS))
    date_columns: tuple[str, ...] = DATE_COLUMNS
    century_columns: tuple[str, ...] = ("date_of_birth",)
    threshold: float = 0.90
    strict_threshold: float = 0.96
    no_dob_threshold: float = 0.95
    max_block: int = 100
