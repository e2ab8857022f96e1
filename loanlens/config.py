"""Settings that change a published number, and the fingerprint over them."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field, replace

# Field lists, windows and thresholds that results depend on.
LOAN_NUMERIC = (
    "gross_approval", "sba_guaranteed", "initial_rate", "jobs_supported",
    "guarantee_pct", "log_gross_approval",
)
LOAN_CATEGORICAL = (
    "naics_sector", "business_type", "business_age", "revolver_status", "collateral_ind",
    "rate_type", "processing_method", "borrower_state", "has_franchise",
)
LOAN_FORBIDDEN = ("term_months", "is_chargeoff", "chargeoff_amount", "approval_fy")

APPLICATION_NUMERIC = (
    "loan_amount", "income", "dti", "ltv", "property_value", "loan_to_income",
    "log_loan_amount", "tract_to_msa_income_percentage", "tract_owner_occupied_units",
    "msa_median_income",
)
APPLICATION_CATEGORICAL = (
    "state_code", "loan_type", "loan_purpose", "lien_status", "occupancy_type",
    "construction_method", "conforming_loan_limit", "preapproval", "open_end_line",
    "business_purpose", "dwelling_category", "loan_product_type",
    "submission_of_application",
)
PROTECTED = ("race", "ethnicity", "sex", "age_bucket", "age")
NON_GROUPS = ("Race Not Available", "Joint", "Free Form Text Only")

GATE_THRESHOLDS = (
    # gate, direction, threshold
    ("auc_test", "min", 0.6894),
    ("auc_drop", "max", 0.08),
    ("brier_test", "max", 0.0868),
    ("ece_test", "max", 0.02),
    ("margin_over_baseline", "min", 0.02),
    ("disparate_impact", "min", 0.80),
)


@dataclass(frozen=True)
class Settings:
    """Declared windows, filters and thresholds. Years never come from a directory listing."""

    resolved_statuses: tuple[str, ...] = ("P I F", "CHGOFF")
    not_booked_statuses: tuple[str, ...] = ("CANCLD",)
    bad_status: str = "CHGOFF"
    paid_status: str = "P I F"
    excluded_programs: tuple[str, ...] = ("PPP",)
    train: tuple[int, int] = (2011, 2015)
    valid: tuple[int, int] = (2016, 2016)
    test: tuple[int, int] = (2017, 2018)
    stress: tuple[tuple[str, int, int], ...] = (
        ("crisis_2005_2008", 2005, 2008),
        ("covid_2020_2021", 2020, 2021),
        ("recent_2019", 2019, 2019),
    )
    watch_from: int = 2016
    psi_warn: float = 0.10
    psi_action: float = 0.25
    unsupported_alarm: float = 0.05
    min_support: float = 0.005
    maturity_window: int = 24
    maturity_windows: tuple[int, ...] = (12, 24, 36, 48, 60)
    emergence_months: tuple[int, ...] = (12, 24, 36, 48, 60, 84, 120)
    maturity_tolerance: float = 0.32
    maturity_from: int = 2005
    application_years: tuple[int, ...] = (2020, 2021, 2022, 2023, 2024)
    application_train: tuple[int, int] = (2020, 2022)
    application_valid: tuple[int, int] = (2023, 2023)
    application_test: tuple[int, int] = (2024, 2024)
    sample_pct: tuple[tuple[str, float], ...] = (("train", 10.0), ("valid", 25.0), ("test", 25.0))
    event_years: tuple[int, ...] = (2018, 2019, 2020, 2021, 2022, 2023, 2024, 2025)
    base_year: int = 2021
    shock_year: int = 2022
    regimes: tuple[tuple[str, int, int], ...] = (
        ("before", 2018, 2019), ("boom", 2020, 2021), ("after", 2023, 2025),
    )
    focal_group: str = "Black or African American"
    reference_group: str = "White"
    cell_keys: tuple[str, ...] = ("county_code", "loan_purpose", "lien_status", "occupancy_type")
    min_per_cell_group: int = 25
    meaningful_pp: float = 1.0
    min_signal_auc: float = 0.65
    four_fifths: float = 0.80
    approval_rate: float = 0.75
    default_guarantee: float = 0.75
    severity: float = 0.735
    margins: tuple[float, ...] = (0.02, 0.03, 0.05, 0.08)
    n_bins: int = 10
    seed: int = 42
    numeric: tuple[str, ...] = field(default=LOAN_NUMERIC)
    categorical: tuple[str, ...] = field(default=LOAN_CATEGORICAL)
    forbidden: tuple[str, ...] = field(default=LOAN_FORBIDDEN)

    def split_windows(self) -> tuple[tuple[str, int, int], ...]:
        return (("train", *self.train), ("valid", *self.valid), ("test", *self.test))

    def fingerprint(self) -> str:
        """First 16 hex digits of the SHA-256 of the settings that move a metric."""
        material = {
            "splits": [list(w) for w in self.split_windows()],
            "exclusions": [list(self.resolved_statuses), list(self.excluded_programs)],
            "target": self.bad_status,
            "features": [list(self.numeric), list(self.categorical), list(self.forbidden)],
            "seed": self.seed,
        }
        return hashlib.sha256(json.dumps(material, sort_keys=True).encode()).hexdigest()[:16]


# The generated test tables span 1995-2001, so the windows move there.
TESTBED = replace(
    Settings(),
    train=(1995, 1997), valid=(1998, 1998), test=(1999, 2000),
    stress=(("early_1995_1996", 1995, 1996), ("mid_1996_1998", 1996, 1998), ("late_2001", 2001, 2001)),
    watch_from=1998, maturity_from=1995,
    application_years=(1996, 1997, 1998, 1999, 2000),
    application_train=(1996, 1998), application_valid=(1999, 1999), application_test=(2000, 2000),
    event_years=(1995, 1996, 1997, 1998, 1999, 2000, 2001), base_year=1998, shock_year=1999,
    regimes=(("before", 1995, 1996), ("boom", 1997, 1998), ("after", 2000, 2001)),
    cell_keys=("county_code", "loan_purpose", "lien_status"), min_per_cell_group=3,
)
