"""Runnable jobs over the library; each also is a query of the catalog."""

from __future__ import annotations

from . import epoch_plan, language_profiles

QUERIES = {"job1_epoch_plan": epoch_plan.job1_epoch_plan, "job2_language_profiles": language_profiles.job2_language_profiles}
ORACLES = {"job1_epoch_plan": epoch_plan.ORACLE, "job2_language_profiles": language_profiles.ORACLE}
