"""Decision tables as CASE projections."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Share of robustness of a branch status and of a consensus.
BRANCH_SCORE = {"preserved": 1.0, "weakened": 0.7, "shifted": 0.4, "branch-sensitive": 0.1}
CONSENSUS_SCORE = {"strong_agreement": 1.0, "partial_agreement": 0.72, "weak_agreement": 0.38, "insufficient": 0.18}
#: Flags that keep a tier from being lifted.
SERIOUS = ("unstable", "holdout-weak", "session-holdout-weak", "cohort-holdout-weak", "control-weak")


#: Least similarity and share of the reference's margin of a status.
STATUS_RULES = (("preserved", 0.8, 0.8), ("weakened", 0.55, 0.45))
SHIFTED = (0.35, 0.2)
#: Support, margin, success and draw limits of the flags.
FEW_SUBJECTS, FEW_EVENTS, WEAK_MARGIN, WEAK_SUCCESS, CHANCE_P, UNSTABLE_SIMILARITY = 3, 4, 0.05, 0.67, 0.2, 0.5
#: Limits of the tiers.
UNSTABLE_SUCCESS, STRONG_ROBUSTNESS, MODERATE_MARGIN, MODERATE_ROBUSTNESS = 0.5, 0.78, 0.08, 0.58


def branch_status(is_reference: Column, similarity: Column, margin: Column, reference_margin: Column) -> Column:
    """preserved, weakened, shifted or branch-sensitive."""
    ratio = (
        F.when(reference_margin.isNull() | (reference_margin == 0), F.lit(1.0)).when(margin.isNull(), F.lit(0.0)).otherwise(F.try_divide(margin, reference_margin))
    )
    out = F.when(is_reference, "preserved").when(similarity.isNull(), "branch-sensitive")
    for name, least, share in STATUS_RULES:
        out = out.when((similarity >= least) & (ratio >= share), name)
    return out.when((similarity >= SHIFTED[0]) & (ratio > SHIFTED[1]), "shifted").otherwise("branch-sensitive")


def reliability_flags(n_subjects: Column, n_events: Column, margin: Column, loso: Column, session: Column, cohort: Column, branch: Column, p_value: Column, subsample_min: Column) -> Column:
    """array<string> of what speaks against a pattern."""
    found = [
        ("low-support", (n_subjects < FEW_SUBJECTS) | (n_events < FEW_EVENTS)),
        ("control-weak", ~F.coalesce(margin > WEAK_MARGIN, F.lit(False))),
        ("holdout-weak", loso < WEAK_SUCCESS),
        ("session-holdout-weak", session < WEAK_SUCCESS),
        ("cohort-holdout-weak", cohort < WEAK_SUCCESS),
        ("branch-sensitive", branch.isin("shifted", "branch-sensitive")),
        ("unstable", (p_value >= CHANCE_P) | (subsample_min < UNSTABLE_SIMILARITY)),
    ]
    return F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in found]), lambda x: x.isNotNull())


def robustness(branch: Column, margin: Column, loso: Column, session: Column, cohort: Column, p_value: Column, subsample_mean: Column) -> Column:
    """Mean of seven terms, each from 0 to 1."""
    clip = lambda x: F.when(x.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), x)))  # noqa: E731  (least and greatest skip nulls)
    branch_term = F.lit(0.5)
    for name, value in BRANCH_SCORE.items():
        branch_term = F.when(branch == name, F.lit(value)).otherwise(branch_term)
    half, zero = F.lit(0.5), F.lit(0.0)
    terms = [
        branch_term, clip((F.coalesce(margin, zero) + 0.2) / 0.4), F.coalesce(loso, zero), F.coalesce(session, half), F.coalesce(cohort, half),
        F.coalesce(clip(1.0 - p_value), half), F.coalesce(clip(subsample_mean), half),
    ]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return total / len(terms)


def tier(n_subjects: Column, n_events: Column, flags: Column, loso: Column, robust: Column, margin: Column) -> Column:
    """Confidence tier; the first rule that holds."""
    return (
        F.when((n_subjects < 2) | (n_events < 2), "insufficient")
        .when(F.array_contains(flags, "unstable") | F.coalesce(loso < UNSTABLE_SUCCESS, F.lit(False)), "unstable")
        .when((F.size(flags) == 0) & (robust >= STRONG_ROBUSTNESS), "strong")
        .when(F.coalesce(margin > MODERATE_MARGIN, F.lit(False)) & (robust >= MODERATE_ROBUSTNESS), "moderate")
        .otherwise("exploratory")
    )


def consensus(n_used: Column, n_positive: Column) -> Column:
    return (
        F.when(n_used == 0, "insufficient").when((n_used >= 2) & (n_positive == n_used), "strong_agreement")
        .when(n_positive > 0, "partial_agreement").otherwise("weak_agreement")
    )


def consensus_score(status: Column) -> Column:
    out = F.lit(None).cast("double")
    for name, value in CONSENSUS_SCORE.items():
        out = F.when(status == name, F.lit(value)).otherwise(out)
    return out


def tier_update(tier_: Column, flags: Column, status: Column, n_used: Column) -> Column:
    """The tier after model evidence; unchanged if no model was used."""
    serious = F.exists(flags, lambda f: f.isin(*SERIOUS))
    lifted = F.when((tier_ == "moderate") & ~serious, "strong").otherwise(tier_)
    lowered = F.when(tier_ == "strong", "moderate").when(tier_ == "moderate", "exploratory").otherwise(tier_)
    return (
        F.when(n_used == 0, tier_).when(status == "strong_agreement", lifted).when(status.isin("weak_agreement", "insufficient"), lowered).otherwise(tier_)
    )


def updated_fragility(robust: Column, status: Column, n_used: Column) -> Column:
    blended = (robust + consensus_score(status)) / 2.0
    return F.when(n_used == 0, 1.0 - robust).otherwise(1.0 - blended)


def model_flags(flags: Column, status: Column, n_used: Column, n_not_positive: Column) -> Column:
    """The flags with those that model evidence adds, sorted."""
    more = F.array(
        F.when((n_used == 0) | (status == "insufficient"), "backbone-insufficient"),
        F.when((n_used > 0) & (status == "weak_agreement"), "backbone-weak"),
        F.when((n_used > 0) & (n_not_positive > 0), "backbone-sensitive"),
    )
    return F.array_sort(F.array_union(flags, F.filter(more, lambda x: x.isNotNull())))
