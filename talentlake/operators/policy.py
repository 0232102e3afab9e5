"""Skill policy, acceptance of parsed records, and their normalisation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from talentlake.functions.skills import any_of, looks_soft
from talentlake.functions.text import folded_words, value

POLICY_VERSION = "real_cv_skills_v3_2026-10-07"
ALLOWED_SOFT = ("communication",)
# Fixed values of decisions.
WARN_OVERLAP = "A skill was both hard and soft; it is kept as a soft skill only."
WARN_SOFT = "A soft skill outside the training allowlist was accepted; the record and its evidence are valid."


def policy_message(hard: list[str], soft: list[str]) -> str | None:
    """What breaks the skill policy, over normalised keys, or None."""
    both, odd = sorted({*hard} & {*soft}), sorted({*soft} - {*ALLOWED_SOFT})
    found = [f"hard_soft_overlap={both}" if both else "", f"disallowed_soft_skills={odd}" if odd else "", "communication_is_hard" if "communication" in hard else ""]
    return "; ".join(m for m in found if m) or None


def shown_text(x: Column) -> Column:
    """A text as a message quotes it: in single quotes or, if it has some and no double ones, in double quotes."""
    plain = F.replace(x, F.lit("\\"), F.lit("\\\\"))
    other = F.contains(x, F.lit("'")) & ~F.contains(x, F.lit('"'))
    return F.when(other, F.concat(F.lit('"'), plain, F.lit('"'))).otherwise(F.concat(F.lit("'"), F.replace(plain, F.lit("'"), F.lit("\\'")), F.lit("'")))


def _shown(items: Column) -> Column:
    """A list of texts as a message shows it."""
    return F.concat(F.lit("["), F.array_join(F.transform(items, shown_text), ", "), F.lit("]"))


def skill_policy(hard: Column, soft: Column) -> Column:
    """struct(overlap, disallowed, communication_in_hard, message); message is null if the policy holds."""
    h, s = F.transform(hard, value), F.transform(soft, value)
    overlap = F.array_sort(F.array_intersect(h, s))
    disallowed = F.array_sort(F.array_except(s, F.array(*[F.lit(x) for x in ALLOWED_SOFT])))
    in_hard = F.array_contains(h, "communication")
    parts = F.array_compact(F.array(
        F.when(F.size(overlap) > 0, F.concat(F.lit("hard_soft_overlap="), _shown(overlap))),
        F.when(F.size(disallowed) > 0, F.concat(F.lit("disallowed_soft_skills="), _shown(disallowed))),
        F.when(in_hard, F.lit("communication_is_hard")),
    ))
    return F.struct(overlap.alias("overlap"), disallowed.alias("disallowed"), in_hard.alias("communication_in_hard"), F.when(F.size(parts) > 0, F.array_join(parts, "; ")).alias("message"))


def soft_overlaps(hard: Column, soft: Column) -> Column:
    """Hard skills that are soft skills too, by key, the last spelling of each; null if one of them doesn't look soft."""
    keys = F.array_sort(F.array_intersect(F.transform(hard, folded_words), F.transform(soft, folded_words)))
    last = F.transform(keys, lambda k: F.element_at(F.filter(hard, lambda h: folded_words(h) == k), -1))
    return F.when(F.forall(last, looks_soft), last)


def decide(structurally_valid: Column, status: Column, issues: Column, hard: Column, soft: Column) -> Column:
    """The acceptance decision on a parse result; issues: array of structs with code and message."""
    overlaps = soft_overlaps(hard, soft)
    may_overlap = F.coalesce(F.size(overlaps) > 0, F.lit(False))

    def known(*starts: str) -> Column:
        """Whether all issues are skill messages whose parts begin in one of these ways."""

        def allowed(i: Column) -> Column:
            parts = F.filter(F.transform(F.split(i["message"], ";"), lambda p: F.trim(p)), lambda p: p != "")
            return (i["code"] == "skill_policy") & (F.size(parts) > 0) & F.forall(parts, lambda p: any_of(p.startswith(x) for x in starts))

        return (F.size(issues) > 0) & F.forall(issues, lambda i: F.coalesce(allowed(i), F.lit(False)))

    strict = (status == "success") & (F.size(issues) == 0)
    soft_only, with_overlap = known("disallowed_soft_skills="), known("disallowed_soft_skills=", "hard_soft_overlap=")
    mode = F.when(~structurally_valid, "rejected").when(strict, "parser_v1_strict").when(may_overlap & with_overlap, "real_cv_skills_normalized").when(~may_overlap & soft_only, "real_cv_soft_skills_expanded").otherwise("rejected")
    none = F.array().cast("array<string>")
    return F.transform(F.array(mode), lambda m: F.struct(
        (m != "rejected").alias("accepted"),
        m.alias("mode"),
        F.lit(POLICY_VERSION).alias("policy_version"),
        F.when(m == "real_cv_skills_normalized", F.array(F.lit(WARN_OVERLAP), F.lit(WARN_SOFT))).when(m == "real_cv_soft_skills_expanded", F.array(F.lit(WARN_SOFT))).otherwise(none).alias("warnings"),
        F.when(~structurally_valid, "pointer_span_or_cvschema_invalid").when(m == "rejected", "non_legacy_policy_or_other_parser_issue").alias("rejection_reason"),
        F.when(m == "real_cv_skills_normalized", F.transform(overlaps, lambda x: F.concat(F.lit("removed_from_hard_skills:"), folded_words(x)))).otherwise(none).alias("normalizations"),
    ))[0]


def normalized_hard(hard: Column, soft: Column, mode: Column) -> Column:
    """Hard skills of an accepted record; where overlaps were repaired, without soft-looking ones that are soft skills too."""
    keys = F.transform(soft, folded_words)
    kept = F.filter(hard, lambda h: ~(F.array_contains(keys, folded_words(h)) & looks_soft(h)))
    return F.when(mode == "real_cv_skills_normalized", kept).otherwise(hard)


def normalized_cv(cv: Column, decision: Column) -> Column:
    """The record that goes on after a decision; null unless accepted."""
    skills = cv["skills"].withField("hard_skills", normalized_hard(cv["skills"]["hard_skills"], cv["skills"]["soft_skills"], decision["mode"]))
    return F.when(decision["accepted"], cv.withField("skills", skills))
