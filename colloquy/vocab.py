"""Controlled vocabularies and thresholds of the comment docket.

Every vocabulary is a short closed list whose *order matters*: published maps
follow it and ties are broken by it.  Helpers below turn a vocabulary into
Spark expressions, so that checking or labelling a value never needs a join.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# --- Fixed values -----------------------------------------------------------
# The ids, labels, slugs, ranges and thresholds below are data: published
# results contain them, so they are stated literally and in published order.


class Theme(NamedTuple):
    id: str
    label: str
    question_range: str
    slug: str
    first_question: int
    last_question: int


THEMES = [
    Theme("risk", "Risk Assessment", "Q1–Q6", "risk", 1, 6),
    Theme("premarket", "Premarket Evaluation", "Q7–Q17", "premarket", 7, 17),
    Theme("postmarket", "Postmarket Monitoring & Change", "Q18–Q24", "postmarket", 18, 24),
    Theme("foundation_models_agents", "Foundation Models & Agentic AI", "Q25–Q26", "foundation", 25, 26),
]

# id -> (label, slug)
STAKEHOLDER_TYPES = {
    "device_manufacturer": ("Manufacturers", "manufacturers"),
    "health_system_provider": ("Health Systems", "health-systems"),
    "clinician_professional_society": ("Professional Societies", "professional-societies"),
    "foundation_model_ai_platform": ("AI Companies", "ai-companies"),
    "trade_association": ("Trade Associations", "trade-associations"),
    "academic_research": ("Researchers", "researchers"),
    "patient_consumer_group": ("Patient Groups", "patient-groups"),
    "investor_vc": ("Investors", "investors"),
    "individual": ("Individuals", "individuals"),
    "other": ("Other", "other"),
}

# id -> (label, slug)
STANCES = {
    "support": ("Support", "support"),
    "support_with_modification": ("Support with modification", "modify"),
    "oppose": ("Oppose", "oppose"),
    "mixed": ("Mixed", "mixed"),
    "unclear": ("Unclear", "unclear"),
}

ISSUES = {
    "regulatory_scope": "Regulatory scope",
    "risk_classification": "Risk classification",
    "intended_use": "Intended use",
    "directiveness": "Directiveness",
    "human_factors": "Human factors",
    "evidence_standards": "Evidence standards",
    "benchmarking": "Benchmarking",
    "clinical_validation": "Clinical validation",
    "statistical_methods": "Statistical methods",
    "synthetic_data": "Synthetic data",
    "comparator_standard_of_care": "Comparator / standard of care",
    "postmarket_monitoring": "Postmarket monitoring",
    "change_control": "Change control",
    "pccp": "PCCP",
    "foundation_model_dependency": "Foundation model dependency",
    "supplier_controls": "Supplier controls",
    "cybersecurity": "Cybersecurity",
    "agentic_autonomy": "Agentic autonomy",
    "health_system_implementation": "Health system implementation",
    "economics_burden": "Economics / burden",
    "accountability_liability": "Accountability / liability",
}

GAPS = {
    "dynamic_intended_use": "Dynamic intended use / behavioral envelope",
    "human_ai_system_performance": "Human-AI system performance",
    "deployment_assurance_scalability": "Deployment assurance & scalability",
    "operational_harm": "Operational harm",
    "evidence_burden_commercial_viability": "Evidence burden & commercial viability",
    "ai_supplier_quality": "AI supplier quality",
    "cybersecurity_as_safety": "Cybersecurity as clinical safety",
    "distributed_accountability": "Distributed accountability",
    "delegated_authority": "Delegated authority",
}

RESPONSE_TYPES = {
    "direct_answer": "Direct answer",
    "recommendation": "Recommendation",
    "concern": "Concern",
    "proposed_criterion": "Proposed criterion",
    "evidence_suggestion": "Evidence suggestion",
    "scope_challenge": "Scope challenge",
    "implementation_issue": "Implementation issue",
    "no_clear_answer": "No clear answer",
}

DISAGREEMENT_TOPICS = {
    "thresholds": "Thresholds",
    "scope": "Scope",
    "evidence_burden": "Evidence burden",
    "ownership": "Ownership",
    "implementation": "Implementation",
    "definitions": "Definitions",
    "timing": "Timing",
    "degree_of_autonomy": "Degree of autonomy",
}

CONFIDENCE = ["high", "medium", "low"]

MIN_COMMENTERS_FOR_CONCLUSION = 5
MIN_COMMENTERS_FOR_TENSION = 3
MIN_GROUPS_FOR_TENSION = 2
MIN_COMMENTERS_PER_SIDE = 2

MIN_SUBSTANTIVE_CHARS = 200
CHUNK_CHARS = 24_000
CHUNK_OVERLAP_CHARS = 1_500
SUMMARY_MAX_WORDS = 45
CLAIM_MAX_WORDS = 60
PUBLISHED_CLAIM_MAX_WORDS = 66
MIN_PASSAGE_CHARS = 40
MAX_GAP_TAGS = 3
MAX_EVIDENCE = 5
MIN_EVIDENCE = 3
SIGNAL_COUNT = 3
SEARCH_MAX_CHARS = 120

POINTER_PHRASES = ["see attached", "please see attached", "see attachment", "attached please find"]
BANNED_PHRASES = [
    "this is important",
    "broadly agree",
    "broad agreement",
    "industry consensus",
    "stakeholders agree",
]
UNGROUNDED_TERMS = ["commercialization", "deployment", "market", "buyer", "capital"]
FORBIDDEN_FIELDS = [
    "verified",
    "review_status",
    "reviewer",
    "reviewer_notes",
    "human_verified",
    "ai_classified",
    "verification_count",
    "review_queue",
]
SIGNAL_ORDER = ["most_discussed", "pattern", "commercialization", "deployment", "blind_spot"]
# --- End of fixed values ----------------------------------------------------

N_QUESTIONS = THEMES[-1].last_question
QUESTION_IDS = [f"q{n}" for n in range(1, N_QUESTIONS + 1)]


def quoted(value: str) -> str:
    """A SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def sql_array(values) -> str:
    return "array(" + ", ".join(quoted(v) for v in values) + ")"


def sql_map(mapping: dict) -> str:
    """SQL literal map ``id -> label`` of a vocabulary."""
    flat = [quoted(x) for k, v in mapping.items() for x in (k, v if isinstance(v, str) else v[0])]
    return "map(" + ", ".join(flat) + ")"


def literal_array(values) -> Column:
    return F.expr(sql_array(values))


def literal_map(mapping: dict) -> Column:
    """Literal ``id -> label`` map, for labelling without a join."""
    return F.expr(sql_map(mapping))


def label(vocabulary: dict, column: Column) -> Column:
    """Label of ``column`` in the vocabulary, null when the id is unknown."""
    return F.try_element_at(literal_map(vocabulary), column)


def ordinal(values, column: Column) -> Column:
    """1-based place of ``column`` in the vocabulary, null when unknown."""
    return F.nullif(F.array_position(literal_array(values), column), F.lit(0))


def is_known(values, column: Column) -> Column:
    return F.coalesce(F.array_contains(literal_array(values), column), F.lit(False))


def question_number(question_id: Column) -> Column:
    """Numeric part of a question id (``q12`` -> 12); 0 when there is none."""
    digits = F.nullif(F.regexp_replace(question_id, r"\D", ""), F.lit(""))
    return F.coalesce(digits.cast("int"), F.lit(0))


def is_question_id(question_id: Column) -> Column:
    return is_known(QUESTION_IDS, question_id)


def sql_theme_of(number: str) -> str:
    """Theme id for a question number; numbers past the list fall in the last theme."""
    whens = " ".join(f"WHEN {number} <= {t.last_question} THEN {quoted(t.id)}" for t in THEMES[:-1])
    return f"CASE {whens} ELSE {quoted(THEMES[-1].id)} END"


# Sets of questions travel through aggregations as a 26-bit mask: ``bit_or`` is
# a constant-size, map-side-combinable union, whatever the size of the group.
_BITS = "map(" + ", ".join(f"'{q}', {1 << i}L" for i, q in enumerate(QUESTION_IDS)) + ")"


def once(value: Column, use) -> Column:
    """``use(value)`` with the value computed a single time.

    Inside a lambda Spark evaluates an outer expression again for every element,
    and common-subexpression elimination does not reach there."""
    return F.element_at(F.transform(F.array(value), use), 1)


def question_mask(question_ids: Column) -> Column:
    return F.aggregate(
        question_ids,
        F.lit(0).cast("bigint"),
        lambda acc, q: acc.bitwiseOR(F.coalesce(F.try_element_at(F.expr(_BITS), q), F.lit(0).cast("bigint"))),
    )


def mask_questions(mask: Column) -> Column:
    """Question ids of a mask, in numeric order."""
    def members(bits):
        held = F.filter(F.sequence(F.lit(1), F.lit(N_QUESTIONS)), lambda n: F.getbit(bits, n - 1) == 1)
        return F.transform(held, lambda n: F.concat(F.lit("q"), n.cast("string")))

    return once(mask, members)


def questions_frame(spark: SparkSession) -> DataFrame:
    """The question dimension (26 rows): question_id, question_number, theme."""
    return spark.range(1, N_QUESTIONS + 1).selectExpr(
        "concat('q', id) AS question_id", "cast(id AS int) AS question_number", f"{sql_theme_of('id')} AS theme"
    )
