"""Label vocabularies. Everything in this file is a fixed value: names, orders and numbers that results depend on."""

from __future__ import annotations

# Fixed values, in index order: intent, category, least and greatest urgency, usual language, wanted records.
INTENT_TABLE = [
    ("venting_distress", "emotional", 2, 3, "hi-en-mix", 500),
    ("anxiety_panic", "emotional", 2, 4, "hi-en-mix", 500),
    ("sadness_low_mood", "emotional", 2, 3, "hi-en-mix", 500),
    ("overwhelm_burnout", "high_distress", 3, 4, "en", 400),
    ("loneliness", "emotional", 2, 3, "hi-en-mix", 400),
    ("career_job_stress", "life_stressor", 2, 3, "en", 500),
    ("academic_pressure", "life_stressor", 2, 3, "hi-en-mix", 500),
    ("financial_stress", "life_stressor", 2, 4, "hi-en-mix", 400),
    ("family_conflict", "social_stress", 2, 3, "hi-en-mix", 400),
    ("relationship_issue", "social_stress", 2, 3, "en", 400),
    ("marriage_pressure", "social_stress", 2, 3, "hi-en-mix", 400),
    ("social_reputation", "social_stress", 2, 3, "hi-en-mix", 300),
    ("conflict_exposure", "social_stress", 2, 3, "hi-en-mix", 300),
    ("fear_of_consequence", "social_stress", 2, 3, "en", 300),
    ("advice_seeking", "problem_solving", 1, 2, "en", 400),
    ("decision_conflict", "problem_solving", 1, 2, "en", 400),
    ("planning_next_steps", "problem_solving", 1, 2, "en", 300),
    ("sleep_issue", "behavioral", 2, 3, "en", 300),
    ("focus_issue", "behavioral", 2, 3, "en", 300),
    ("productivity_block", "behavioral", 2, 3, "hi-en-mix", 300),
    ("hopelessness", "high_distress", 3, 4, "hi-en-mix", 400),
    ("emotional_exhaustion", "high_distress", 3, 4, "en", 400),
    ("self_harm_intent", "crisis", 4, 5, "en", 200),
    ("suicidal_thoughts", "crisis", 5, 5, "en", 200),
    ("greeting", "neutral", 1, 1, "hi-en-mix", 200),
    ("casual_chat", "neutral", 1, 1, "en", 200),
]
INTENTS = [row[0] for row in INTENT_TABLE]
INTENT_CATEGORY = {row[0]: row[1] for row in INTENT_TABLE}
TARGETS = {row[0]: row[5] for row in INTENT_TABLE}

# Fixed values, in index order.
CATEGORIES = ["emotional", "life_stressor", "social_stress", "problem_solving", "behavioral", "high_distress", "crisis", "neutral"]
LANGUAGES = ["hi-en-mix", "en", "hi", "bn", "bn-en-mix"]

# Fixed values of the seed set: its own intents with wanted numbers, emotions, stressors, columns.
SEED_TARGETS = {
    "express_family_pressure": 500, "express_academic_pressure": 500, "express_social_judgment": 400, "express_marriage_pressure": 400,
    "express_identity_conflict": 300, "express_financial_stress": 300, "seek_validation": 400, "vent_frustration": 400,
    "ask_for_advice": 300, "share_positive_news": 200, "crisis_signal": 300, "unclear": 200,
}
SEED_INTENTS = list(SEED_TARGETS)
SEED_EMOTIONS = ["conflict", "guilt", "anxiety", "shame", "anger", "grief", "loneliness", "fear", "inadequacy", "identity_confusion", "relief", "hope", "neutral", "overwhelm", "resentment", "helplessness", "love", "frustration", "confusion", "sadness"]
SEED_STRESSORS = {
    "express_family_pressure": "family_career_expectations", "express_academic_pressure": "academic_pressure", "express_social_judgment": "social_judgment",
    "express_marriage_pressure": "marriage_pressure", "express_identity_conflict": "identity_conflict", "express_financial_stress": "financial_stress",
}
SEED_COLUMNS = ["id", "text", "language", "script", "intent", "emotions", "urgency_level", "stressor_type", "cultural_markers_present", "contains_code_mix", "annotator_id", "annotator_confidence", "second_annotator_id", "agreed", "source", "split"]

# Technique by (intent, first emotion).
TECHNIQUES = {
    ("express_family_pressure", "conflict"): "reflective_questioning",
    ("express_family_pressure", "guilt"): "self_compassion",
    ("express_family_pressure", "anxiety"): "cognitive_reframe",
    ("express_academic_pressure", "anxiety"): "decatastrophising",
    ("express_academic_pressure", "shame"): "self_compassion",
    ("express_academic_pressure", "inadequacy"): "values_clarification",
    ("express_social_judgment", "shame"): "cognitive_reframe",
    ("express_marriage_pressure", "conflict"): "reflective_questioning",
    ("express_identity_conflict", "fear"): "emotional_validation",
    ("express_identity_conflict", "shame"): "self_compassion",
    ("express_identity_conflict", "loneliness"): "emotional_validation",
    ("express_financial_stress", "anxiety"): "problem_solving_orientation",
    ("express_financial_stress", "overwhelm"): "emotional_validation",
    ("seek_validation", "confusion"): "reflective_questioning",
    ("vent_frustration", "frustration"): "emotional_validation",
    ("vent_frustration", "anger"): "emotional_validation",
    ("ask_for_advice", "confusion"): "pros_cons_exploration",
    ("crisis_signal", "grief"): "grounding",
    ("crisis_signal", "helplessness"): "grounding",
    ("share_positive_news", "relief"): "reflective_questioning",
    ("greeting", "neutral"): "reflective_questioning",
}
OTHER_TECHNIQUE = "emotional_validation"

# Base emotions by intent; tone by intent.
BASE_EMOTIONS = {
    "share_positive_news": ["relief", "hope"],
    "express_family_pressure": ["conflict", "guilt"],
    "express_academic_pressure": ["anxiety", "fear"],
    "express_identity_conflict": ["fear", "loneliness", "conflict"],
    "express_marriage_pressure": ["conflict", "anxiety"],
    "express_social_judgment": ["shame", "anxiety"],
    "express_financial_stress": ["anxiety", "overwhelm"],
    "vent_frustration": ["frustration"],
    "seek_validation": ["confusion", "anxiety"],
    "ask_for_advice": ["confusion", "anxiety"],
    "greeting": ["neutral"],
}
TONES = {"share_positive_news": "celebratory", "ask_for_advice": "direct_supportive", "express_identity_conflict": "gentle_reframe", "express_marriage_pressure": "gentle_reframe", "express_financial_stress": "direct_supportive"}
OTHER_TONE = "indirect_validating"

# What of a knowledge base goes into a risk scorer's prompt.
RISK_STRESSORS = ["marriage_pressure", "identity_conflict", "intergenerational_conflict"]
RISK_EMOTIONS = ["helplessness", "identity_confusion"]
RISK_IDIOMS = ["log_kya_kahenge", "ghar_ki_izzat"]

# Intents of the social mode, and emotions of the emotional one.
SOCIAL_INTENTS = ["family_conflict", "relationship_issue", "social_stress", "express_family_pressure", "family_career_expectations", "peer_pressure", "friendship_conflict", "romantic_conflict"]
TENDER_EMOTIONS = ["sad", "anxious", "grief", "fear", "hopeless", "overwhelm", "guilt", "shame"]

# Helplines by key.
HELPLINES = {
    "tier_5": ("Vandrevala Foundation", "1860-2662-345", "24/7"),
    "tier_4": ("iCall", "9152987821", "Mon–Sat 8am–10pm"),
    "tier_3": ("iCall", "9152987821", "Mon–Sat 8am–10pm"),
    "tier_2_minor": ("CHILDLINE", "1098", "24/7"),
    "tier_2_adult": ("iCall", "9152987821", "Mon–Sat 8am–10pm"),
}
