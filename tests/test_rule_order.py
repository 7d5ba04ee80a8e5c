"""What wins where several rules of a cascade match: expected rows, written out."""

from pyspark.sql import functions as F

from grainmill.operators import affect, labels, safety

#: Each text matches its own rule and the ones below it in the list that it names.
INTENTS = [
    ("hello there, I passed it, my family", "share_positive_news", "none"),
    ("hello my family", "greeting", "none"),
    ("I passed, please help my family", "share_positive_news", "none"),
    ("please help, my family and my exam", "ask_for_advice", "family_career_expectations"),
    ("please help with my exam and the shaadi", "ask_for_advice", "academic_pressure"),
    ("please help, am I wrong about the loan", "ask_for_advice", "none"),
    ("am I wrong to be gay in this shaadi house", "seek_validation", "none"),
    ("gay and a shaadi is planned for me", "express_identity_conflict", "identity_conflict"),
    ("the shaadi and the loan are planned", "express_marriage_pressure", "marriage_pressure"),
    ("the loan is known to the relatives", "express_financial_stress", "financial_stress"),
    ("relatives talk about the exam all day", "express_social_judgment", "social_judgment"),
    ("the exam is all that my family sees", "express_academic_pressure", "academic_pressure"),
    ("my family makes me so angry today", "express_family_pressure", "family_career_expectations"),
    ("so angry today and that is all", "vent_frustration", "none"),
    ("the long and quiet afternoon walk", "vent_frustration", "none"),
]
#: Emotions are added in this order to those of the intent, four at most.
EMOTIONS = [
    ("my exam: angry, too much, alone, sharam, worried, guilt", "anxiety|fear|guilt|shame"),
    ("angry, too much, alone, sharam, worried, guilt", "frustration|guilt|anxiety|shame"),
    ("angry, too much, alone, sharam of it", "frustration|shame|loneliness|overwhelm"),
    ("angry, too much of all of it here", "frustration|overwhelm|anger"),
    ("my exam is hopeless, there is nothing", "anxiety|fear|inadequacy"),
    ("my exam is hopeless, so alone, too much", "anxiety|fear|loneliness|overwhelm"),
    ("I passed and I am angry and alone", "relief|hope"),
]
RISKS = [
    ("I want to die, and I already took pills", 5, "tier_5"),
    ("I want to die, life is meaningless", 4, "tier_4"),
    ("life is meaningless, they will kill me", 3, "tier_3"),
    ("they will kill me, I think", 2, "tier_2"),
    ("killing it at work, I want to die", 1, "safe"),
]
#: Text, intent, category, urgency; then what is left of the last three, and the corrections.
LABELS = [
    ("I want to die before this exam, I will kill this exam", "academic_pressure", "crisis", 4, ("academic_pressure", "life_stressor", 2), ["category_metaphor_demoted:crisis→life_stressor", "urgency_metaphor_capped:4→2"]),
    ("I want to die", "academic_pressure", "life_stressor", 2, ("suicidal_thoughts", "crisis", 5), ["category_crisis_promoted:'life_stressor'→crisis", "intent_crisis_promoted:'academic_pressure'→suicidal_thoughts", "urgency_crisis_promoted:2→5"]),
    ("plain words", "hopelessness", "crisis", 1, ("hopelessness", "high_distress", 4), ["urgency_crisis_floor:1→4", "category_intent_aligned:'crisis'→'high_distress'"]),
    ("falling apart now", "anxiety_panic", "emotional", 4, ("anxiety_panic", "emotional", 4), ["category_high_urgency_escalated:'emotional'→high_distress", "category_intent_aligned:'high_distress'→'emotional'"]),
]


def test_intents(spark):
    df = spark.createDataFrame([(i, t) for i, (t, *_) in enumerate(INTENTS)], "i int, text string")
    got = [(r["intent"], r["stressor_type"]) for r in affect.detect(df).orderBy("i").collect()]
    # A greeting stands before all; an opener with more than six words is none.
    assert [(t, *g) for (t, *_), g in zip(INTENTS, got, strict=True)] == INTENTS


def test_emotions(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(EMOTIONS)], "i int, text string")
    got = affect.detect(df).orderBy("i").select(F.array_join("emotions_all", "|")).collect()
    assert [(t, r[0]) for (t, _), r in zip(EMOTIONS, got, strict=True)] == EMOTIONS


def test_tiers(spark):
    df = spark.createDataFrame([(i, t) for i, (t, *_) in enumerate(RISKS)], "i int, text string")
    assert [(t, r["risk_level"], r["tier"]) for (t, *_), r in zip(RISKS, safety.assess(df).orderBy("i").collect(), strict=True)] == RISKS


def test_label_rules(spark):
    df = spark.createDataFrame([(i, *r[:4], "en") for i, r in enumerate(LABELS)], "i int, text string, intent string, category string, urgency int, language string")
    got = [((r["intent"], r["category"], r["urgency"]), r["_corrections"]) for r in labels.validate(df).orderBy("i").collect()]
    assert got == [(r[4], r[5]) for r in LABELS]
