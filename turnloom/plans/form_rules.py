"""The rules of the patient, the masters and the visit forms, as trees for ``operators.rules``.

Fixed values: field ids, limits and options are those of the forms.
"""

from __future__ import annotations

TEXTS = {
    "full_name": 200, "preferred_name": 100, "address": 500, "emergency_contact_name": 200, "emergency_contact_relationship": 100, "insurance_provider": 200, "insurance_plan": 200, "insurance_member_id": 50, "insurance_group_number": 50,
    "chief_complaint": 1000, "symptom_duration": 100, "referring_doctor": 200, "referral_reason": 500, "preferred_provider": 200, "conditions_other": 500, "tobacco_frequency": 100, "drug_details": 500, "diet_description": 300,
}
REQUIRED = ("full_name", "dob", "address", "emergency_contact_name", "emergency_contact_relationship", "signature_name")
DATES = ("dob", "last_physical_date", "tobacco_quit_date")
PHONES = ("phone", "emergency_contact_phone", "insurance_phone")
NUMBERS = {"symptom_severity": (1, 10), "alcohol_frequency": (0, 100), "sleep_hours": (0, 24)}
BOOLEANS = ("has_insurance", "self_pay", "allergies_exist", "takes_medications", "takes_supplements", "family_history_unknown")
OPTIONS = {
    "sex_at_birth": ("male", "female", "intersex"),
    "gender_identity": ("man", "woman", "non_binary", "transgender_man", "transgender_woman", "other", "prefer_not_to_say"),
    "pronouns": ("he_him", "she_her", "they_them", "other"),
    "marital_status": ("single", "married", "divorced", "widowed", "domestic_partnership"),
    "visit_reason": ("new_patient_checkup", "specific_concern", "ongoing_condition", "referral", "second_opinion"),
    "preferred_appointment": ("morning", "afternoon", "no_preference"),
    "immunization_status": ("yes", "no", "unsure"),
    "tobacco_use": ("never", "former", "current"),
    "alcohol_use": ("never", "occasionally", "moderately", "heavily"),
    "recreational_drugs": ("never", "former", "current"),
    "exercise_frequency": ("none", "1_2_weekly", "3_4_weekly", "5_plus_weekly", "daily"),
}
LISTS = {
    "conditions": ("diabetes_type1", "diabetes_type2", "hypertension", "heart_disease", "asthma", "copd", "cancer", "arthritis", "depression", "anxiety", "thyroid_disorder", "kidney_disease", "liver_disease", "stroke", "seizure_disorder", "autoimmune_disorder", "none"),
    "tobacco_type": ("cigarettes", "cigars", "pipe", "chewing", "vaping"),
}
EMAIL, DATE = r"^[^\s@]+@[^\s@]+\.[^\s@]+$", r"^\d{4}-\d{2}(-\d{2})?$"

#: Of a field's value, the fields that it makes due.
DUE = (
    ("has_insurance", ("true",), ("insurance_provider", "insurance_plan", "insurance_member_id", "insurance_group_number", "insurance_phone")),
    ("visit_reason", ("specific_concern", "ongoing_condition"), ("chief_complaint", "symptom_duration")),
    ("visit_reason", ("referral",), ("referring_doctor", "referral_reason")),
    ("tobacco_use", ("current",), ("tobacco_type", "tobacco_frequency")),
    ("tobacco_use", ("former",), ("tobacco_quit_date",)),
    ("recreational_drugs", ("former", "current"), ("drug_details",)),
)
#: The same for numbers, of which 0 is an answer, and for lists, of which an empty one is none.
DUE_NUMBERS = (("visit_reason", ("specific_concern", "ongoing_condition"), "symptom_severity"), ("alcohol_use", ("occasionally", "moderately", "heavily"), "alcohol_frequency"))
DUE_LISTS = (("takes_medications", "medications"), ("takes_supplements", "supplements"), ("allergies_exist", "allergies"))

#: Fields of the masters form that another field's yes makes due.
DUE_ON_YES = {
    "gre_taken": ("gre_verbal", "gre_quant", "gre_writing", "gre_date"), "toefl_required": ("english_test_type", "english_test_score", "english_test_date"),
    "prior_application": ("prior_application_year",), "funding_interest": ("funding_type",),
}

FIELDS = {*TEXTS, *REQUIRED, *DATES, *PHONES, *NUMBERS, *BOOLEANS, *OPTIONS, *LISTS, "email", "consent_treatment", "consent_privacy", "consent_billing", "signature_date", "medications", "supplements", "allergies"}
MASTERS_FIELDS = {*DUE_ON_YES, *(f for due in DUE_ON_YES.values() for f in due)}


def value_rules() -> list[tuple]:
    """V9: what is wrong with a value."""
    rules = [(f, "consent", ("not", ("is_true", f))) for f in ("consent_treatment", "consent_privacy")]
    rules.append(("consent_billing", "consent", ("all", ("is_true", "has_insurance"), ("not", ("is_true", "consent_billing")))))
    rules.append(("signature_name", "mismatch", ("all", ("filled", "full_name"), ("filled", "signature_name"), ("not", ("same_text", "signature_name", "full_name")))))
    rules.append(("signature_date", "not_today", ("not", ("is_today", "signature_date"))))
    rules += [(f, "required", ("not", ("filled", f))) for f in REQUIRED]
    rules += [(f, "too_long", ("longer", f, most)) for f, most in TEXTS.items()]
    rules += [(f, "format", ("all", ("filled", f), ("not", ("matches", f, DATE)))) for f in DATES]
    rules.append(("email", "format", ("all", ("filled", "email"), ("not", ("matches", "email", EMAIL)))))
    rules += [(f, "digits", ("all", ("filled", f), ("not", ("digits", f, 10, 15)))) for f in PHONES]
    rules += [(f, "not_a_number", ("all", ("filled", f), ("not", ("is_number", f)))) for f in NUMBERS]
    rules += [(f, "range", ("all", ("is_number", f), ("not", ("between", f, *limits)))) for f, limits in NUMBERS.items()]
    rules += [(f, "option", ("all", ("filled", f), ("not", ("one_of", f, *options)))) for f, options in OPTIONS.items()]
    rules += [(f, "option", ("all", ("listed", f), ("not", ("members_of", f, *options)))) for f, options in LISTS.items()]
    return rules + [(f, "not_a_boolean", ("all", ("given", f), ("not", ("is_boolean", f)))) for f in BOOLEANS]


def due_rules() -> list[tuple]:
    """What is missing, given other answers."""
    rules = [(f, "due", ("all", ("one_of", given, *values), ("not", ("filled", f)))) for given, values, fields in DUE for f in fields]
    rules.append(("self_pay", "due", ("all", ("equals", "has_insurance", "false"), ("not", ("is_true", "self_pay")))))
    rules += [(f, "due", ("all", ("one_of", given, *values), ("not", ("given", f)))) for given, values, f in DUE_NUMBERS]
    return rules + [(f, "due", ("all", ("is_true", given), ("not", ("listed", f)))) for given, f in DUE_LISTS]


def masters_rules() -> list[tuple]:
    """What the masters form requires beyond its catalogue."""
    return [(f, "due", ("all", ("is_true", given), ("not", ("filled", f)))) for given, fields in DUE_ON_YES.items() for f in fields]
