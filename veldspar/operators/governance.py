"""Compliance assessment of a document's findings: sensitivity, actions, counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Sensitivity of labels.
SENSITIVITY = {
    "high": "nin bvn national_id ghana_card sa_id kenya_id aadhaar ssn passport_number biometric health_data",
    "medium": "phone_number phone email date_of_birth address street_address account_number bank_account tin pvc",
    "low": "person first_name last_name full_name gender occupation location city",
}
LAW, CROSS_BORDER = "General data protection principles", "Assess adequacy before transfer"


def sensitivity_sql(label: str, default: str = "null") -> str:
    cases = " ".join(f"when {label} in ({', '.join(repr(w) for w in words.split())}) then '{level}'" for level, words in SENSITIVITY.items())
    return f"case {cases} else {default} end"


def masked_sql(text: str) -> str:
    """First three characters and a star for each other one; short texts are three stars."""
    return f"if(char_length({text}) <= 4, '***', rpad(left({text}, 3), char_length({text}), '*'))"


def findings(evidence: DataFrame, pii: DataFrame | None = None, consent: bool = False) -> DataFrame:
    """Findings of evidence (doc_id, label, text) of sensitive labels, and of detections (doc_id, pii_type, text) not among them."""
    own = evidence.select("doc_id", F.lower("label").alias("pii_type"), F.expr(masked_sql("text")).alias("text_masked")).withColumn("sensitivity", F.expr(sensitivity_sql("pii_type"))).where("sensitivity is not null")
    act = "case sensitivity when 'high' then '%s' when 'medium' then 'flag_for_review' else '%s' end"
    own = own.withColumn("recommended_action", F.expr(act % ("encrypt" if consent else "redact", "ok")))
    if pii is None:
        return own
    other = pii.select("doc_id", F.lower("pii_type").alias("pii_type"), F.expr(masked_sql("text")).alias("text_masked")).distinct()
    other = other.join(own.select("doc_id", "pii_type", "text_masked").distinct(), ["doc_id", "pii_type", "text_masked"], "left_anti").withColumn("sensitivity", F.expr(sensitivity_sql("pii_type", "'medium'")))
    return own.unionByName(other.withColumn("recommended_action", F.expr(act % ("encrypt", "flag_for_review"))))


def assess(found: DataFrame, consent: bool = False, law: str = LAW, cross_border: str = CROSS_BORDER) -> DataFrame:
    """One report a document: counts by sensitivity, impact assessment from three high ones on, what is to be done."""
    n = lambda level: F.count_if(F.col("sensitivity") == level).alias(level)
    out = found.groupBy("doc_id").agg(F.count("*").alias("total"), n("high"), n("medium"), n("low"), F.count_if((F.col("sensitivity") == "high") & (F.col("recommended_action") == "redact")).alias("_redact"))
    actions = f"""filter(array(
        if(high > 0 and not {str(consent).lower()}, concat('Obtain explicit consent: ', high, ' high-sensitivity PII item(s) detected'), null),
        if(high >= 3, 'Conduct Data Protection Impact Assessment (DPIA): large-scale high-sensitivity processing', null),
        if(_redact > 0, 'Redact or encrypt high-sensitivity PII before storage/transfer', null),
        if(high > 0, 'Cross-border transfer restriction: {cross_border}', null)), a -> a is not null)"""
    status = "'obtained'" if consent else "if(high > 0, 'required', 'not_applicable')"
    return out.select("doc_id", F.lit(law).alias("law_name"), "total", "high", "medium", "low", F.expr("high >= 3").alias("dpia_required"), F.expr(status).alias("consent_status"), F.expr(actions).alias("required_actions"))
