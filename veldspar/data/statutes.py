"""Data-protection statutes: what to do with a category, how sensitive it is, and why.

Each statute: (jurisdiction, version, default reference), then a line for each category:
category, action, tier, reference. Files of the same shape load through ``sources.files.statutes``.
"""

ACTIONS = ("mask", "tokenize", "drop", "generalize", "audit", "retain")
TIERS = ("high", "moderate", "low")

# Mappings of four statutes.
STATUTES = {
    "NDPA-2023": (("NG", "v1.0", "NDPA-2023 s.30"), """
        PII-1-NAME tokenize moderate NDPA-2023 s.30
        PII-2-NIN mask high NDPA-2023 s.30, NIMC Act s.27
        PII-2-BVN mask high NDPA-2023 s.30, CBN BVN policy 2014
        PII-2-TIN mask moderate NDPA-2023 s.30, FIRS guidelines
        PII-2-PVC mask moderate NDPA-2023 s.30, Electoral Act
        PII-2-RC retain low NDPA-2023 s.31 (legitimate interests)
        PII-2-DRIVERS_LICENCE mask high NDPA-2023 s.30, FRSC guidelines
        PII-3-PHONE tokenize moderate NDPA-2023 s.30
        PII-3-EMAIL tokenize moderate NDPA-2023 s.30
        PII-4-ADDRESS generalize moderate NDPA-2023 s.30
        PII-4-LOCATION retain low NDPA-2023 s.31 (legitimate interests)
        PII-2-DID tokenize moderate NDPA-2023 s.30
        PII-5-BANK_ACCOUNT mask high NDPA-2023 s.30, CBN guidelines
        PII-5-CRYPTO_WALLET mask moderate NDPA-2023 s.30, CBN Circular on Cryptocurrency (Dec 2023)
        PII-5-CARD drop high NDPA-2023 s.30, PCI-DSS
        PII-5-MPESA_REF tokenize moderate NDPA-2023 s.30 (cross-border M-Pesa references)
        PII-6-HEALTH drop high NDPA-2023 s.32 (special category data)
        PII-6-BIOMETRIC drop high NDPA-2023 s.32 (special category data), NIMC Act
        PII-6-RELIGION drop high NDPA-2023 s.32 (special category data)
        PII-6-SEXUAL_ORIENTATION drop high NDPA-2023 s.32 (special category data)
        PII-6-RACE drop high NDPA-2023 s.32 (special category data)
        PII-7-FINGERPRINT_REF drop high NDPA-2023 s.32
        PII-7-FACE_TEMPLATE drop high NDPA-2023 s.32
        PII-8-IP_ADDRESS generalize low NDPA-2023 s.30
        PII-8-DEVICE_ID tokenize moderate NDPA-2023 s.30
        PII-8-COOKIE tokenize low NDPA-2023 s.30
        PII-8-PASSWORD drop high NDPA-2023 s.39 (security obligations)"""),
    "POPIA": (("ZA", "v0.1-scaffold", "POPIA s.11 (lawful processing default)"), """
        PII-1-NAME tokenize moderate POPIA s.11 (lawful processing)
        PII-2-NATIONAL_ID mask high POPIA s.26 (special personal information — biometric)
        PII-2-TAX_REFERENCE mask moderate POPIA s.11, SARS confidentiality
        PII-2-PASSPORT mask high POPIA s.11
        PII-3-PHONE tokenize moderate POPIA s.11
        PII-3-EMAIL tokenize moderate POPIA s.11
        PII-4-ADDRESS generalize moderate POPIA s.11
        PII-4-LOCATION retain low POPIA s.11
        PII-2-DID tokenize moderate POPIA s.11
        PII-5-BANK_ACCOUNT mask high POPIA s.11, FAIS Act
        PII-5-CRYPTO_WALLET mask moderate POPIA s.11, FSCA Crypto Asset Declaration 2022
        PII-6-HEALTH drop high POPIA s.26 (special), s.32 (health data)
        PII-6-BIOMETRIC drop high POPIA s.26 (biometric)
        PII-6-RACE drop high POPIA s.26 (special)
        PII-6-RELIGION drop high POPIA s.26 (special)
        PII-6-SEXUAL_ORIENTATION drop high POPIA s.26 (sex life), s.51 (POPI prohibits unfair discrimination)
        PII-6-POLITICAL_AFFILIATION drop high POPIA s.26
        PII-7-FINGERPRINT_REF drop high POPIA s.26
        PII-7-FACE_TEMPLATE drop high POPIA s.26
        PII-8-IP_ADDRESS generalize low POPIA s.11
        PII-8-PASSWORD drop high POPIA s.19 (security safeguards)"""),
    "KENYA-DPA": (("KE", "v0.1-scaffold", "Kenya DPA s.25"), """
        PII-1-NAME tokenize moderate Kenya DPA s.25 (rights of data subject)
        PII-2-NATIONAL_ID mask high Kenya DPA s.30, Registration of Persons Act
        PII-2-KRA_PIN mask moderate Kenya DPA s.30, KRA Act
        PII-2-NHIF mask moderate Kenya DPA s.30, NHIF Act
        PII-2-PASSPORT mask high Kenya DPA s.30
        PII-3-PHONE tokenize moderate Kenya DPA s.25
        PII-3-EMAIL tokenize moderate Kenya DPA s.25
        PII-4-ADDRESS generalize moderate Kenya DPA s.25
        PII-4-LOCATION retain low Kenya DPA s.25
        PII-2-DID tokenize moderate Kenya DPA s.25
        PII-5-BANK_ACCOUNT mask high Kenya DPA s.30, CBK Prudential Guidelines
        PII-5-CRYPTO_WALLET mask moderate Kenya DPA s.30, CBK Digital Asset Guidance 2024
        PII-5-MPESA_REF tokenize moderate Kenya DPA s.30, CBK NPS Act
        PII-6-HEALTH drop high Kenya DPA s.44 (sensitive personal data)
        PII-6-BIOMETRIC drop high Kenya DPA s.44 (sensitive — biometric)
        PII-6-RELIGION drop high Kenya DPA s.44
        PII-6-SEXUAL_ORIENTATION drop high Kenya DPA s.44
        PII-6-RACE drop high Kenya DPA s.44
        PII-7-FINGERPRINT_REF drop high Kenya DPA s.44
        PII-7-FACE_TEMPLATE drop high Kenya DPA s.44
        PII-8-IP_ADDRESS generalize low Kenya DPA s.25
        PII-8-PASSWORD drop high Kenya DPA s.41 (security safeguards)"""),
    "GHANA-DPA": (("GH", "v0.1-scaffold", "Ghana DPA s.18"), """
        PII-1-NAME tokenize moderate Ghana DPA s.18 (conditions for processing)
        PII-2-GHANA_CARD mask high Ghana DPA s.20, NIA Act
        PII-2-SSNIT mask moderate Ghana DPA s.20, National Pensions Act
        PII-2-TIN mask moderate Ghana DPA s.20, Revenue Administration Act
        PII-3-PHONE tokenize moderate Ghana DPA s.18
        PII-3-EMAIL tokenize moderate Ghana DPA s.18
        PII-4-ADDRESS generalize moderate Ghana DPA s.18
        PII-4-LOCATION retain low Ghana DPA s.18
        PII-2-DID tokenize moderate Ghana DPA s.18
        PII-5-BANK_ACCOUNT mask high Ghana DPA s.20, Bank of Ghana Act
        PII-5-CRYPTO_WALLET mask moderate Ghana DPA s.20, BoG Crypto Asset Caution Notice 2018
        PII-5-MOMO_REF tokenize moderate Ghana DPA s.20, BoG E-Money Issuers Guidelines
        PII-6-HEALTH drop high Ghana DPA s.20 (sensitive personal data)
        PII-6-BIOMETRIC drop high Ghana DPA s.20
        PII-6-RELIGION drop high Ghana DPA s.20
        PII-6-SEXUAL_ORIENTATION drop high Ghana DPA s.20
        PII-6-RACE drop high Ghana DPA s.20
        PII-7-FINGERPRINT_REF drop high Ghana DPA s.20
        PII-7-FACE_TEMPLATE drop high Ghana DPA s.20
        PII-8-IP_ADDRESS generalize low Ghana DPA s.18
        PII-8-PASSWORD drop high Ghana DPA s.28 (security measures)"""),
}
FOR_JURISDICTION = {"NG": "NDPA-2023", "ZA": "POPIA", "KE": "KENYA-DPA", "GH": "GHANA-DPA"}
