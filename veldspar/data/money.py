"""Currencies: code -> (name, symbols before an amount, symbols after it, words after it).

A symbol or word that several currencies use belongs to the first.
"""

# Currency marks.
CURRENCIES = {
    "NGN": ("Nigerian Naira", ["₦", "N", "NGN"], [], ["naira"]),
    "KES": ("Kenyan Shilling", ["KSh", "Ksh", "KES"], [], ["kenyan shilling", "kenyan shillings", "ksh"]),
    "ZAR": ("South African Rand", ["ZAR", "R"], [], ["rand", "rands"]),
    "GHS": ("Ghanaian Cedi", ["GH₵", "GH¢", "GHS", "GHC"], [], ["cedi", "cedis", "ghana cedi", "ghana cedis"]),
    "XOF": ("CFA Franc (West African)", ["FCFA", "CFA", "XOF", "F CFA"], [], ["cfa", "cfa franc", "fcfa", "franc cfa"]),
    "XAF": ("CFA Franc (Central African)", ["XAF"], [], []),
    "TZS": ("Tanzanian Shilling", ["TSh", "TZS"], [], ["tanzanian shilling", "tanzanian shillings", "tsh"]),
    "UGX": ("Ugandan Shilling", ["USh", "UGX"], [], ["ugandan shilling", "ugandan shillings", "ush"]),
    "RWF": ("Rwandan Franc", ["FRw", "RWF", "RF"], [], ["rwandan franc", "rwandan francs", "frw"]),
    "ETB": ("Ethiopian Birr", ["Br", "ETB"], [], ["birr", "ethiopian birr"]),
    "EGP": ("Egyptian Pound", ["E£", "EGP", "LE", "L.E."], [], ["egyptian pound", "egyptian pounds", "guineh"]),
    "MAD": ("Moroccan Dirham", ["MAD"], ["DH", "Dhs", "MAD"], ["dirham", "dirhams", "moroccan dirham"]),
    "DZD": ("Algerian Dinar", ["DZD"], ["DA", "DZD"], ["algerian dinar", "dinars"]),
    "TND": ("Tunisian Dinar", ["TND"], ["DT", "TND"], ["tunisian dinar"]),
    "CDF": ("Congolese Franc", ["CDF", "FC"], [], ["congolese franc", "congolese francs", "franc congolais"]),
    "AOA": ("Angolan Kwanza", ["AOA", "Kz"], [], ["kwanza", "kwanzas"]),
    "MZN": ("Mozambican Metical", ["MZN"], ["MT", "MZN"], ["metical", "meticais"]),
    "ZMW": ("Zambian Kwacha", ["ZMW", "ZK"], [], ["kwacha", "zambian kwacha"]),
    "BWP": ("Botswana Pula", ["BWP"], [], ["pula", "botswana pula"]),
    "SDG": ("Sudanese Pound", ["SDG"], [], ["sudanese pound", "sudanese pounds"]),
    "SOS": ("Somali Shilling", ["SOS", "Sh.So."], [], ["somali shilling", "somali shillings"]),
}
AMOUNT = r"[0-9]{1,3}(?:[,.\s][0-9]{3})*(?:[.,][0-9]{1,2})?"
STANDARD = r"(?i)(?:[$€£])\s?[0-9][0-9,]*(?:\.[0-9]{1,2})?|[0-9][0-9,]*(?:\.[0-9]{1,2})?\s?(?:USD|EUR|GBP|dollars?|euros?|pounds?)\b"
