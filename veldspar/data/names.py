"""A starter set of equivalent names; larger sets load through ``sources.files.name_groups``."""

# Groups of equivalent names, the first of each its canonical form.
GROUPS = [
    ["Mohammed", "Muhammad", "Mohamed", "Muhammed", "Muhammadu", "Mamadou", "Mahamadou", "Mohammadu", "Mohamad", "Mouhamed", "Mahamed", "Mamadu"],
    ["Abdullahi", "Abdullah", "Abdulahi", "Abdoulay", "Abdoulaye", "Abdulai", "Abdallah", "Abdellah", "Abdalla", "Abdoul"],
    ["Ibrahim", "Ibraheem", "Ebrahim", "Brahim", "Ibrahima", "Ibraahim"],
    ["Fatima", "Fatimah", "Fatoumata", "Fatimatou", "Fatouma", "Fatma", "Fadimata", "Fatime", "Fatou", "Fati"],
    ["Aisha", "Ayesha", "Aicha", "Aishat", "Aissata", "Aisatou", "Aysha"],
    ["Usman", "Osman", "Uthman", "Ousmane", "Ousman", "Osmane"],
    ["Yusuf", "Youssef", "Youssouph", "Youssouf", "Yusuph", "Yousuf"],
    ["Amina", "Aminah", "Aminata", "Aminatou"],
    ["Maryam", "Mariam", "Mariama", "Mariame", "Meriem", "Miriam"],
    ["Suleiman", "Sulaiman", "Sulayman", "Souleymane", "Soulaymane"],
    ["Khadija", "Khadijah", "Kadija", "Kadijatou", "Dija", "Hadja"],
    ["Halima", "Halimah", "Halimatou", "Halimata"],
    ["Diallo", "Jallow", "Diaw", "Jalo", "Jalloh"],
    ["Coulibaly", "Kulibali", "Kulibaly", "Coulibali"],
    ["Abubakar", "Aboubacar", "Abubakari", "Abu Bakr", "Abubaker"],
    ["Musa", "Moussa", "Mousa", "Moses"],
    ["Pierre", "Peter", "Petros", "Pedro", "Pita"],
    ["Jean", "John", "Yohana", "Yahya", "Yohannes"],
    ["Marie", "Mary", "Mariya", "Maria", "Maryamu"],
    ["Thandiwe", "Thandeka", "Thandi"],
]

# Probability that a name agrees by chance; jurisdiction -> (any name, address, common names).
PRIORS = {
    "default": (0.01, 0.05, {}),
    "NG": (0.02, 0.06, {"mohammed": 0.08, "muhammad": 0.08, "mohamed": 0.08, "abubakar": 0.05, "ibrahim": 0.05, "abdullahi": 0.04, "musa": 0.04, "usman": 0.03, "adamu": 0.03, "fatima": 0.04, "amina": 0.04, "aisha": 0.03}),
    "GH": (0.02, 0.05, {"kwame": 0.06, "ama": 0.06, "kofi": 0.05, "akua": 0.05, "yaa": 0.04, "kwesi": 0.04, "efua": 0.03, "mohammed": 0.05, "ibrahim": 0.04}),
    "KE": (0.015, 0.05, {"john": 0.04, "james": 0.03, "peter": 0.03, "mary": 0.04, "mohamed": 0.03, "hassan": 0.02, "wanjiku": 0.03}),
    "ZA": (0.012, 0.05, {"john": 0.03, "sipho": 0.03, "thabo": 0.025, "nomsa": 0.02, "lindiwe": 0.02, "mohammed": 0.02}),
    "FR": (0.008, 0.05, {"jean": 0.04, "pierre": 0.03, "marie": 0.05, "mohammed": 0.03, "nicolas": 0.02}),
}
#: field -> (agreement among true matches, agreement by chance)
FIELDS = {"name": (0.92, None), "phone": (0.95, 1e-5), "national_id": (0.999, 1e-6), "email": (0.98, 1e-6), "address": (0.85, None), "dob": (0.95, 0.003), "isbn": (0.999, 1e-6)}
MATCH, REVIEW = 0.85, 0.40
