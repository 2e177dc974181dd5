"""Cities and countries. The built-in gazetteer covers capitals and the largest cities; any table of the

same columns can take its place (``sources.files.gazetteer``).
"""

# City, country, country name, region, latitude, longitude, other names.
CITIES = """
Abuja|NG|Nigeria|Federal Capital Territory|9.0579|7.4951|FCT Abuja,FCT,Federal Capital
Lagos|NG|Nigeria|Lagos State|6.5244|3.3792|Eko,Lasgidi,Lagos Island
Kano|NG|Nigeria|Kano State|12.0022|8.5920|
Ibadan|NG|Nigeria|Oyo State|7.3776|3.9470|
Port Harcourt|NG|Nigeria|Rivers State|4.8156|7.0498|PH,Pitakwa,Port-Harcourt
Benin City|NG|Nigeria|Edo State|6.3350|5.6270|Benin,Edo
Kaduna|NG|Nigeria|Kaduna State|10.5105|7.4165|
Enugu|NG|Nigeria|Enugu State|6.4584|7.5464|Coal City
Nairobi|KE|Kenya|Nairobi County|-1.2921|36.8219|Nai,NBO,Green City in the Sun
Mombasa|KE|Kenya|Mombasa County|-4.0435|39.6682|Mvita
Kisumu|KE|Kenya|Kisumu County|-0.1022|34.7617|
Nakuru|KE|Kenya|Nakuru County|-0.3031|36.0800|
Johannesburg|ZA|South Africa|Gauteng|-26.2041|28.0473|Joburg,Jozi,JHB,Egoli
Cape Town|ZA|South Africa|Western Cape|-33.9249|18.4241|Kaapstad,CPT,Mother City
Durban|ZA|South Africa|KwaZulu-Natal|-29.8587|31.0218|eThekwini,DUR
Pretoria|ZA|South Africa|Gauteng|-25.7479|28.2293|Tshwane,Jacaranda City,PTA
Soweto|ZA|South Africa|Gauteng|-26.2227|27.8540|South Western Townships
Accra|GH|Ghana|Greater Accra|5.6037|-0.1870|ACC
Kumasi|GH|Ghana|Ashanti Region|6.6885|-1.6244|Garden City,Asu
Tamale|GH|Ghana|Northern Region|9.4008|-0.8393|
Sekondi-Takoradi|GH|Ghana|Western Region|4.9340|-1.7137|Takoradi,Sekondi
Dar es Salaam|TZ|Tanzania|Dar es Salaam Region|-6.7924|39.2083|Dar,DSM,Bongo
Dodoma|TZ|Tanzania|Dodoma Region|-6.1630|35.7516|
Mwanza|TZ|Tanzania|Mwanza Region|-2.5164|32.9175|
Arusha|TZ|Tanzania|Arusha Region|-3.3869|36.6830|
Kampala|UG|Uganda|Central Region|0.3476|32.5825|KLA
Gulu|UG|Uganda|Northern Region|2.7746|32.2990|
Mbarara|UG|Uganda|Western Region|-0.6117|30.6545|
Kigali|RW|Rwanda|Kigali City|-1.9403|29.8739|KGL
Butare|RW|Rwanda|Southern Province|-2.5967|29.7394|Huye
Gisenyi|RW|Rwanda|Western Province|-1.7027|29.2563|Rubavu
Addis Ababa|ET|Ethiopia|Addis Ababa|9.0192|38.7525|Addis,Finfinne,ADD
Dire Dawa|ET|Ethiopia|Dire Dawa|9.5931|41.8661|
Adama|ET|Ethiopia|Oromia|8.5400|39.2700|Nazret,Nazareth
Hawassa|ET|Ethiopia|Sidama|7.0621|38.4763|Awasa,Awassa
Cairo|EG|Egypt|Cairo Governorate|30.0444|31.2357|Al-Qahira,al-Qāhirah,CAI
Alexandria|EG|Egypt|Alexandria Governorate|31.2001|29.9187|Al-Iskandariyya,Alex
Giza|EG|Egypt|Giza Governorate|30.0131|31.2089|Al Jizah,El Giza
Shubra El Kheima|EG|Egypt|Qalyubia|30.1286|31.2422|Shubra
Casablanca|MA|Morocco|Casablanca-Settat|33.5731|-7.5898|Casa,Dar el Beida,CMN
Rabat|MA|Morocco|Rabat-Sale-Kenitra|34.0209|-6.8416|
Marrakech|MA|Morocco|Marrakech-Safi|31.6295|-7.9811|Marrakesh,RAK
Fes|MA|Morocco|Fes-Meknes|34.0331|-5.0003|Fez,Fas
Abidjan|CI|Cote d'Ivoire|Abidjan|5.3600|-4.0083|Babi,ABJ
Yamoussoukro|CI|Cote d'Ivoire|Yamoussoukro|6.8276|-5.2893|
Bouake|CI|Cote d'Ivoire|Vallee du Bandama|7.6939|-5.0309|Bouaké
Dakar|SN|Senegal|Dakar Region|14.7167|-17.4677|DSS
Thies|SN|Senegal|Thies Region|14.7910|-16.9260|Thiès
Saint-Louis|SN|Senegal|Saint-Louis Region|16.0179|-16.4897|Ndar
Yaounde|CM|Cameroon|Centre Region|3.8480|11.5021|Yaoundé,YAO
Douala|CM|Cameroon|Littoral Region|4.0511|9.7679|DLA
Bamenda|CM|Cameroon|Northwest Region|5.9597|10.1458|
Kinshasa|CD|DR Congo|Kinshasa Province|-4.4419|15.2663|Kin,FIH,Leopoldville
Lubumbashi|CD|DR Congo|Haut-Katanga|-11.6876|27.5026|L'shi
Mbuji-Mayi|CD|DR Congo|Kasai-Oriental|-6.1360|23.5897|
Kisangani|CD|DR Congo|Tshopo|0.5153|25.1950|Boyoma
Luanda|AO|Angola|Luanda Province|-8.8399|13.2894|LAD
Huambo|AO|Angola|Huambo Province|-12.7761|15.7392|Nova Lisboa
Lobito|AO|Angola|Benguela Province|-12.3646|13.5366|
Maputo|MZ|Mozambique|Maputo City|-25.9692|32.5732|MPM,Lourenço Marques
Beira|MZ|Mozambique|Sofala Province|-19.8436|34.8389|
Nampula|MZ|Mozambique|Nampula Province|-15.1165|39.2666|
Harare|ZW|Zimbabwe|Harare Province|-17.8252|31.0335|Salisbury,HRE
Bulawayo|ZW|Zimbabwe|Bulawayo Province|-20.1325|28.6266|BUQ
Mutare|ZW|Zimbabwe|Manicaland|-18.9707|32.6709|Umtali
Lusaka|ZM|Zambia|Lusaka Province|-15.3875|28.3228|LUN
Kitwe|ZM|Zambia|Copperbelt Province|-12.8025|28.2130|
Ndola|ZM|Zambia|Copperbelt Province|-12.9586|28.6366|
Gaborone|BW|Botswana|South-East District|-24.6282|25.9231|Gabs,GBE
Francistown|BW|Botswana|North-East District|-21.1667|27.5000|
Windhoek|NA|Namibia|Khomas Region|-22.5609|17.0658|WDH
Walvis Bay|NA|Namibia|Erongo Region|-22.9576|14.5053|Walvisbaai
Bamako|ML|Mali|Bamako District|12.6392|-8.0029|BKO
Ouagadougou|BF|Burkina Faso|Centre Region|12.3714|-1.5197|Ouaga,OUA
Niamey|NE|Niger|Niamey|13.5127|2.1128|NIM
Conakry|GN|Guinea|Conakry|9.6412|-13.5784|CKY
Lome|TG|Togo|Maritime Region|6.1725|1.2314|Lomé,LFW
Cotonou|BJ|Benin|Littoral Department|6.3703|2.3912|COO
Freetown|SL|Sierra Leone|Western Area|8.4844|-13.2344|FNA
Monrovia|LR|Liberia|Montserrado County|6.3004|-10.7969|ROB
Banjul|GM|Gambia|Banjul|13.4549|-16.5790|Bathurst,BJL
Bissau|GW|Guinea-Bissau|Bissau|11.8636|-15.5977|OXB
Nouakchott|MR|Mauritania|Nouakchott|18.0735|-15.9582|NKC
Praia|CV|Cape Verde|Santiago|14.9330|-23.5133|RAI
Mogadishu|SO|Somalia|Banaadir|2.0469|45.3182|Muqdisho,Xamar,MGQ
Hargeisa|SO|Somalia|Woqooyi Galbeed|9.5600|44.0650|Hargeysa
Djibouti|DJ|Djibouti|Djibouti|11.5880|43.1456|JIB
Asmara|ER|Eritrea|Maekel|15.3229|38.9251|Asmera,ASM
Juba|SS|South Sudan|Central Equatoria|4.8594|31.5713|JUB
Antananarivo|MG|Madagascar|Analamanga|-18.8792|47.5079|Tana,TNR
Brazzaville|CG|Republic of Congo|Brazzaville|-4.2634|15.2429|BZV
Libreville|GA|Gabon|Estuaire|0.4162|9.4673|LBV
Bangui|CF|Central African Republic|Bangui|4.3947|18.5582|BGF
Ndjamena|TD|Chad|Ndjamena|12.1348|15.0557|N'Djamena,NDJ,Fort-Lamy
Malabo|GQ|Equatorial Guinea|Bioko Norte|3.7504|8.7371|SSG
Algiers|DZ|Algeria|Algiers Province|36.7538|3.0588|Alger,El Djazair,ALG
Oran|DZ|Algeria|Oran Province|35.6976|-0.6337|Wahran
Tunis|TN|Tunisia|Tunis Governorate|36.8065|10.1815|TUN
Tripoli|LY|Libya|Tripoli District|32.9022|13.1664|Tarabulus,TIP
Benghazi|LY|Libya|Benghazi District|32.1194|20.0868|Banghazi,BEN
Khartoum|SD|Sudan|Khartoum State|15.5007|32.5599|Al-Khurtum,KRT
Omdurman|SD|Sudan|Khartoum State|15.6361|32.4777|Umm Durman
"""

# Country names in the order they are looked for.
COUNTRIES = {
    "nigeria": "NG", "south africa": "ZA", "kenya": "KE", "ghana": "GH", "ethiopia": "ET", "egypt": "EG", "morocco": "MA",
    "tanzania": "TZ", "uganda": "UG", "rwanda": "RW", "senegal": "SN", "cameroon": "CM", "cote d'ivoire": "CI",
    "ivory coast": "CI", "angola": "AO", "mozambique": "MZ", "zambia": "ZM", "zimbabwe": "ZW", "botswana": "BW",
    "namibia": "NA", "togo": "TG", "benin": "BJ", "burkina faso": "BF", "mali": "ML", "niger": "NE", "chad": "TD",
    "sudan": "SD", "south sudan": "SS", "somalia": "SO", "djibouti": "DJ", "eritrea": "ER",
}

# Words that vote for a country.
VOTES = {
    "NG": ["nigeria", "nigerian", "nimc", "nibss", "inec", "firs", "naira", "lagos", "abuja"],
    "GH": ["ghana", "ghanaian", "nia ghana", "cedi", "accra"],
    "KE": ["kenya", "kenyan", "huduma", "safaricom", "nairobi"],
    "ZA": ["south africa", "south african", "popia", "south african rand", "johannesburg", "cape town"],
    "RW": ["rwanda", "rwandan", "kigali"],
    "TZ": ["tanzania", "tanzanian", "nida", "dar es salaam"],
    "UG": ["uganda", "ugandan", "nira", "kampala"],
    "ET": ["ethiopia", "ethiopian", "kebele", "addis ababa"],
    "SN": ["senegal", "senegalese", "dakar"],
    "CI": ["ivory coast", "cote d'ivoire", "ivorian", "abidjan"],
    "CM": ["cameroon", "cameroonian", "douala", "yaounde"],
    "EG": ["egypt", "egyptian", "cairo"],
    "MA": ["morocco", "moroccan", "rabat", "casablanca"],
}

# Landmark prepositions and kinds.
PREPOSITIONS = ["behind", "near", "opposite", "beside", "next to", "in front of", "across from", "after", "before"]
LANDMARKS = {
    "commercial": ["shop", "mall", "store", "supermarket", "filling station", "gas station", "petrol", "market", "bank", "atm", "hotel", "restaurant", "pharmacy"],
    "religious": ["church", "mosque", "cathedral", "temple", "shrine", "chapel", "parish"],
    "infrastructure": ["junction", "roundabout", "bridge", "park", "stadium", "hospital", "school", "university", "airport", "station", "terminal"],
}
STREETS = ["Avenue", "Street", "Road", "Drive", "Crescent", "Boulevard", "Lane", "Highway", "Close", "Way", "Court", "Square", "Ave", "St", "Rd", "Dr", "Blvd", "Ln", "Hwy", "Cl", "Sq"]
POSTCODES = {"ZA": r"\b[0-9]{4}\b", "NG": r"\b[0-9]{6}\b", "KE": r"\b[0-9]{5}\b", "GH": r"\b[A-Z]{2}-[0-9]{3}-[0-9]{4}\b", "GB": r"\b[A-Z]{1,2}[0-9][A-Z0-9]?\s*[0-9][A-Z]{2}\b"}
OUTWARD_GB = r"\b[A-Z]{1,2}[0-9][A-Z0-9]?\b(?!\s*[0-9][A-Z]{2})"


def cities() -> list[tuple[str, str, str, str, float, float, list[str]]]:
    out = []
    for line in CITIES.strip().splitlines():
        name, code, country, region, lat, lng, others = line.split("|")
        out.append((name, code, country, region, float(lat), float(lng), [o for o in others.split(",") if o]))
    return out
