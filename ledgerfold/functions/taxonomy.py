"""The category tree of notices: codes to categories, divisions to sectors, older wordings, labels and keywords."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The tables below must be exactly these for the same labels.

#: The sector that has types of its own, and the value of codes that say nothing.
TYPED, SILENT = {"construction": ["roads_bridges", "buildings_civil", "water_sanitation"]}, "silent"

#: Category of the longest prefix of a code; None leaves the type open.
PREFIXES: dict[str, str | None] = {
    "03": "agriculture_environment",
    "091": "vehicles_transport", "093": "electrical_power",
    "142": "buildings_civil",
    "15": "food_catering",
    "16": "agriculture_environment",
    "18": "textiles_uniforms", "185": SILENT,
    "19": "textiles_uniforms", "195": SILENT, "196": SILENT, "197": SILENT,
    "22": "printing_media",
    "244": "agriculture_environment",
    "30": "office_supplies", "3012": "it_equipment", "302": "it_equipment",
    "31": "electrical_power",
    "32": "it_equipment",
    "33": "medical", "337": SILENT, "3373": "medical",
    "34": "vehicles_transport",
    "35": "security_cleaning_services", "354": "vehicles_transport", "358": "textiles_uniforms",
    "37": None,
    "38": None, "3843": "medical", "3851": "medical",
    "39": None, "391": "furniture", "3919": "buildings_civil", "3931": "food_catering", "395": "textiles_uniforms", "397": "electrical_power", "398": "security_cleaning_services",
    "41": "water_sanitation",
    "42": None, "4211": "electrical_power", "4212": "water_sanitation", "4213": "water_sanitation", "425": "electrical_power",
    "43": None,
    "44": "buildings_civil", "44113": "roads_bridges", "4413": "water_sanitation", "4416": "water_sanitation", "443": "electrical_power", "4461": "water_sanitation",
    "45": None, "4521": "buildings_civil", "45221": "roads_bridges", "45231": None, "452313": "water_sanitation", "452314": "electrical_power", "452316": "it_equipment", "45232": "water_sanitation",
    "45233": "roads_bridges", "45234": "roads_bridges", "45235": "roads_bridges", "45236": "buildings_civil", "4524": "water_sanitation", "4525": "buildings_civil", "45251": "electrical_power", "45252": "water_sanitation",
    "4526": "buildings_civil", "4531": "electrical_power", "4532": "buildings_civil", "4533": "water_sanitation", "4534": "buildings_civil", "4535": "buildings_civil", "454": "buildings_civil",
    "48": "it_equipment",
    "50": None, "501": "vehicles_transport", "5023": "roads_bridges", "5024": "vehicles_transport", "503": "it_equipment", "504": "medical", "505": "water_sanitation", "5053": None,
    "5071": "electrical_power", "5072": "buildings_civil", "5073": "electrical_power", "5074": "buildings_civil", "5075": "buildings_civil", "5083": "textiles_uniforms", "5085": "furniture",
    "51": None, "511": "electrical_power", "513": "it_equipment", "514": "medical", "516": "it_equipment",
    "55": "food_catering",
    "60": "vehicles_transport",
    "63": "vehicles_transport",
    "642": "it_equipment",
    "651": "water_sanitation", "653": "electrical_power",
    "66": "consultancy",
    "71": "consultancy",
    "72": "it_equipment",
    "73": "consultancy",
    "77": "agriculture_environment",
    "79": None, "791": "consultancy", "792": "consultancy", "793": "consultancy", "7934": "printing_media", "794": "consultancy", "796": "security_cleaning_services", "797": "security_cleaning_services",
    "798": "printing_media", "7997": "printing_media", "7998": "printing_media",
    "80": "consultancy",
    "85": "medical",
    "904": "water_sanitation", "905": "security_cleaning_services", "906": "security_cleaning_services", "907": "agriculture_environment", "909": "security_cleaning_services",
    "921": "printing_media", "922": "printing_media",
    "9831": "security_cleaning_services",
}

#: Sector of a whole division, where it has one.
DIVISIONS = {
    "03": "agriculture_environment", "15": "food_catering", "16": "agriculture_environment", "18": "textiles_uniforms", "19": "textiles_uniforms", "22": "printing_media", "31": "electrical_power",
    "32": "it_equipment", "33": "medical", "34": "vehicles_transport", "35": "security_cleaning_services", "41": "water_sanitation", "44": "construction", "45": "construction", "48": "it_equipment",
    "55": "food_catering", "60": "vehicles_transport", "63": "vehicles_transport", "66": "consultancy", "71": "consultancy", "72": "it_equipment", "73": "consultancy", "77": "agriculture_environment",
    "80": "consultancy", "85": "medical",
}

#: Older wordings and the codes that replaced them.
WORDINGS = {
    "construction work for pipelines, communication and power lines, for highways, roads, airfields and railways": "45230000",
    "repair, maintenance and installation services": "50000000",
    "installation services": "51000000",
    "electrical machinery, apparatus, equipment and consumables": "31000000",
    "medical and laboratory devices, optical and precision devices, watches and clocks": "33000000",
    "medical and laboratory devices, optical and precision devices, watches and clocks, pharmaceuticals and related medical consumables": "33000000",
    "medical devices": "33100000",
    "medical non-chemical consumables and haematological consumables": "33141000",
    "miscellaneous medical devices": "33190000",
    "dentistry": "33130000",
    "therapy": "33150000",
    "functional exploration": "33120000",
    "food products and beverages": "15000000",
    "fruit and vegetables": "15300000",
    "miscellaneous food products n.e.c. and dried goods": "15800000",
    "rusks and biscuits": "15820000",
    "preserved pastry goods and cakes": "15820000",
    "dried or salted fish": "15230000",
    "beverages": "15900000",
    "office machinery, equipment and supplies except computers": "30100000",
    "office and computing machinery, equipment and supplies": "30000000",
    "computer hardware": "30230000",
    "computer systems": "30210000",
    "data-processing machines": "30210000",
    "photocopying and printing equipment": "30120000",
    "software": "48000000",
    "agricultural, horticultural and forestry machinery": "16000000",
    "transport related equipment": "34000000",
    "spectacles and lenses": "33734000",
    "truncheons or night sticks": "35300000",
    "parts of military weapons": "35300000",
    "military weapons": "35300000",
    "motorised tanks and armoured fighting vehicles": "35400000",
}

#: A pick of an older division whose wording begins so makes codes with these prefixes say nothing.
OLD_PICKS = {"manufactured goods, furniture, handicrafts": ["0334", "185", "352", "37", "391", "3923", "3929"]}

#: Shown names.
NAMES = {
    "construction": "Construction works",
    "roads_bridges": "Roads and bridges",
    "buildings_civil": "Buildings and civil works",
    "water_sanitation": "Water and sanitation",
    "electrical_power": "Electrical and power",
    "it_equipment": "IT equipment and software",
    "office_supplies": "Office supplies",
    "furniture": "Furniture",
    "medical": "Medical and pharmaceutical",
    "vehicles_transport": "Vehicles and transport",
    "food_catering": "Food and catering",
    "textiles_uniforms": "Textiles and uniforms",
    "printing_media": "Printing and media",
    "security_cleaning_services": "Security and cleaning services",
    "consultancy": "Consultancy",
    "agriculture_environment": "Agriculture and environment",
}

#: Stems of subjects in portal tags; they name subjects, never actions.
IN_TAGS = {
    "roads_bridges": ["highway", "road", "bridge", "culvert", "pavement", "embankment", "bituminous", "flyover", "footpath", "asphalt"],
    "buildings_civil": ["building", "brick", "cement", "concrete", "roofing", "plaster", "boundary wall", "school building", "hostel", "structural", "wood", "timber", "sawn", "carpentry", "tile", "glass", "paint", "sanitary ware", "construction material"],
    "water_sanitation": ["water supply", "sanitation", "sewer", "drain", "tube well", "pipe", "pump", "latrine", "toilet", "water treatment", "irrigation", "water distribution"],
    "electrical_power": ["electric", "transformer", "cable", "generator", "solar", "substation", "lighting", "conductor", "meter", "power distribution", "wiring", "switchgear", "battery", "energy"],
    "it_equipment": ["computer", "software", "server", "laptop", "printer", "network", "hardware", "data-processing", "data processing", "scanner", "photocopy", "ict", "telecommunication", "camera", "information system"],
    "office_supplies": ["stationery", "office supplies", "paper", "toner", "pen", "envelope", "office equipment", "office machinery", "consumable"],
    "furniture": ["furniture", "chair", "seat", "table", "almirah", "cabinet", "shelv", "bed", "sofa", "desk", "handicraft"],
    "medical": ["medical", "pharmaceutical", "medicine", "medicinal", "drug", "hospital", "surgical", "laboratory", "reagent", "diagnostic", "vaccine", "dental", "x-ray", "health", "orthopaedic", "anaesthe"],
    "vehicles_transport": ["vehicle", "motor", "car", "bus", "truck", "ambulance", "motorcycle", "tyre", "spare parts", "boat", "vessel", "transport services", "petroleum", "fuel", "diesel", "lubricant", "oil and associated"],
    "food_catering": ["food", "rice", "catering", "meal", "ration", "beverage", "sugar", "flour", "diet", "kitchen", "dairy", "fish product"],
    "textiles_uniforms": ["textile", "uniform", "cloth", "garment", "fabric", "shoe", "footwear", "blanket", "bedding", "insignia", "yarn", "leather"],
    "printing_media": ["printing", "publication", "book", "advertis", "media", "signboard", "banner", "binding", "newspaper", "broadcast"],
    "security_cleaning_services": ["security service", "guard", "cleaning", "janitorial", "waste", "pest control", "gardening", "outsourc", "manpower", "laundry", "dry-cleaning", "washing", "sewage disposal"],
    "consultancy": ["consultan", "advisory", "design services", "audit", "training services", "research services", "feasibility", "architectural", "engineering services"],
    "agriculture_environment": ["agricultur", "seed", "fertili", "livestock", "fish", "forest", "tree", "plant", "veterinary", "poultry", "crop", "environment", "pesticide"],
}

#: Stems of subjects in titles.
IN_TITLES = {
    "roads_bridges": ["road", "bridge", "culvert", "highway", "embankment", "carpeting", "hbb"],
    "buildings_civil": ["building", "boundary wall", "renovation", "repairing of", "civil work", "hostel", "plaster", "roof"],
    "water_sanitation": ["water supply", "tube well", "tubewell", "drain", "sanitation", "latrine", "pipe line", "pipeline"],
    "electrical_power": ["electric", "transformer", "solar", "generator", "cable", "substation", "meter"],
    "it_equipment": ["computer", "laptop", "printer", "software", "server", "ict", "scanner", "photocopier", "network"],
    "office_supplies": ["stationery", "stationary", "toner", "office supplies", "office equipment", "office items"],
    "furniture": ["furniture", "almirah", "chair", "table"],
    "medical": ["medicine", "medical", "surgical", "hospital", "laboratory", "reagent", "drug", "vaccine"],
    "vehicles_transport": ["vehicle", "ambulance", "motorcycle", "motor cycle", "tyre", "spare parts", "boat", "car "],
    "food_catering": ["food", "rice", "catering", "meal", "ration", "diet", "kitchen"],
    "textiles_uniforms": ["uniform", "textile", "cloth", "garment", "insignia", "shoe", "blanket"],
    "printing_media": ["printing", "publication", "book", "advertisement", "signboard", "banner"],
    "security_cleaning_services": ["security service", "cleaning", "outsourcing", "manpower", "guard", "waste"],
    "consultancy": ["consultancy", "consultant", "feasibility", "survey", "audit", "study"],
    "agriculture_environment": ["seed", "fertilizer", "fertiliser", "fish", "livestock", "tree", "plantation", "poultry", "crop"],
}


def sector(category: str | None) -> str | None:
    return next((s for s, types in TYPED.items() if category in types), category) if category else None


def prefixes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(PREFIXES.items()), "prefix string, category string")


def sectors(spark: SparkSession) -> DataFrame:
    found = sorted({c for c in PREFIXES.values() if c and c != SILENT})
    return spark.createDataFrame([(c, sector(c)) for c in found], "category string, sector string")


def divisions(spark: SparkSession, codes: DataFrame) -> DataFrame:
    """(division, groups, sector) from the official code list (code)."""
    named = spark.createDataFrame(list(DIVISIONS.items()), "division string, sector string")
    counted = codes.groupBy(F.left("code", F.lit(2)).alias("division")).agg(F.countDistinct(F.left("code", F.lit(4))).alias("groups"))
    return counted.join(named, "division", "full")
