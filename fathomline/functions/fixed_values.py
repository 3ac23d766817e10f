"""Labels, names and limits that results depend on. Jobs take them as default arguments."""

# Species names that are spelled differently in the sources (old to new).
PRODUCTION_SYNONYMS = {
    "Psetta maxima": "Scophthalmus maximus",
    "Larimichthys croceus": "Larimichthys crocea",
    "Sebastes schlegeli": "Sebastes schlegelii",
    "Acanthopagrus schlegeli": "Acanthopagrus schlegelii",
}
OCCURRENCE_SYNONYMS = {
    "Scophthalmus rhombus": "Scophthalmus maximus",
    "Pagrus major": "Pagrus auratus",
}

# Names in the header of occurrence files.
OCCURRENCE_COLUMNS = {"genus": "Genus", "epithet": "Species", "lat": "Center Lat", "lon": "Center Long"}
PROBABILITY_COLUMN = {"probability": "Overall Probability"}

# Native records that the occurrence data lack, and the species left out of the study.
MANUAL_NATIVE_ZONE = "Yellow Sea"
MANUAL_NATIVE_SPECIES = [
    "Larimichthys crocea",
    "Pagrus auratus",
    "Acanthopagrus schlegelii",
    "Mugil cephalus",
    "Paralichthys olivaceus",
    "Rachycentron canadum",
    "Sebastes schlegelii",
    "Seriola quinqueradiata",
    "Trachurus japonicus",
]
EXCLUDED_SPECIES = "Siganus rivulatus"

# Groups of pathogen taxa.
PATHOGEN_GROUPS = {
    "Parasites": [
        "Copepoda",
        "Isopoda",
        "Acanthocephala",
        "Cestoda",
        "Trematoda",
        "Clitellata",
        "Monogenea",
        "Digenea",
        "Nematoda",
        "Myxozoa",
    ],
    "Others": [
        "Amoebozoa",
        "Ciliophora",
        "Apicomplexa",
        "Dinoflagellate",
        "Microsporidia",
        "Oomycetes",
        "Protozoa",
    ],
}

# Display labels.
STATUS_LABELS = {"prod_native": "A. Native", "prod_introduced": "B. Non-native"}
SCORE_LABELS = {"Genetic": "B. Genetic", "Invasive": "A. Invasive", "Diseases": "C. Pathogenic"}

# Limits of the species screening and of the averaging period.
MARINE = 3
FISH_GROUP = "PISCES"
SCREEN_YEAR_AFTER = 2010
SCREEN_MIN_QUANTITY = 500
MEAN_YEAR_AFTER = 2006
