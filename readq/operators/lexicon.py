"""Words and rules of the English question templates. All values here are fixed: they must equal those of the templates they define."""

QUESTION_WORDS = {
    "DATE": "When", "TIME": "When",
    "LOC": "Where", "GPE": "Where", "FAC": "Where",
    "PERSON": "Who", "PER": "Who",
    "ORG": "What", "WORK_OF_ART": "What", "PRO": "What",
    "LAW": "What", "EVENT": "What", "PRODUCT": "What",
}
CASE_WORDS = {
    "Ine": "Where", "Ela": "Where", "Ill": "Where", "Ade": "Where",
    "Ess": "When", "Gen": "Whose", "Par": "What", "Nom": "What",
    "Abl": "Where", "All": "Where", "Com": "Who", "Ins": "How",
}
RELATION_NOUNS = {
    "lead": "leader", "found": "founder", "establish": "founder", "discover": "discoverer", "acquire": "acquirer",
    "create": "creator", "invent": "inventor", "write": "author", "head": "head", "direct": "director",
}
PLURALS = {
    "ORG": "organizations", "PERSON": "people", "PER": "people", "GPE": "places", "LOC": "places", "FAC": "facilities",
    "WORK_OF_ART": "works", "PRODUCT": "products",
}
SINGULARS = {
    "ORG": "organization", "PERSON": "person", "PER": "person", "GPE": "place", "LOC": "place", "FAC": "facility",
    "WORK_OF_ART": "work", "PRODUCT": "product",
}
OBJECT_PREPS = {"DATE": "in", "TIME": "in", "GPE": "in", "LOC": "at", "FAC": "at"}
IMPLIED_PREPS = {"When": ("in", "at", "on", "during", "from"), "Where": ("in", "at", "near", "from")}

SKIP_VERBS = ("become", "be")
OBJECT_SKIP = ("MONEY", "CARDINAL", "PERCENT", "QUANTITY")
SUBJECT_SKIP = ("DATE", "TIME", "MONEY", "CARDINAL", "PERCENT", "QUANTITY")
PLACES = ("LOC", "GPE", "FAC")
TIMES = ("DATE", "TIME")
YESNO_SKIP = ("DATE", "TIME", "LOC", "GPE", "FAC")
YESNO_PASSIVE_SKIP = ("during", "into")
DISTRACTOR_TYPES = ("ORG", "PERSON", "PER", "GPE", "LOC", "FAC", "DATE", "TIME")
WHICH_TYPES = ("ORG", "PERSON", "PER", "GPE", "LOC", "FAC", "WORK_OF_ART")
COMPARED_TYPES = ("ORG", "PERSON", "PER", "GPE", "LOC")
SUBJECT_ANCHORS = ("PERSON", "PER", "ORG")
OBJECT_ANCHORS = ("DATE", "TIME", "GPE", "LOC", "FAC")
BRIDGE_TYPES = ("ORG", "PERSON", "PER", "GPE", "LOC", "FAC", "WORK_OF_ART", "PRODUCT")
BRIDGE_ANCHORS = ("PERSON", "PER", "ORG", "GPE", "LOC", "FAC")
BRIDGE_END_SKIP = ("DATE", "TIME", "MONEY", "CARDINAL", "PERCENT", "QUANTITY", "ORDINAL")

# The same for Finnish.
FI_QUESTION_WORDS = {
    "DATE": "Milloin", "TIME": "Milloin",
    "LOC": "Missä", "GPE": "Missä", "FAC": "Missä",
    "PER": "Kuka", "PERSON": "Kuka",
    "ORG": "Mikä", "PRO": "Mikä", "WORK_OF_ART": "Mikä",
}
FI_CASE_WORDS = {
    "Ine": "Missä", "Ela": "Mistä", "Ill": "Mihin", "Ade": "Missä",
    "Ess": "Milloin", "Gen": "Kenen", "Par": "Mitä", "Nom": "Mikä",
    "Abl": "Mistä", "All": "Mihin", "Com": "Kenen", "Ins": "Millä",
}
FI_RELATION_NOUNS = {
    "perustaa": "perustaja", "johtaa": "johtaja", "löytää": "löytäjä", "lead": "johtaja", "found": "perustaja", "establish": "perustaja",
    "acquire": "hankkija", "invent": "keksijä",
}
FI_PLURALS = {
    "ORG": "organisaatioita", "PERSON": "henkilöitä", "PER": "henkilöitä", "GPE": "paikkoja", "LOC": "paikkoja", "FAC": "tiloja",
    "WORK_OF_ART": "teoksia", "PRODUCT": "tuotteita",
}
FI_SINGULARS = {
    "ORG": "organisaatio", "PERSON": "henkilö", "PER": "henkilö", "GPE": "paikka", "LOC": "paikka", "FAC": "tila",
    "WORK_OF_ART": "teos", "PRODUCT": "tuote",
}

#: Of each language: question words by type, the word for other types, question words by case, nouns of relations, plurals and singulars of types.
TABLES = {
    "en": (QUESTION_WORDS, "What", CASE_WORDS, RELATION_NOUNS, PLURALS, SINGULARS),
    "fi": (FI_QUESTION_WORDS, "Mitä", FI_CASE_WORDS, FI_RELATION_NOUNS, FI_PLURALS, FI_SINGULARS),
}
