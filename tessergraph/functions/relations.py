"""The closed vocabulary of relations."""

# Relation names, by the kinds of their ends.
API_RELATIONS = ("subtype_of", "accepts", "returns")
KU_RELATIONS = ("task_related", "complements", "constrains", "contrasts_with", "same_ku")
API_KU_RELATIONS = ("has_explanation", "has_guidance", "has_example", "has_constraint")
RELATIONS = API_RELATIONS + KU_RELATIONS + API_KU_RELATIONS

# The data sets of a release and the query ids of each.
DATASETS = ("data", "graphics", "jenkov", "jodatime", "math", "official", "resources", "smack", "text")
QUERY_IDS = range(1, 31)
