"""Small invented inputs with the schemas of FIXTURES.md (no text from the reference)."""

METADATA_COLS = ["title", "org", "link", "doc_type", "org_type", "worker_focus", "geography", "date", "file_name"]

METADATA = [
    ("Harbor Charter", "Dockside Union", "http://example.org/a", "demands", "union", "annotators", "Global", "03-14-2024", "harbor.txt"),
    ("Lantern Code", "Lantern Guild, Inc.", "http://example.org/b", "standard", "company", "moderators", "US", None, "lantern.txt"),
    ("Meadow Pledge", "Meadow Group", "http://example.org/c", "guideline", None, "annotators", "EU", "January 2026", "meadow.txt"),
    ("Quiet Note", "Quiet Org", "http://example.org/d", "guideline", "nonprofit", "raters", "EU", "11-02-2023", "missing.txt"),
]

# parameter, category, subcategory, definition, keywords (framework order)
FRAMEWORK = [
    ("Pay floor", "Working conditions", "Wages", "Workers earn at least a living wage.", "wage, pay"),
    ("Paid on time", "Working conditions", "Wages", "Payment arrives on a fixed schedule", None),
    ("Rest breaks", "Working conditions", "Hours", "Workers can pause during long tasks.", "break"),
    ("Right to organise", "Contracts", "Voice", "Workers may form or join a union.", "union, collective"),
    ("Never coded", "Contracts", "Voice", "A clause nobody mentions.", ""),
]

D = {row[0]: row[3] for row in FRAMEWORK}

# policy_title, sentence, corpus_size, primary, alt1..alt4
REVIEW = [
    ("Harbor Charter", "We pay a living wage.", 10, D["Pay floor"], D["Paid on time"], None, None, None),
    ("Harbor Charter", "Unions are welcome.", 10, D["Right to organise"], None, None, None, None),
    ("Harbor Charter", "Wages twice coded.", 10, D["Pay floor"], D["Pay floor"], None, None, None),
    ("Lantern Code", "Breaks every hour.", 4, D["Rest breaks"], "A definition outside the framework.", None, None, None),
    ("Lantern Code", "Pay is on schedule.", 4, D["Paid on time"], None, None, None, None),
    ("Ghost Policy", "Living wages for all.", 7, D["Pay floor"], None, None, None, None),
    ("Harbor Charter ", "Trailing space title.", 10, D["Rest breaks"], None, None, None, None),
]

REVIEW_SCHEMA = (
    "policy_title string, sentence string, corpus_size int, primary_paramater string, "
    "alt_parameter_1 string, alt_parameter_2 string, alt_parameter_3 string, alt_parameter_4 string"
)


def framework_df(spark):
    rows = [(i, p, c, s, d) for i, (p, c, s, d, _) in enumerate(FRAMEWORK)]
    return spark.createDataFrame(rows, "pos long, parameter string, category string, subcategory string, definition string")


def metadata_df(spark):
    return spark.createDataFrame(METADATA, ", ".join(f"{c} string" for c in METADATA_COLS))


def review_df(spark):
    return spark.createDataFrame(REVIEW, REVIEW_SCHEMA)
