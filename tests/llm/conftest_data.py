"""Hand-made rows that every operator must bear."""

LONG = "alpha beta gamma delta " * 60_000
BASE = "the quick brown fox jumps over the lazy dog while nine small birds sing in the old green tree by the river side today and then all of them fly away to the far blue hills beyond"
DOCS = [
    (1, BASE, "en", "a"), (2, BASE, "en", "a"), (3, BASE + " again", "en", "b"), (4, None, "en", None), (5, "", None, "b"),
    (6, "   \n\t ", "en", "c"), (None, BASE, "en", "a"), (None, None, None, None), (7, "one", "en", "c"), (8, "ONE", "en", "c"),
    (9, LONG, "en", "a"), (10, "x\ny\nx\n" + BASE, "en", None), (10, "x\ny\nx\n" + BASE, "en", None),
    (11, "é ü 日本 🎉 password: hunter2hunter2 under the MIT License", "en", "d"),
    (12, "word", "en", "z"), (12, "other text of the same id", "en", "z"),
]
SCHEMA = "doc_id bigint, text string, lang string, source string, kept boolean, component_id string, node bigint, size bigint, t double, rank int"


def edge_docs(spark):
    """DOCS with further columns whose names clash with those that operators use."""
    return spark.createDataFrame([(*d, None, "x", 7, 1, 0.5, 3) for d in DOCS], SCHEMA)
