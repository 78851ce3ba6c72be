import pytest

SMALL = "/root/testdata/sf0.001"

EDGE = [
    (1, None, None, "x", 0),
    (2, "", "en", None, 0),
    (3, "   \n\t ", "en", "x", 1),
    (4, "One two three four five six seven.", "en", "x", 2),
    (5, "One two three four five six seven.", "en", "x", 2),
    (6, "ONE TWO three four FIVE six seven.", "en", "x", 2),
    (7, "Été à Paris, où l'on dîne; ça va très bien aujourd'hui.", "fr", "y", None),
    (8, "日本語のテキスト 😀 é  ", None, "y", 3),
    (9, "one two", "en", "y", 3),
    (10, " ".join(f"w{i % 997}" for i in range(20_000)), "en", "hot", 4),
    (10, " ".join(f"w{i % 997}" for i in range(20_000)), "en", "hot", 4),
    (12, "a" * 30_000, "en", "hot", 4),
    (None, "no id here at all", "en", "hot", 4),
]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls in every column, empty, blank, very long and repeated texts, a repeated id and a missing one."""
    return spark.createDataFrame(EDGE, SCHEMA).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(edge):
    """The same rows with further columns whose names the operators use themselves."""
    from pyspark.sql import functions as F

    extra = ["row", "size", "shard", "_key", "_bucket", "score", "predicted", "spans", "items", "rate", "n", "word", "component_id", "rep", "_id", "_toxic", "_kept", "_row", "contaminated", "copies", "domain", "learn"]
    return edge.withColumns({c: F.lit("mine") for c in extra})
