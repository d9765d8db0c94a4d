import pytest

LONG = "wörd and Then some, more. " * 20_000


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows, and columns whose names operators use themselves."""
    rows = [
        (1, "Plain words of a text that is long enough to have shingles.", "en"),
        (1, "Plain words of a text that is long enough to have shingles.", "en"),
        (2, None, None),
        (3, "", "de"),
        (4, " \n\t ", None),
        (5, LONG, "en"),
        (6, "日本語のテキスト です。", "ja"),
        (7, "1234 !!! ???", "en"),
        (None, "without an id", "en"),
        (8, "Plain words of a text that is long enough to have shingles.", "en"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    extra = {"score": 1.0, "fp": 2, "piece": 3, "shard": 4, "overlap0": 5, "contamination": 6, "bucket": 7, "key": 8, "proposals": 9, "component_id": 10, "Score_": 11}
    from pyspark.sql import functions as F

    return df.withColumns({k: F.lit(v) for k, v in extra.items()})


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.where("false")
