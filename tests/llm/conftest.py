import pytest
from pyspark.sql import SparkSession
from samples import edited, sentence


@pytest.fixture(scope="session")
def spark():
    session = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def rows():
    """(doc_id, text, lang, source): nulls, empty and long texts, copies, near copies, ties and repeated rows."""
    base = [sentence(i, 80) for i in range(6)]
    found = [(i, t, "en", "a") for i, t in enumerate(base)]
    found += [(10, base[0], "en", "b"), (11, edited(base[0], 3), "en", "b"), (12, edited(edited(base[0], 3), 40), "fr", "b"), (13, edited(base[1], 79).upper(), None, None)]
    found += [(20, None, "en", "a"), (21, "", "en", "a"), (22, " \n\t ", None, "a"), (23, "one two", "en", "a"), (24, "one two", "en", "a"), (25, "ONE  two", "en", "a")]
    found += [(30, base[2] + "\n" + sentence(50, 20) + "\n" + sentence(50, 20), "en", "a"), (31, sentence(50, 20) + "\nshort\n" + edited(sentence(50, 20), 5), "en", "a")]
    found += [(40, sentence(99, 6000), "en", "a"), (None, base[3], "en", "a"), (None, sentence(77, 60), "en", None)]
    found += [(50, base[4], "en", "a"), (50, base[4], "en", "a")]
    return found


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The rows, with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(*r, 1, "x", [0]) for r in rows], "doc_id long, text string, lang string, source string, key int, tid string, ids array<int>").repartition(3)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
