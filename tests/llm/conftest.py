import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


ODD = [
    (5, "A plain text. With two lines\nand a plain text.", "en", "src0"),
    (2, None, None, None),
    (None, "no id here", "en", "src0"),
    (3, "", "fr", "src1"),
    (4, " \t\n ", "de", "src1"),
    (9, "A plain text. With two lines\nand a plain text.", "en", "src0"),
    (9, "A plain text. With two lines\nand a plain text.", "en", "src0"),
    (7, "Émile ÉTÉ çà 日本語 \U0001f600 naïve <|endoftext|> 'tis  x  ", None, "src2"),
    (8, "word " * 6000 + "\n" + "x" * 5000, "en", None),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and an extra column with a clashing name."""
    rows = [(*r, len(r[1] or ""), "extra", 1) for r in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, words string, size int")


@pytest.fixture(scope="session")
def empty(spark, odd):
    return odd.limit(0)


SF = "/root/testdata/sf0.001"
