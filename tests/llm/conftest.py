import pytest

from tests.conftest import rows  # noqa: F401

#: Names that the operators use inside; extra columns of the input must not clash with them.
EXTRA = ["n", "s1", "s2", "rep", "bands", "copies", "key", "lane", "shard", "slot", "kept", "rate", "doc", "ids", "words", "starts", "__id", "rank", "score", "__doc", "__spans", "__rated", "__rate", "__times", "__copy", "__kept", "__place", "domain", "features"]


def words(*numbers):
    return " ".join(f"w{i}" for i in numbers)


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls in every column, empty and long texts, ties and repeated rows, and extra columns."""
    base = words(*range(200))
    data = [
        (0, base), (1, base), (1, base), (2, words(*range(3, 200), 900, 901)), (3, ""), (4, None), (5, "one"), (6, "One"), (7, "two words"), (8, " \t\n\x0b\x0c\r "), (9, base.upper()), (10, words(*range(500, 560))),
        (11, words(*range(500, 555), *range(700, 710))), (12, "é ü  中文\u00a0x <|endoftext|> # $ a\u2003b"), (13, " ".join(["long"] * 30_000)), (None, base), (None, None), (14, "x\n\nx\nx y\n" * 9), (-7, words(*range(40, 120))),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in EXTRA)
    full = [(i, t, None if i == 3 else "en", None if i == 5 else "src", None if t is None else len(t), *[str(i)] * len(EXTRA)) for i, t in data]
    return spark.createDataFrame(full, schema)


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")
