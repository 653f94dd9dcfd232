import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, row long, fp long, label int, hash long, spans string, doc string, text_hash long, rank int"
LONG = " ".join(f"word{i % 977} Other{i % 31}." for i in range(30_000))
PASSAGE = "The river runs past the old mill. Its wheel has not turned since the great flood. Children swim there in summer until dusk."


def table(spark, pairs, schema=COLUMNS):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), 7, 7, 1, 7, "x", "y", 7, 1) for i, t in pairs], schema)


@pytest.fixture(scope="session")
def odd(spark):
    """Null ids, null and empty texts, repeated rows, ties, a very long text, columns of inner names."""
    pairs = [
        (1, "All rights reserved. Licensed under CC BY-NC 4.0."),
        (2, None),
        (None, "A text without an id, released under the MIT License."),
        (None, None),
        (3, ""),
        (4, " \n\t "),
        (5, LONG),
        (6, "same row twice here, yes"),
        (6, "same row twice here, yes"),
        (6, "the same id, another text"),
        (7, f"Opening words. {PASSAGE} Closing words."),
        (8, PASSAGE),
        (9, "éü \U0001f600 \x00 <|endoftext|> ＡＢ Kİ"),
        (10, "cc by cc by\ncc\nby general public license, version 3"),
        (11, "# $ % # $ % # $ % # $ %\n# $ %\n# $ %"),
    ]
    return table(spark, pairs)


@pytest.fixture(scope="session")
def empty(spark):
    return table(spark, [])


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")
