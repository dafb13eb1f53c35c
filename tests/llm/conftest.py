import random

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, h string, fp string, key string, n_tokens string, epoch string"


def _rows():
    rng = random.Random(3)
    words = ["the", "house", "river", "Münze", "straße", "été", "año", "a", "of,", "and.", "mail", "日本", "x1"]
    rows = []
    for k in range(40):
        text = " ".join(rng.choice(words) for _ in range(rng.randrange(1, 60)))
        rows.append((k, text, rng.choice(["en", "de", None]), rng.choice(["src0", "src1"])))
    rows += [(100, None, None, None), (101, "", "en", "src0"), (102, " \n\t ", "en", "src0"),
             (103, "the river " * 4000, "en", "src0"), (104, "x" * 30_000, "en", "src0"),
             (105, "call +1 (234) 567-8901 or a.b@c.de now 10.0.0.1", "en", "src1"),
             (3, rows[3][1], rows[3][2], rows[3][3]), (107, rows[5][1], "en", "src0"), (108, rows[5][1], "en", "src0"),
             (None, "no id here, but a text", "en", "src0"), (109, "é́ ▁ \x00 😀😀", "en", "src0")]
    return [(*r, len(r[1] or ""), "h", "f", "k", "n", "e") for r in rows]


@pytest.fixture(scope="session")
def rows():
    """Nulls, empty and long texts, repeated rows, equal texts, an id that is null, clashing columns."""
    return _rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, COLUMNS).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="session")
def model_path():
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")
