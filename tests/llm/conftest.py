import random

import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, _m string, n string, bands string"


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "s", "ed", "."]) for _ in range(n))


def texts():
    base = prose(1, 120)
    near = base.split()
    near[10], near[60] = "changed", "again"
    out = [None, "", "   \n\t ", "one", "One", "two words", "1234 !!! ###", "été naïve ÉCOLE", base, base, " ".join(near), base.upper(), prose(2, 30_000), "x" * 50_000, "la la " * 40, "a\n\nb\nb\n b\n", "\x00\x01 odd ​ bytes   here", "日本語 テキスト 🙂"]
    return out + [prose(s, 20 + s % 90) for s in range(100, 160)]


def rows(values):
    out = [(i, x, ["en", "fr", None][i % 3], ["s0", "s0", "s1", None][i % 4], len(x or ""), "clash", "clash", "clash") for i, x in enumerate(values)]
    # rows without doc_id, an id with two texts, and whole rows twice
    out += [(None, x, "en", "s0", 1, "clash", "clash", "clash") for x in (None, "no id here at all", prose(7, 40))]
    return out + [(20, prose(8, 35), "fr", "s1", 2, "clash", "clash", "clash"), out[30], out[30], out[12]]


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls in all columns, empty and very long texts, ties, repeated rows, ids and texts, odd bytes, and extra columns with clashing names."""
    return spark.createDataFrame(rows(texts()), COLUMNS).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="session")
def folder(spark, docs, tmp_path_factory):
    """The fixture documents as driver tables, with labels."""
    path = tmp_path_factory.mktemp("sf")
    docs.select("doc_id", "text", "lang", "source", "n_chars").coalesce(1).toPandas().astype({"doc_id": "Int64"}).to_parquet(path / "documents.parquet")
    spark.createDataFrame([(i, int(i % 5 != 0), int(i % 7 == 0)) for i in range(80)] + [(None, 1, 1), (3, 0, 1), (4, 1, 1), (4, 0, 0), (77, None, None)], "doc_id long, quality int, toxic int").toPandas().to_parquet(path / "labels.parquet")
    return str(path)
