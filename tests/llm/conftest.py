"""A small hostile documents table: nulls in every column, empty, blank and
long texts, ties, repeated rows, and extra columns with clashing names."""

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, rank int, size long, row string, h string, target double, n long, k int, v long, slot long, __id string, component_id long, lines string, y int, start long, length long"


def rows():
    long_text = "\n".join(f"line {i} of a long text with words {i * 7} and {i % 5}" for i in range(3000))
    base = "the quick brown fox jumps over the lazy dog and runs far away from all of it today"
    texts = {
        1: base,
        2: base,
        3: base + " indeed",
        4: None,
        5: "",
        6: "   \n\t ",
        7: "one",
        8: "One\nTWO\n one \n\n",
        9: long_text,
        10: "12345 !!! 67",
        11: "Released under the MIT License.\nfree mit license mit license text",
        12: "Grüße aus Köln, ça va très bien, señor. \U0001f600",
        13: "wholly different words stand here so nothing else is near to this short text at all",
        14: "<|endoftext|> a b",
    }
    out = [(i, t, "en" if i % 2 else "fr", None if i == 7 else f"s{i % 3}", len(t or "")) for i, t in texts.items()]
    out.append((1, base, "en", "s1", len(base)))  # a repeated row
    out.append((None, base, None, None, None))
    out += [(100 + i, f"copy of a common line\nbut {i} is the only one with words {i} like {i} these {i}", "en", "s9", 0) for i in range(12)]
    return [(*r, 0.5, 1, 2, "r", "h", 0.1, 7, 3, 5, 4, "x", 9, "l", 1, 2, 3) for r in out]


@pytest.fixture(scope="session")
def hostile(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture
def as_tables(tmp_path):
    """Writes frames as tables of a directory, as queries read them."""

    def write(**tables):
        for name, d in tables.items():
            d.write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write
