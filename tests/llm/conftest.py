import pytest

#: The cases that every operator meets: nulls, empty and long texts, ties, repeated rows, clashing extra columns.
WORDS = "the of and thing tion ing her that was for on are with they his one all".split()


def prose(n, seed=0):
    return " ".join(WORDS[(i * 7 + seed * 13 + i * i % 5) % len(WORDS)] + ("." if i % 9 == 8 else "") for i in range(n))


def edge_rows():
    texts = [
        None, "", " \n\t ", "one", prose(40), prose(40), prose(40) + "\nA shared line of text here.\n", "A  shared line of text here.\nother words follow now\n", "\ta SHARED line of text here. \nlast line that nobody has",
        "word " * 3000, prose(6000, 3), "é" * 20 + "\n" + "É" * 20, "mail bob.smith@mail.example.com or +1 (632) 555-4827 and 10.0.0.1 4111 1111 1111 1111 end", "Licensed under the MIT license.\nApache License, Version 2.0\nSPDX-License-Identifier: (MIT OR GPL-3.0-only) AND CC-BY-NC-4.0",
        "<|endoftext|> tokens 日本語 \U0001f600 don't",
    ]
    rows = [(i, t, "en" if i % 3 else None, f"src{i % 2}" if i % 4 else None, len(t or ""), "x", i) for i, t in enumerate(texts)]
    return [*rows, rows[4], (None, prose(40), "de", "src9", 1, "y", 9)]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, component_id int"


@pytest.fixture(scope="session")
def edge_docs(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(3, 0, 0), (4, 1, 0), (5, 1, 0), (9, 0, 0), (10, 1, 1), (None, 1, 0), (6, None, None), (7, 1, 1)], "doc_id long, quality int, toxic int")
