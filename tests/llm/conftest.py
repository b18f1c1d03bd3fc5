import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, h long, shard int"


def rows_of_documents():
    """Nulls in every column, empty and very long texts, ties, repeated rows, clashing extra columns."""
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi".split()

    def text(seed, n):
        return " ".join(words[(seed * 7 + i * i * 3 + i * seed) % 16] + str((seed * i) % 97) for i in range(n))

    rows = []
    for i in range(60):
        rows.append((i, text(i, 30 + i), "en", f"src{i % 4}", 1, 5, 6, 7))
    rows += [(100, None, None, None, None, None, None, None), (101, "", "en", "src1", 0, 0, 0, 0), (None, text(3, 40), "en", "src2", 1, 1, 1, 1),
             (102, "   \n\t ", "de", None, 1, 1, 1, 1), (103, text(5, 9000), "en", "src3", 1, 1, 1, 1), (104, "né <|endoftext|>  x\n\ny </s> ", "fr", "É", 1, 1, 1, 1)]
    rows += [(7, text(7, 37), "en", "src3", 1, 5, 6, 7)] * 5 + [(105, text(8, 38), "en", "src0", 1, 1, 1, 1)] * 3
    return rows


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(rows_of_documents(), DOCS).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


def collect(df, *cols):
    return sorted([tuple(r) for r in (df.select(*cols) if cols else df).collect()], key=lambda r: tuple((x is None, x if x is not None else 0) for x in r))
