import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def make_rows(seed=0, n=60):
    """Documents with copies, shared passages, nulls, empties, long and periodic texts, repeated rows and ties."""
    r = random.Random(seed)
    vocab = {lang: ["".join(r.choice(alpha) for _ in range(r.randint(1, 7))) for _ in range(400)] for lang, alpha in (("en", "theoanwrsid"), ("de", "seichüberndt"), ("fr", "éauoxlemtnr"))}
    make = lambda lang, k: " ".join(r.choice(vocab[lang]) for _ in range(k))
    shared = [make("en", 90), make("fr", 130)]
    rows = []
    for i in range(n):
        lang = r.choice(list(vocab))
        parts = [make(lang, r.randint(1, 120)) for _ in range(r.randint(1, 4))]
        if i % 5 == 0:
            parts.insert(r.randint(0, len(parts)), r.choice(shared))
        if i % 4 == 0:
            parts.append("all sites have this line")
        rows.append([i, "\n".join(parts), lang, f"s{i % 7}"])
    rows[7][1] = rows[3][1]
    rows[8][1] = rows[3][1] + " Plus  one"
    rows[9][1] = rows[3][1].replace(" ", "\t ", 3)
    extra = [
        [100, None, "en", "s1"], [101, "", None, "s2"], [102, " \n\t ", "de", None], [103, "one", "en", "s3"], [104, "12 34 !?", None, "s4"],
        [105, "be " * 3000, "en", "s5"], [106, "x" * 1500, "en", "s6"], [107, make("de", 20000), "de", "s0"], [108, "Ünï — çödé 漢字 " * 30, "fr", "s1"],
        [109, shared[0], "en", "s2"], [109, shared[0], "en", "s2"], [109, "another text of the same id", "en", "s2"], [None, shared[1], "fr", "s3"], [None, None, None, None],
        [110, "THE!! END!! IS!! NEAR!! " * 20, "en", "s4"], [111, "a\x85b c d 　 e", "en", "s5"],
    ]
    return [(*x, None if x[1] is None else len(x[1])) for x in rows + extra]


@pytest.fixture(scope="session")
def rows():
    return make_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(docs):
    """Extra columns with the names that operators use themselves."""
    from pyspark.sql import functions as F

    names = ["g", "h", "at", "n", "fp", "u", "v", "size", "rank", "line", "shard", "place", "taken", "score", "lang_pred", "_k1", "_k2", "_row", "c0", "words", "a.b"]
    return docs.select("*", *[F.lit(i).alias(x) for i, x in enumerate(names)])


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, str(type(x)), x) if x is None or not isinstance(x, bool) else (True, "b", x) for x in r))
