import pytest

WORDS = "alpha bravo charlie delta echo foxtrot golf hotel india juliet kilo lima mike november oscar papa quebec romeo sierra tango uniform victor".split()

#: Null and empty texts, repeated rows, one very long text, ties, and columns whose names clash with those of the operators.
CLASHING = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, component_id bigint, entities string, ids string, size bigint, fp bigint, key string, rep bigint"


def sentence(seed, n):
    out, x = [], seed * 7919 + 17
    for _ in range(n):
        x = (x * 1103515245 + 12345) % 2**31
        out.append(WORDS[x // 65536 % len(WORDS)])
    return " ".join(out)


@pytest.fixture(scope="session")
def awkward(spark):
    """Rows that every operator must take."""
    texts = [None, "", "   \n\t ", "one", "one", sentence(1, 60), sentence(1, 60), sentence(1, 59) + " changed", "x" * 5000, "word " * 3000, sentence(2, 4000), "héllo wörld ñandú 中文 \U0001f600", "\x00 nul", None]
    rows = [(k if k != 13 else None, t, None if k % 5 == 0 else "en" if k % 2 else "fr", None if k % 4 == 0 else f"s{k % 3}", None if t is None else len(t), 1.5, 7, "e", "i", 9, 3, "k", 2) for k, t in enumerate(texts)]
    rows += [rows[5], rows[5]]
    return spark.createDataFrame(rows, CLASHING)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], CLASHING)
