import random
import re

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _row string, ids string, name string, found string"


def words(text):
    return [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w]


def lower_ascii(text):
    return (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def prose(rng, n, vocabulary=400):
    return " ".join(f"{rng.choice('abcdefgh')}{rng.randrange(vocabulary):x}o" for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Texts with copies, near copies, shared passages, ties, empty, blank, null and very long ones."""
    rng = random.Random(3)
    base = [prose(rng, n) for n in (1, 3, 4, 5, 49, 50, 51, 80, 120, 200, 300)]
    shared = prose(rng, 70)
    rows = [(k, t) for k, t in enumerate(base)]
    n = len(rows)
    for k, t in enumerate(base):  # copies with other white space, near copies, texts around a passage
        w = t.split()
        rows.append((n, "  \n".join(w)))
        w[len(w) // 2] = "changed"
        rows.append((n + 1, " ".join(w)))
        rows.append((n + 2, prose(rng, 20) + " " + shared + "\t" + prose(rng, k)))
        n += 3
    rows += [(n, ""), (n + 1, None), (n + 2, " \n\t"), (n + 3, "x " * 300), (n + 4, "y" * 5000), (n + 5, prose(rng, 6000)), (n + 6, "Ünï çødé " * 30), (n + 7, "a b c d e f g " * 40)]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    """The odd rows, two of them repeated, one with a null id, with extra columns of clashing names."""
    rows = odd_rows + [odd_rows[0], odd_rows[5], (None, odd_rows[7][1])]
    return spark.createDataFrame([(d, t, None, None, None, "r", "i", "n", "f") for d, t in rows], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark, odd_rows):
    return spark.createDataFrame([(d, t, "en", "s", len(t or ""), "r", "i", "n", "f") for d, t in odd_rows], SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
