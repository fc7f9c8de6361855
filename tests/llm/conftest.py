import random

import pytest


@pytest.fixture(scope="session")
def docs(spark):
    """Small documents with all that the table may hold: nulls, empty and long texts, ties, copies, clashing columns."""
    rng = random.Random(7)
    vocab = ["the", "of", "Été", "naïve", "x", "Y,", "lorem", "ipsum.", "dolor", "sit", "amet", "|", "straße", "日本", "​z"]
    base = ["".join(rng.choice(vocab) + rng.choice([" ", " ", " ", "\n", "\t"]) for _ in range(rng.randrange(1, 90))) for _ in range(40)]
    rows = list(base)
    for t in base[:25]:  # near copies
        w = t.split(" ")
        w[rng.randrange(len(w))] = "changed"
        rows.append(" ".join(w))
    rows += base[:6] * 3 + ["", None, "   \n ", "one", "one two", "\n\n", "a" * 3000, "A b\n" * 12]
    rows += [f"{t}\nAll Rights  reserved.\n" for t in base[8:20]] + [base[30] + base[31] + base[32], "shared passage of words " * 8]
    rng.shuffle(rows)
    data = [(3 * k + 1, t, "en", f"s{k % 3}", len(t or ""), "extra", 1, False) for k, t in enumerate(rows)]
    return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, keys string, n int, kept boolean")


@pytest.fixture(scope="session")
def rows(docs):
    return [(r["doc_id"], r["text"]) for r in docs.collect()]
