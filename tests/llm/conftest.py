import random

import pytest

DATA = "/root/testdata/sf0.001"
#: Columns of documents and others, some of them named as the operators name theirs.
EXTRA = ("shard", "slot", "size", "tid", "root", "node", "n", "s", "t", "p", "target", "copies", "taken", "pii", "kept", "n_words", "n_lines", "ids", "n_tokens", "decoded", "lang_pred", "score", "p_doc", "site_post", "path_post")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in EXTRA)


def odd_rows():
    rng = random.Random(1)
    long_ = " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) + str(rng.randint(0, 999)) for _ in range(9000))
    near = " ".join(f"w{i}" for i in range(120))
    rows = [
        (1, near, "en", "a"), (1, near, "en", "a"), (2, near, None, None), (3, near.replace("w60 ", "v60 "), "en", "a"),
        (4, None, "en", "b"), (None, "", "de", None), (5, "!!! 123", None, "b"), (6, long_, "en", "c"), (7, "two words", "de", "c"),
    ]
    return [(*r, len(r[1] or ""), *(f"{c}{i}" if i % 2 else None for c in EXTRA)) for i, r in enumerate(rows)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
