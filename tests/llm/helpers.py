"""Small document tables with every odd case."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns that the operators use inside, as extra columns of an input.
CLASHING = ["id", "run", "sha", "fp", "node", "key", "x", "y", "n", "row", "rank", "score", "place", "upto", "_n", "tokens", "host", "path", "verdict", "times", "piece", "html_"]


def words(rng, n):
    return " ".join("".join(rng.choices("abcdefghij", k=rng.randrange(2, 7))) for _ in range(n))


def odd_documents(seed=1):
    rng = random.Random(seed)
    base = [words(rng, rng.randrange(30, 200)) for _ in range(12)]
    base[2] = words(rng, 180)
    texts = [*base, base[0], base[0].replace(" ", "\n  "), base[1], None, None, "", " \t\n", "é ü ß", "!!! 123", words(rng, 6000)]
    near = base[2].split()
    near[7] = "changed"
    texts.append(" ".join(near))
    rows = [(i, t, rng.choice(["en", "de", None]), rng.choice(["src0", "src1", "other", None]), None) for i, t in enumerate(texts)]
    return [*rows, rows[3], rows[3], (None, base[4], "en", "src0", 1), (None, base[4], "en", "src0", 1), (None, None, None, None, None)]


def table(spark, rows, schema=DOCS, clashing=False):
    df = spark.createDataFrame(rows, schema).repartition(3)
    if clashing:
        from pyspark.sql import functions as F

        df = df.withColumns({c: F.lit("clash") for c in CLASHING})
    return df


def empty(spark, schema=DOCS):
    return spark.createDataFrame([], schema)
