"""Small inputs with the cases every operator must bear."""

import random

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
# Names that operators use themselves.
CLASHING = ["key", "fp", "size", "row", "own", "own_row", "score", "kept", "blob", "shard", "class", "positions", "taken", "host"]


def prose(rng, n, words="the of and tion ingre thand oner ealy st on le réau ñez Über"):
    words = words.split()
    return " ".join("".join(rng.choices(words, k=rng.randint(1, 3))) + rng.choice(["", "", "", ".", ",\n"]) for _ in range(n))


def documents():
    rng = random.Random(5)
    base = [prose(rng, rng.randint(25, 160)) for _ in range(40)]
    passage = prose(rng, 40)
    texts = list(base)
    texts += [base[3], base[3], base[7]]  # copies
    texts += [base[k].replace("the", "teh", 1) for k in (3, 4, 5)]  # near copies
    texts += [f"{base[k][:90]}{passage}{base[k][-90:]}" for k in (8, 9, 10, 11)]  # a shared passage
    texts += [None, "", " \n\t ", "One", "two words", "x" * 49, "y" * 50, "y" * 51, "ab" * 400, "ab" * 300]
    texts += [("spam " * 60).strip(), "line of a kind\n" * 30, "\x00nul\x0bvt\x85nel em\U0001f600 smile"]
    texts += [" ".join(base[:20]) * 12]  # very long
    rows = [(i, t, rng.choice(["en", "fr", None]), rng.choice(["b", "a", "Z", "é", None, "a"]), None if t is None else len(t)) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    rows += [rows[0], rows[5]]  # repeated rows
    rows += [(None, base[6], None, "a", 1), (None, None, None, None, None), (12, base[1], "en", "b", 1)]  # no id, an id with another text
    return rows


def frame(spark, rows, schema, extra=()):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, schema)
    return df.withColumns({name: F.lit(f"own {name}") for name in extra}) if extra else df


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def ordered(rows):
    return sorted(rows, key=repr)
