"""Documents that strain operators: nulls, empty and long texts, ties, repeated rows, columns with clashing names."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, count long, fp string, word string, _th string, h double"


def words(rng, n, alphabet="abcdefgh"):
    return " ".join("".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 7))) for _ in range(n))


def nasty_rows():
    rng = random.Random(5)
    base = [words(rng, 60) for _ in range(6)]
    page = "\n".join(words(rng, 12) for _ in range(8))
    texts = [None, "", " \n\t ", "one", "Über Straße naïve 日本語 テキスト " + base[0], base[0], base[0], base[1], base[1] + " tail", page, page, "intro line here\n" + page, "a" * 700, "xy" * 400, words(rng, 12_000), base[2].upper(), base[3] + "\n" + base[4], base[4] + "\r\n" + base[3], "\n".join([base[5]] * 5), "<s> </s> <|endoftext|> it's  two  spaces ", "0 1 2 3 4 5 6 7 8 9 10 11"]
    rows = [(i, t, "en", f"src{i % 3}" if i % 4 else None, None, 1, "x", None, "y", 0.5) for i, t in enumerate(texts)]
    rows += [rows[5], rows[9], rows[2]]  # repeated rows
    rows += [(None, base[1], None, None, 3, 1, "x", None, "y", 0.5), (7, words(rng, 30), "de", "src1", 3, 1, "x", None, "y", 0.5)]  # no id; an id twice
    return rows


def nasty(spark):
    return spark.createDataFrame(nasty_rows(), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
