import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, words, alphabet="etaoinshrdlu"):
    return " ".join("".join(rng.choice(alphabet) for _ in range(rng.randint(2, 8))) for _ in range(words))


def awkward_rows():
    """Nulls in every column, empty and long texts, repeated rows, ties, near copies, odd characters."""
    rng = random.Random(5)
    rows = [(i, "\n".join(prose(rng, rng.randint(5, 40)) for _ in range(rng.randint(1, 5))), "en", f"s{i % 3}", 10 * i)
            for i in range(40)]
    base = rows[3][1]
    rows += [(100, base, "en", "s1", 3), (101, base.replace("e", "E"), "en", "s1", 3),
             (102, base.replace(base[50], "z", 1), None, "s0", 3), (103, base + "\n" + rows[7][1], "en", None, None)]
    rows += [(110, None, None, None, None), (111, "", "en", "s0", 0), (112, " \n\t ", "en", "s0", 4), (113, "!!! 123", "de", "s1", 7),
             (114, "x", "de", "s1", 1), (115, "x", "de", "s1", 1), (None, "a row without a number", "en", "s1", 22),
             (116, "Grüße 日本語▁x <|endoftext|>  \x00 \U0001F600", "de", "s2", 30), (117, prose(rng, 30_000), "en", "s0", 9)]
    rows += [(5, rows[5][1], "en", "s2", 50), (118, "\n".join(["the same line of thirty two chars or more"] * 60), "en", "s1", 1)]
    return rows


def texts(rows=None):
    return [(r[0], r[1] or "") for r in (rows or awkward_rows())]


def rows(df, *columns):
    """Rows as sorted tuples of the given columns."""
    picked = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in picked.collect()), key=repr)
