"""Documents with nulls, empty and long texts, copies, repeated rows and ids, for all operators."""

LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(20_000))
BASE = " ".join(f"base{i}" for i in range(120))


def near(k):
    """BASE with k words replaced, far from one another."""
    words = BASE.split()
    for i in range(k):
        words[7 + 20 * i] = f"other{i}"
    return " ".join(words)


ROWS = [
    (1, BASE),
    (2, BASE),
    (3, near(1)),
    (4, near(5)),
    (5, None),
    (6, ""),
    (7, " \t\n "),
    (8, "two words"),
    (9, "Two  WORDS"),
    (10, LONG),
    (11, LONG + " tail"),
    (12, "éa ÉA ñ ß 漢字 🎉 İ x1"),
    (13, near(2)),
    (13, near(2)),  # a repeated row
    (14, "one two three four five six"),
    (14, "seven eight nine ten eleven twelve"),  # an id with two texts
    (None, near(3)),
    (15, "none like it " + BASE),
]
