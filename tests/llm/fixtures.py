"""Small documents with what may go wrong: nulls, blanks, repeats, ties, long texts, clashing columns."""

import random

LONG = " ".join(f"w{i % 997}" for i in range(30_000))
EXTRA = "key string, place int, n long, copies int, id long, hashes string, component_id long, kept boolean"


def texts():
    draw = random.Random(5)
    vocabulary = ["".join(draw.choice("abcdefgh") for _ in range(draw.randint(2, 7))) for _ in range(400)]

    def text(n):
        return " ".join(draw.choice(vocabulary) for _ in range(n))

    base = [text(draw.randint(8, 90)) for _ in range(40)]
    out = [None, "", " ", "\t\n", "one", "One two", "one two three four five", LONG, LONG + " x", "Ünïcode ß 日本 語", "don't  stop", "a b c d e a b c d e"]
    out += base + base[:5] + [b.upper() for b in base[5:10]] + [b.replace(" ", "\n ") for b in base[10:15]]
    for b in base[15:30]:  # near copies of several degrees
        words = b.split(" ")
        for k in (1, 2, 4, 9):
            changed = list(words)
            for _ in range(k):
                changed[draw.randrange(len(changed))] = draw.choice(vocabulary)
            out.append(" ".join(changed))
        out.append(b + " " + text(3))
    return out


def documents(spark, with_odd_ids=True):
    """doc_id, text, lang, source, n_chars and columns whose names the operators use themselves."""
    rows = [
        (i, t, ["en", "fr", None][i % 3], ["big", "big", "small", None][i % 4], len(t or ""), "x", 1, 2, 3, 4, "h", 5, True)
        for i, t in enumerate(texts())
    ]
    if with_odd_ids:
        rows += [rows[20], rows[20], (None, "lost and found again here", "en", "big", 3, *rows[0][5:]), (None, None, None, None, None, *rows[0][5:])]
    schema = f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}"
    return spark.createDataFrame(rows, schema).repartition(5)
