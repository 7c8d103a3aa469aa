"""Small document tables with nulls, empty and long texts, repeats, near copies and clashing column names."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Extra columns are named like the operators' own.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, size long, row_ string, bins_ int, positions string, kept boolean"


def prose(n, seed, vocabulary=400):
    r = random.Random(seed)
    words = ["".join(random.Random(i).choices("aeinorst", k=2 + i % 6)) + ("é" if i % 17 == 0 else "") for i in range(vocabulary)]
    out = []
    for i in range(n):
        w = words[min(int(r.paretovariate(0.7)) - 1, vocabulary - 1)]
        out.append(w.capitalize() if i % 11 == 0 else w + ("." if i % 11 == 10 else ""))
    return " ".join(out)


def documents():
    texts = {i: prose(60 + 5 * i, i) for i in range(24)}
    texts[24] = texts[3]  # a copy
    texts[25] = texts[5].replace(texts[5].split()[40], "changed", 1)  # a near copy
    texts[26] = " ".join(prose(80, 90).split()[:40] + texts[7].split()[10:75] + prose(30, 91).split())  # a shared passage
    texts[27], texts[28], texts[29] = None, "", " \t\n "
    texts[30] = prose(30_000, 92)  # very long
    texts[31] = "x\n" * 60
    texts[32] = "SHOUT!! $$$ ### " * 40
    texts[33] = "A\x1cb c d\x0be f '' it's <|endoftext|> 12 \U0001f600 ÉÀ"
    texts[34] = "one two"
    rows = [(i, t, "en", f"s{i % 4}" if i % 9 else None) for i, t in texts.items()]
    rows.append((3, texts[3], "en", "s3"))  # a repeated row
    rows.append((None, texts[2], None, "s2"))
    rows.append((None, None, None, None))
    return [(a, b, c, d, len(b or ""), 1.0, 7, "r", 3, "p", True) for a, b, c, d in rows]


def frame(spark, rows=None):
    return spark.createDataFrame(documents() if rows is None else rows, SCHEMA)


def words(text):
    return WORD.findall(text or "")


def grams(text, k=5):
    w = words(text)
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()
