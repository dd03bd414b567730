"""Small documents with every odd case, and helpers of the tests."""

import random
import re

WORDS = re.compile("[^\x20\x09-\x0d]+")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, row string, at int, lines string"


def prose(seed, n_lines, n_words=14):
    r = random.Random(seed)
    syllables = "an ti on er the re st ha in ou ble sh ed for of".split()
    line = lambda: " ".join("".join(r.choices(syllables, k=r.randint(1, 4))) for _ in range(n_words))
    return "\n".join(line() for _ in range(n_lines))


def edited(text, seed, share=0.02):
    r = random.Random(seed)
    return re.sub(r"\w+", lambda m: "edit" + str(seed) if r.random() < share else m[0], text)


def rows():
    passage = prose(77, 1, 70)
    texts = [
        None,
        "",
        " \n\t ",
        "One",
        "one two",
        "Under the MIT License.",
        "Apache License, Version 2.0; cc BY-NC 4.0. under THE mit license",
        "apache license version 3 of something",
        "£5 | Ünder the mit licénse K of licensK",
        *[prose(i, 6) for i in range(8)],
        *[prose(1, 6)] * 4,
        *[edited(prose(2, 8), i) for i in range(12)],
        *[prose(20 + i, 2) + " " + passage + " " + prose(40 + i, 2) for i in range(5)],
        prose(3, 1, 40_000),
        "same same same same\n" * 30,
        "x" * 5000 + "é" * 3000,
        "a  b   c\n\n d \n",
        "<|endoftext|> and <s> ▁marks <0x0A> 漢字 \U0001f600",
    ]
    langs = ["en", None, "de", "en"]
    made = [(i, t, langs[i % 4], f"s{i % 3}", len(t or ""), "r", i, "l") for i, t in enumerate(texts)]
    # The same row again, an id again with another text, and no id.
    made += [made[10], (11, prose(90, 3), "en", "s", 1, "r", 1, "l"), (None, prose(91, 2), "en", "s", 1, "r", 1, "l")]
    return made


def table(spark, tmp_path_factory=None, data=None):
    data = rows() if data is None else data
    return spark.createDataFrame(data, SCHEMA).coalesce(2)


def ascii_lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def groups(n, linked):
    """The smallest member of each member's group."""
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in linked:
        a, b = find(i), find(j)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]
