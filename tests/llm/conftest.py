"""A small corpus with every awkward case: nulls, empty and blank texts, a long text, near and exact copies, repeated rows, columns with clashing names."""

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, k long, h string, found string, key string, line string, n_words string, node long"


def pattern(n, a, b):
    """The first n letters of the Thue-Morse sequence over a and b: those that start with a and with b have equal polynomial hashes modulo 2**64."""
    return "".join(b if bin(i).count("1") % 2 else a for i in range(n))


def rows(seed=5):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 6))) for _ in range(400)]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    license_line = "Licensed under the  Common Terms, see notice."
    passage = say(70)
    out = []
    for i in range(60):
        text = "\n".join(say(rng.randint(3, 30)) for _ in range(rng.randint(1, 6)))
        if i % 4 == 0:
            text += "\n" + ("\t" + license_line.upper() if i % 8 else license_line + " ")
        if i % 7 == 0:
            text = text + " " + passage + "\n" + say(5)
        out.append([i * 3, text])
    base = say(200).split()
    for j in range(12):  # near copies: a few words changed
        w = list(base)
        for _ in range(j // 2):
            w[rng.randrange(len(w))] = "x%d" % rng.randrange(99)
        out.append([500 + j, " ".join(w)])
    for j in range(5):
        out.append([600 + j, out[3][1]])
    out += [[700, None], [701, ""], [702, " \n\t "], [703, "one two"], [704, "ONE two"], [705, "one\ttwo\n"], [706, "word " * 9000 + say(3000)]]
    out += [[707, "a b c d e f a b c d e f # $ % & |"], [708, "<|endoftext|> A'll we've İ ﬁ e\u0301 \u00a0 x<|startoftext|>y 中文字 12 3\u2003z"], [709, "x" * 5000], [None, "no id here at all"], [None, None]]
    for j, n in enumerate((1024, 2048, 4096)):
        out += [[720 + 2 * j, say(12) + " " + pattern(n, "a", "b")], [721 + 2 * j, pattern(n, "b", "a")]]
        out += [[730 + 2 * j, out[-2][1].rsplit(" ", 1)[0] + " " + out[-1][1]], [731 + 2 * j, " ".join(pattern(n // 16, "a", "b"))], [740 + j, " ".join(pattern(n // 16, "b", "a"))]]
    out += [list(out[0]), list(out[0]), [out[1][0], "another text under one id " + say(20)]]
    return [(d, t, "en", "s", len(t or ""), 1, "h", "f", "k", "l", "n", 7) for d, t in out]


@pytest.fixture(scope="session")
def corpus():
    return rows()


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
