"""A small documents table with everything awkward: nulls, empties, repeats, copies, clashing columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, N_WORDS long, sid string, q string"


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def rows(seed=1):
    rng = random.Random(seed)
    base = [prose(rng, rng.randint(60, 260)) for _ in range(30)]
    texts = list(base)
    for i in range(12):  # near copies: a few words changed
        words = base[i].split()
        for _ in range(rng.randint(1, 4)):
            words[rng.randrange(len(words))] = f"z{rng.randrange(50)}"
        texts.append(" ".join(words))
    texts += base[:4] + [base[0]] * 5  # copies
    passage = prose(rng, 70)
    texts += [prose(rng, 30) + "\n" + passage + " " + prose(rng, 40) for _ in range(6)]  # a shared passage
    chain = base[20].split()
    for i in range(8):  # a chain of small steps
        chain = list(chain)
        chain[(i * 7) % len(chain)] = f"c{i}"
        texts.append(" ".join(chain))
    texts += ["", "   \n ", "one", "two words", "ÉCOLE école ÉCOLE", "a\tb\x0bc", "tail 😀 emoji", "x" * 5000, prose(rng, 6000, 3000), "same line\nsame line\nother", "a b c d e " * 6]
    out = [(i, t, rng.choice(["en", "de", None]), rng.choice(["s0", "s0", "s1", None]), len(t), 7, "x", "y") for i, t in enumerate(texts)]
    out += [(1000, None, "en", "s0", None, None, None, None), (None, base[1], "en", "s0", 3, None, None, None), out[3], out[3]]
    return out


def frame(spark, seed=1):
    return spark.createDataFrame(rows(seed), SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
