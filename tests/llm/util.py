"""Small tables with everything that may come, and brute-force versions."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rid long, rank int, node string, kept boolean, n int, value string, row string, a int"


def words(t):
    return WORD.findall(t or "")


def vocabulary(seed, n=400):
    r = random.Random(seed)
    return ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 7))) for _ in range(n)]


def prose(r, vocab, n, line=12):
    w = [r.choice(vocab) for _ in range(n)]
    return "\n".join(" ".join(w[i : i + line]) for i in range(0, n, line))


def corpus(seed=0, n=60):
    """(doc_id, text, lang, source): originals, exact and near copies, shared passages, and odd cases."""
    r = random.Random(seed)
    v = vocabulary(seed)
    passage = prose(r, v, 70, 35)
    rows = []
    base = [prose(r, v, r.choice([20, 60, 120, 250])) for _ in range(n // 3)]
    for t in base:
        rows.append(t)
        rows.append(t if r.random() < 0.4 else t.replace(" ", " X ", 1) if r.random() < 0.5 else prose(r, v, 30) + "\n" + passage)
        k = t.split(" ")
        k[len(k) // 2] = "changed"
        rows.append(" ".join(k))
    rows += ["", None, " \n\t ", "one", "two words", "a b c d", "A B C D", "é ü 😀 日本語 と", "x\r\ny\x0bz", "same same same same same same same", passage, passage + "\n" + passage]
    out = [(i, t, r.choice(["en", "de", None]), r.choice(["s1", "s1", "s1", "s2", None])) for i, t in enumerate(rows)]
    out += [(None, base[0], "en", "s1"), (None, "null id text here for all", None, None), out[3], out[3]]
    r.shuffle(out)
    return out


def frame(spark, rows, parts=3):
    """With extra columns whose names clash with what operators use inside."""
    full = [(i, t, lang, s, None if t is None else len(t), 7, 1, "n", True, 3, "v", "r", None) for i, t, lang, s in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(parts)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def long_text(n=120_000):
    return " ".join(f"w{i % 997}x{i % 31}" for i in range(n))
