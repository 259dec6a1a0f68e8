import random
import re

from tests.llm.util import corpus, empty, frame, long_text, prose, vocabulary

from skarn.llm.units import dedup_units, unit_dedup

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


PUNCTUATION = re.compile("[!-/:-@\\[-`{-~]")
PIECE = re.compile(r"([^\x20\x09-\x0D]+)([\x20\x09-\x0D]*)")


def sentences(t):
    """(start, end, normalised words) of the sentences of a text that have words."""
    out, now, start = [], [], None
    pieces = list(PIECE.finditer(t))
    for k, m in enumerate(pieces):
        start = m.start() if start is None else start
        now += [w for w in [PUNCTUATION.sub("", m[1].translate(LOWER))] if w]
        if m[1][-1] in ".!?。！？" or "\n" in m[2] or k == len(pieces) - 1:
            if now:
                out.append((start, m.end(), now))
            now, start = [], None
    return out


def paragraphs(t, least):
    s = sentences(t)
    weight = lambda w: sum(1 + len(x) // 16 for x in w)
    for a in range(len(s)):
        w = []
        for b in range(a, len(s)):
            w += s[b][2]
            if weight(w) >= least or a == 0 and b == len(s) - 1:
                yield a, s[a][0], s[b][1], tuple(w)
                break


def brute(rows, least=16):
    big = 2**63 - 1
    first: dict = {}
    for i, t, *_ in rows:
        for n, _, _, w in paragraphs(t or "", least):
            first[w] = min(first.get(w, (big + 1, 0)), (big if i is None else i, n))
    out = []
    for i, t, *_ in rows:
        t = t or ""
        gone = {p for n, x, y, w in paragraphs(t, least) if first[w] < (big if i is None else i, n) for p in range(x, y)}
        spans = [p for p in sorted(gone) if p - 1 not in gone], [p + 1 for p in sorted(gone) if p + 1 not in gone]
        out.append((i, len(spans[0]), " ".join(f"{x}-{y}" for x, y in zip(*spans)), "".join(c for p, c in enumerate(t) if p not in gone)))
    return sorted(out, key=str)


def test_against_brute_force(spark):
    rows = corpus(3, 60) + [(900, long_text(20_000), "en", "s1"), (901, "É " * 17 + "\n" + "é " * 17 + "\n" + "E " * 17 + "\n" + "e " * 17, "", ""), (902, "一 " * 20 + "二。 " + "e - " * 17 + "--\n ...\n" + "E " * 16, "", "")]
    rows = [r for r in rows if r[0] is not None] + [(None, "null id text that has at least eight words here", None, None)]
    got = sorted(((r.doc_id, r.n_removed, r.removed, r.text) for r in unit_dedup(frame(spark, rows)).collect()), key=str)
    assert got == brute(rows)


def test_rows_pass_through(spark):
    out = dedup_units(frame(spark, [(1, None, None, None)])).first()
    assert out.row.text is None and out.row.rank == 1 and out.kept_text == "" and out.spans == []


def test_empty(spark):
    assert unit_dedup(empty(spark)).count() == 0


def test_passages_within_lines_are_caught_and_stock_lines_stay(spark):
    """Passages of over 50 words set into the middle of lines, re-broken and re-marked; documents that share a short line only."""
    r = random.Random(5)
    v = vocabulary(5)
    say = lambda n: " ".join(prose(r, v, r.randint(4, 14), 99).capitalize() + "." for _ in range(n))
    passages = [" ".join(prose(r, v, k, 99).capitalize() + "." for k in (9, 12, 7, 14, 12)) for _ in range(8)]
    changed = lambda p: p.replace(". ", "!\n", 1).replace(". ", " .\n ", 1).upper()
    stock = prose(r, v, 13, 99)
    clean = [(i, f"{say(8)}\n{stock}\n{say(6)}", "", "") for i in range(40)]
    holders = [(100 + 2 * k + j, f"{say(5)} {prose(r, v, 6, 99)} {changed(p) if j else p} {say(6)}", "", "") for k, p in enumerate(passages) for j in (0, 1)]
    out = {x.doc_id: x for x in unit_dedup(frame(spark, clean + holders)).collect()}
    assert all(out[i].n_removed == 0 for i, *_ in clean)
    assert all(out[100 + 2 * k].n_removed == 0 and out[101 + 2 * k].n_chars_removed > 0.6 * len(passages[k]) for k in range(len(passages)))


def test_a_hot_unit_is_dealt_over_salts(spark):
    line = " ".join(f"w{k}" for k in range(20))
    rows = [(i, f"own{i} " * 20 + "\n" + line, "", "") for i in range(6000)]
    out = unit_dedup(frame(spark, rows)).groupBy("n_removed").count().collect()
    assert {x.n_removed: x["count"] for x in out} == {0: 1, 1: 5999}


def test_short_texts_and_texts_without_spaces(spark):
    glyphs = "".join(chr(0x4E00 + k * 37 % 5000) for k in range(5000))
    short = "Twelve words stand in this text, and it ends with them here"
    rows = [(1, short, "", ""), (2, short.upper() + " !", "", ""), (3, glyphs, "", ""), (4, glyphs, "", ""), (5, glyphs[:100], "", ""), (6, glyphs[:100], "", ""), (7, "one", "", ""), (8, "two", "", ""), (9, "... !", "", ""), (10, "... !", "", ""),
            (11, f"A longer text that holds the short one too, and says more than it does. {short}. And on it goes for some more words than before.", "", "")]
    got = {r.doc_id: (r.n_removed, r.text) for r in unit_dedup(frame(spark, rows)).collect()}
    assert got[2] == (1, "") and got[4] == (1, "") and got[6] == (1, "")
    assert all(got[i] == (0, t) for i, t, *_ in rows if i not in (2, 4, 6))
    assert sorted(((i, n, t) for i, (n, t) in got.items()), key=str) == sorted(((i, n, t) for i, n, _, t in brute(rows)), key=str)
