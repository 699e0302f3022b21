import hashlib
import random

from tests.llm.conftest import DOCS, rows_of
from turnlake.llm import line_windows
from turnlake.llm.line_windows import RUN

BLANKS = " \t\n\x0b\x0c\r"


def split(text):
    for c in BLANKS:
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def all_windows(text):
    """(kind and words, first, behind) of each window of a text."""
    lines = [w for line in (text or "").split("\n") if (w := split(line))]
    words = [w for line in lines for w in line]
    at = [sum(map(len, lines[:k])) for k in range(len(lines) + 1)]
    v = [int(hashlib.md5(w.encode()).hexdigest()[:8], 16) for w in words]
    value = [(a + 1000003 * b + 998244353 * c) % 4294967291 for a, b, c in zip(v, v[1:], v[2:])]
    starts = {0, len(words) - RUN} if len(words) >= RUN else set()
    for k, line in enumerate(lines):
        starts |= {at[k], at[k + 1] - RUN} if len(line) >= RUN else set()
    for s in range(len(words) - 2 * RUN + 2):
        starts.add(max(range(s, s + RUN), key=lambda p: (-value[p], p)))
    out = [((1, *words[p : p + RUN]), p, p + RUN) for p in starts]
    return words, sorted(out + [((2, *map(tuple, lines[k : k + 3])), at[k], at[k + 3]) for k in range(len(lines) - 2)], key=lambda x: x[1])


def brute(rows):
    """doc_id to the words that stay and the numbers of those that go, by a walk over all windows in order."""
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        words, found = all_windows(t)
        gone = set()
        for g, a, b in found:
            gone |= set(range(a, b)) if g in seen else set()
            seen.add(g)
        out[i] = ([w for k, w in enumerate(words) if k not in gone], sorted(gone))
    return out


def check(docs, rows):
    expected = brute(rows)
    got = line_windows.dedup(docs(*rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        stay, gone = expected[r["doc_id"]]
        spots = [k for span in filter(None, r["removed"].split(",")) for k in range(*map(int, span.split("-")))]
        assert (split(r["text"] or ""), spots, r["n_removed"]) == (stay, gone, len(gone)), r["doc_id"]
    return {r["doc_id"]: r["text"] for r in got}


def made(rng, n):
    return " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))


def test_matches_brute_force(docs):
    rng = random.Random(2)
    pool = [f"line {k}" for k in range(12)] + ["", "  ", "\tline  3 ", "x\r", "é b", made(rng, 30), made(rng, 60), made(rng, 25)]
    rows = [(k, "\n".join(rng.choice(pool) for _ in range(rng.randrange(0, 30)))) for k in range(120)]
    few = ["the", "of", "a", "x"]
    rows += [(200 + k, rng.choice([" ", "\n", "  "]).join(rng.choice(few) for _ in range(rng.randrange(0, 140)))) for k in range(60)]
    rows += [(None, "line 1\nline 2\nline 3\nline 4"), (500, None), (501, ""), (502, "a\nb"), (503, "same\n" * 50), (504, "\n".join(pool * 100)), (505, "long " * 4000), (506, "long " * 900)]
    check(docs, rows)


def test_later_copies_of_a_passage_go_and_clean_text_stays(docs):
    passage = "alpha one\nbeta two\ngamma three\ndelta four"
    rows = [(1, f"start\n{passage}\nend"), (2, f"other\n\n{passage}\nlast"), (3, "alpha one\nbeta two\nunlike")]
    assert check(docs, rows) == {1: rows[0][1], 2: "other\n\nlast", 3: rows[2][1]}


def test_passages_of_one_or_two_long_lines_go_whole(docs):
    rng = random.Random(1)
    one, two = made(rng, 60), made(rng, 51) + "\n" + made(rng, 30)
    rows = [(1, f"a b\n{one}\nc d"), (2, f"e f\n{one}\ng h"), (3, f"i j\n{two}\nk"), (4, f"l\n{two}\nm n")]
    assert check(docs, rows) == {1: rows[0][1], 2: "e f\ng h", 3: rows[2][1], 4: "l\nm n"}


def test_every_run_of_51_words_is_found_wherever_lines_begin(docs):
    rng = random.Random(5)
    runs = [made(rng, 51) for _ in range(150)]
    rows = [(k, f"{made(rng, rng.randrange(40))} {x} {made(rng, rng.randrange(40))}") for k, x in enumerate(runs)]
    again = [x.split() for x in runs]
    rows += [(1000 + k, f"{made(rng, rng.randrange(40))}{rng.choice(' ' + chr(10))}{' '.join(x[:20])}{rng.choice(' ' + chr(10))}{' '.join(x[20:])} {made(rng, rng.randrange(40))}") for k, x in enumerate(again)]
    texts = check(docs, rows)
    for k in range(150):
        assert texts[k] == rows[k][1]
        assert RUN <= len(rows[150 + k][1].split()) - len(texts[1000 + k].split()) <= 51


def test_lines_around_a_passage_stay_apart():
    assert line_windows.without("a\nb c\nd", [1, 3]) == ("a\nd", 2, "1-3")
    assert line_windows.without("a b c\nd", [1, 3]) == ("a \nd", 2, "1-3")
    assert line_windows.without("a b c d", [0, 2, 1, 3]) == ("d", 3, "0-3")


def test_repeated_rows_empty_table_and_other_columns(spark, docs):
    t = "a\nb\nc"
    assert [r["n_removed"] for r in line_windows.report(docs((1, t), (1, t))).collect()] == [0, 0]
    assert line_windows.report(spark.createDataFrame([], DOCS)).count() == 0
    odd = spark.createDataFrame([(1, t, "r", 1, 5), (2, f"x y\n{t}\nz", "s", 2, 7)], "doc_id long, text string, removed string, gone int, n_chars int")
    assert rows_of(line_windows.report(odd), "doc_id", "n_words", "removed") == [(1, 3, ""), (2, 6, "2-5")]
    got = line_windows.clean(odd)
    assert got.columns == odd.columns and rows_of(got) == [(1, t, "r", 1, 5), (2, "x y\nz", "s", 2, 5)]
