import hashlib
import random

from tests.llm.conftest import rows_of
from turnlake.llm import substring

BLANKS = " \t\n\x0b\x0c\r"


def split(text):
    for c in BLANKS:
        text = (text or "").replace(c, " ")
    return [w for w in text.split(" ") if w]


def brute(rows, window):
    """(doc_id, n_words, n_removed, kept words' hash) by a walk over all windows."""
    first = {}
    key = lambda i: (i is not None, i)
    for i, t in rows:
        w = split(t)
        for s in range(len(w) - window + 1):
            g = tuple(w[s : s + window])
            first[g] = min(first.get(g, i), i, key=key)
    out = []
    for i, t in rows:
        w = split(t)
        gone = {p for s in range(len(w) - window + 1) if key(first[tuple(w[s : s + window])]) < key(i) for p in range(s, s + window)}
        kept = " ".join(x for p, x in enumerate(w) if p not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=lambda t: tuple((x is not None, x) for x in t))


def found(df):
    return rows_of(df, "doc_id", "n_words", "n_removed", "kept_sha256")


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def test_against_brute_force(docs):
    rng = random.Random(3)
    passage, other = words(rng, 130), words(rng, 60)
    rows = []
    for i in range(60):
        body = words(rng, rng.randrange(0, 150))
        if i % 3 == 0:  # a passage many share, cut at either end, between unlike neighbours
            a, b = rng.randrange(0, 40), rng.randrange(90, 131)
            body[10:10] = passage[a:b]
        if i % 5 == 0:
            body += other
        if i % 7 == 0 and rows:  # a near copy of an earlier one
            body = split(rows[rng.randrange(len(rows))][1])
            if body:
                body[rng.randrange(len(body))] = "edited"
        if i % 11 == 0:
            body += ["ha"] * rng.randrange(40, 90)
        if i % 13 == 0:
            body += body  # repeats within a document stay
        rows.append((i // 2 if i > 50 else i, rng.choice(BLANKS).join(body)))
    assert found(substring.report(docs(*rows))) == brute(rows, 50)


def test_edges_of_the_window(docs):
    rng = random.Random(5)
    p = words(rng, 60)
    rows = [(1, " ".join(["a", *p[:50], "b"])), (2, " ".join(["c", *p[:50], "d"])), (3, " ".join(["e", *p[:49], "f"])), (4, " ".join(p[:50])), (5, " ".join(p)), (6, " ".join(p[1:])), (7, " ".join(p[1:51]))]
    out = found(substring.report(docs(*rows)))
    assert out == brute(rows, 50)
    assert [r[2] for r in out] == [0, 50, 0, 50, 50, 59, 50]


def test_borders_of_a_passage_with_many_partners(docs):
    """Documents that agree with different partners to the left and to the right."""
    rng = random.Random(7)
    p = words(rng, 100)
    rows = [(1, " ".join(["x"] * 5 + p[20:80])), (2, " ".join(p[:75] + ["y"] * 9)), (3, " ".join(["z"] * 3 + p[25:])), (4, " ".join(p)), (5, " ".join(["q", *p[5:95], "r"]))]
    assert found(substring.report(docs(*rows))) == brute(rows, 50)


def test_nulls_repeats_and_short_texts(docs):
    rng = random.Random(9)
    p = " ".join(words(rng, 70))
    rows = [(None, p), (1, p), (1, p), (2, None), (3, ""), (4, " \n "), (5, "short"), (5, p + " more"), (None, p + " tail")]
    assert found(substring.report(docs(*rows))) == brute(rows, 50)
    assert substring.report(docs(*rows).limit(0)).count() == 0


def test_only_nulls(docs):
    assert found(substring.report(docs((1, None), (None, None)))) == brute([(1, None), (None, None)], 50)


def test_texts_and_columns_stay(docs, spark):
    rng = random.Random(11)
    p = words(rng, 60)
    table = docs((1, "one " + " ".join(p)), (2, "two\n" + " ".join(p) + "\nend"), (3, "three words here"))
    clash = table.selectExpr("*", "1 AS gone", "2 AS h1", "3 AS TEXT2", "4 AS version", "5 AS removed")
    out = {r["doc_id"]: r for r in substring.clean(clash).collect()}
    assert substring.clean(clash).columns == clash.columns
    assert out[2]["text"] == "two\nend" and out[2]["n_chars"] == 7 and out[2]["gone"] == 1 and out[2]["removed"] == 5
    assert out[1]["text"].startswith("one w") and out[3]["text"] == "three words here"
    spans = {r["doc_id"]: r["removed"] for r in substring.dedup(table).collect()}
    assert spans == {1: "", 2: "1-61", 3: ""}


def test_a_long_text(docs):
    rng = random.Random(13)
    long = words(rng, 200_000, 5000)
    out = found(substring.report(docs((1, " ".join(long)), (2, " ".join(long[1000:150_000] + ["x"])), (3, "ha " * 100_000))))
    assert [r[2] for r in out] == [0, 149_000, 0]


def test_groups_of_any_size_make_no_pairs(docs, spark):
    rng = random.Random(15)
    p = words(rng, 90)
    rows = [(i, " ".join([f"h{i}"] * 3 + p + [f"t{i}"] * 3)) for i in range(300)]
    out = found(substring.report(docs(*rows)))
    assert [r[2] for r in out] == [0] + [90] * 299
