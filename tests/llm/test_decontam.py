import hashlib
import random
import re
import sys

from pyspark.sql import functions as F

from tests.llm.conftest import DOCS, rows_of
from turnlake.llm import common, decontam
from turnlake.operators import bloom

ITEMS = "item_id long, text string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))


def brute(docs, items):
    windows = {}
    for i, t in items:
        w = words(t)
        for k in range(max(len(w) - 12, 1) if w else 0):
            windows.setdefault(tuple(w[k : k + 13]), set()).add(i)
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for g, who in windows.items():
            for p in range(len(w) - len(g) + 1):
                if tuple(w[p : p + len(g)]) == g:
                    hit |= set(range(p, p + len(g)))
                    found |= who
        names = sorted(str(i) for i in found if i is not None)
        out.append((d, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=lambda r: (r[0] is not None, r[0]))


def tables(spark, docs, items):
    return spark.createDataFrame([(d, t, "en", "s", 0) for d, t in docs], DOCS), spark.createDataFrame(items, ITEMS)


def sample():
    rng = random.Random(4)
    vocabulary = ["the", "of", "and", "Éa", "éa", "x1", "zz", "Straße", "量", "rare" + "y"] + [f"w{k}" for k in range(30)]
    text = lambda n: rng.choice([" ", ", ", "-"]).join(rng.choice(vocabulary) for _ in range(n))
    items = [(k, text(rng.choice([1, 2, 5, 12, 13, 14, 30]))) for k in range(40)] + [(90, None), (91, "..."), (92, "the the the the"), (93, items_of := text(20)), (94, items_of), (None, text(15)), (95, "of")]
    docs = []
    for k in range(120):
        parts = [text(rng.randrange(0, 60))]
        for _ in range(rng.randrange(0, 3)):
            w = (rng.choice(items)[1] or "").upper()
            parts += [w, text(rng.randrange(0, 40))]
        docs.append((k, " ".join(parts)))
    return docs + [(500, None), (501, ""), (502, "the " * 3000), (503, items_of), (None, items_of)], items


def test_matches_brute_force(spark):
    docs, items = sample()
    assert rows_of(decontam.report(*tables(spark, docs, items))) == brute(docs, items)


def test_matches_brute_force_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_BYTES", -1)
    docs, items = sample()
    assert rows_of(decontam.report(*tables(spark, docs, items))) == brute(docs, items)


def test_the_stage_keeps_clean_rows_whole(spark):
    item = " ".join(f"q{k}" for k in range(20))
    docs, items = tables(spark, [(1, item), (2, "clean text"), (3, item + " filler" * 1000), (4, None)], [(7, item)])
    odd = docs.withColumn("n_hit", docs.doc_id).withColumn("w", docs.lang)
    left = decontam.decontaminate(odd, items)
    assert left.columns == odd.columns and rows_of(left, "doc_id") == [(2,), (3,), (4,)]


def test_empty_tables_and_repeated_rows(spark):
    docs, items = tables(spark, [], [(1, "a b")])
    assert decontam.report(docs, items).count() == 0
    docs, items = tables(spark, [(1, "a b"), (1, "a b"), (1, "c")], [])
    assert rows_of(decontam.report(docs, items), "doc_id", "n_hit") == [(1, 0)] * 3
    docs, items = tables(spark, [(1, "a b"), (1, "a b"), (1, "c")], [(5, "a b"), (5, "a b")])
    assert rows_of(decontam.report(docs, items), "doc_id", "n_hit", "n_items") == [(1, 0, 0), (1, 2, 1), (1, 2, 1)]


def test_null_ids_and_texts_that_share_an_id_are_judged_apart(spark):
    docs, items = tables(spark, [(None, "a b"), (None, "a b"), (None, "x a b"), (None, "c"), (1, "c"), (1, "a b")], [(5, "a b")])
    assert rows_of(decontam.report(docs, items), "doc_id", "n_hit", "n_words") == [(None, 0, 1), (None, 2, 2), (None, 2, 2), (None, 2, 3), (1, 0, 1), (1, 2, 2)]
    assert rows_of(decontam.decontaminate(docs, items), "doc_id", "text") == [(None, "c"), (1, "c")]


def test_only_ascii_capitals_are_lowered(spark):
    """Every code point alone and within a word, among them letter numbers and circled letters."""
    points = spark.range(0x80, sys.maxunicode + 1).where("id < 55296 or id > 57343")
    text = points.select("id", F.expr("decode(unhex(lpad(hex(id), 8, '0')), 'UTF-32')").alias("c")).select("id", F.concat(F.lit("aB"), "c", F.lit("Cd")).alias("text"), F.concat(F.lit("ab"), "c", F.lit("cd")).alias("low"))
    assert text.where(F.lower("text") != F.col("low")).count() > 1300
    assert text.where(common.lower_ascii(F.col("text")) != F.col("low")).count() == 0
    docs, items = tables(spark, [(1, "kapitel Ⅳ ende"), (2, "Kapitel ⅳ ENDE")], [(9, "kapitel ⅳ ende")])
    assert rows_of(decontam.report(docs, items), "doc_id", "n_hit") == [(1, 0), (2, 3)]


def test_the_filter_passes_all_keys_and_few_others(spark, monkeypatch):
    keys = spark.range(200_000).select(F.xxhash64("id").alias("h"))
    pages = bloom.built(keys, 200_000)
    asked = spark.range(400_000)
    passed = bloom.possible(asked, F.xxhash64("id"), pages, 200_000)
    assert passed.where("id < 200000").count() == 200_000 and passed.where("id >= 200000").count() < 2000
    assert pages.count() == bloom.pages_for(200_000) and pages.where("size(bits) <> 1024").count() == 0
    assert bloom.pages_for(10**12) == bloom.MOST_PAGES and bloom.pages_for(0) == 1
    monkeypatch.setattr(bloom, "MOST_PAGES", 2)  # too small a filter lets more pass, but loses none
    assert bloom.possible(asked, F.xxhash64("id"), bloom.built(keys, 200_000), 200_000).where("id < 200000").count() == 200_000
