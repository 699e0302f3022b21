import random
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from turnlake import registry
from turnlake.operators import similarity
from turnlake.plans.adapters import Model

sys.path.insert(0, str(Path(__file__).resolve().parent.parent / "tools"))
from compare import TABLES, value  # noqa: E402

SF = "/root/testdata/sf0.001"
#: Results that depend on an order of decisions, which SQL does not express.
NO_SQL = {"document_clusters", "clusters", "candidates"}


@pytest.fixture(scope="module")
def con():
    out = duckdb.connect()
    for t in TABLES:
        out.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return out


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_matches_sql(spark, con, name):
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = con.execute(registry.ORACLES[name])
    theirs = [d[0] for d in got.description]
    assert sorted(theirs) == columns
    at = [theirs.index(c) for c in columns]
    assert sorted(tuple(value(r[c]) for c in columns) for r in df.collect()) == sorted(tuple(value(r[k]) for k in at) for r in got.fetchall())


def test_every_query_has_sql_but_for_the_known_few():
    assert registry.QUERIES.keys() - registry.ORACLES.keys() == NO_SQL and not registry.ORACLES.keys() - registry.QUERIES.keys()
    assert entry.queries().keys() >= registry.QUERIES.keys()


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def greedy(sets):
    """sets: (id, tokens) in order; each joins the first similar seed."""
    seeds, out = [], {}
    for i, s in sets:
        hit = next((j for j, t in seeds if 100 * len(s & t) >= 45 * len(s | t)), None)
        if hit is None:
            seeds.append((i, s))
        out[i] = hit if hit is not None else i
    return out


def test_clusters_match_the_greedy_walk(spark):
    docs = Model(spark, "/root/testdata/sf0.01").documents
    from turnlake.plans.mining import _clustered
    from pyspark.sql import functions as F

    rows = similarity.items(docs, [F.col("uuid").alias("uuid")]).select("uuid", "tokens", "n").collect()
    sets = [(r["uuid"], set(r["tokens"])) for r in sorted(rows, key=lambda r: (-r["n"], r["uuid"]))]
    got = {r["uuid"]: r["seed"] for r in _clustered(docs, [F.col("uuid").alias("uuid")]).collect()}
    assert got == greedy(sets)


def test_phrases_drop_parts_of_equal_reach(spark):
    found = spark.createDataFrame([("a b", 5, 9), ("a b c", 5, 9), ("b c", 5, 8), ("x y", 4, 4)], "phrase string, sessions long, n long")
    assert [r["phrase"] for r in similarity.pruned(found).collect()] == ["a b c", "x y"]
    assert [r["phrase"] for r in similarity.pruned(found, limit=1).collect()] == ["a b c"]


def walk(rows):
    """What is kept of (phrase, sessions, n) by going through them in order."""
    kept = []
    for p, s, n in sorted(rows, key=lambda r: (-r[1], -r[2], -len(r[0]), r[0])):
        if not any(p in q and t == s for q, t, _ in kept):
            kept.append((p, s, n))
    return kept


@pytest.mark.parametrize("shortest", [1, 3])
def test_phrases_cut_within_tokens(spark, shortest):
    rng = random.Random(shortest)
    tokens = ["".join(rng.choice("ab") for _ in range(rng.randrange(shortest, 6))) for _ in range(30)]
    rows = {" ".join(rng.choice(tokens) for _ in range(rng.randrange(2, 5))): (rng.randrange(4, 6), rng.randrange(9)) for _ in range(2000)}
    rows = [(p, *x) for p, x in rows.items()]
    assert [tuple(r) for r in similarity.pruned(spark.createDataFrame(rows, "phrase string, sessions long, n long"), 10**6).collect()] == walk(rows)


def test_phrases_of_very_long_tokens(spark):
    x, y, z = "x" * 10_000, "y" * 9_000 + "z", "ab" * 5_000
    rows = [(" ".join(t), 4, k) for k, t in enumerate([(x, y), (x, y, z), (y, z), ("x" * 100, "y" * 50), ("foo", "bar"), (z, z, z, z)])]
    assert [tuple(r) for r in similarity.pruned(spark.createDataFrame(rows, "phrase string, sessions long, n long")).collect()] == walk(rows)


def test_clusters_phrases_and_candidates_match_plain_code(spark):
    from collections import Counter, defaultdict

    from pyspark.sql import functions as F

    from turnlake.filters import EVERYTHING
    from turnlake.functions import text
    from turnlake.plans import mining

    m = Model(spark, "/root/testdata/sf0.01")
    rows = mining._human(m, EVERYTHING).select("uuid", "session_id", "ts", "is_slash", text.content_tokens(F.col("text")).alias("t")).collect()
    sets = [(r["uuid"], set(r["t"][:120]), r["ts"]) for r in rows if not r["is_slash"]]
    sets = sorted((x for x in sets if len(x[1]) >= 6), key=lambda x: (-len(x[1]), x[2], x[0]))
    session, members = {r["uuid"]: r["session_id"] for r in rows}, defaultdict(list)
    for uuid, seed in greedy([x[:2] for x in sets]).items():
        members[seed].append(uuid)
    wide = {(seed, len(us), len({session[u] for u in us})) for seed, us in members.items() if len(us) >= 3}
    assert wide and {(r["seed"], r["size"], r["sessions"]) for r in mining.clusters(m).collect()} == wide

    n, reach, kept = Counter(), defaultdict(set), []
    for r in rows:
        for k in (2, 3, 4):
            for i in range(len(r["t"]) - k + 1):
                phrase = " ".join(r["t"][i : i + k])
                n[phrase] += 1
                reach[phrase].add(r["session_id"])
    for p in sorted((p for p in n if len(reach[p]) >= 4), key=lambda p: (-len(reach[p]), -n[p], -len(p), p)):
        if not any(p in q and len(reach[q]) == len(reach[p]) for q in kept):
            kept.append(p)
    assert [(r["phrase"], r["sessions"], r["n"]) for r in mining.phrases(m).collect()] == [(p, len(reach[p]), n[p]) for p in kept[:60]]

    repeats = [(r["sessions"], r["size"], r["key"]) for r in mining.families(m).collect()]
    best = [("cluster", seed, k * s) for seed, k, s in sorted(wide, key=lambda x: (-x[2], -x[1], x[0]))[:25]]
    best += [("repeat", key, 2 * k * s) for s, k, key in sorted(repeats, key=lambda x: (-x[0], -x[1], x[2]))[:25]]
    assert [(r["kind"], r["name"], r["score"]) for r in mining.candidates(m).collect()] == sorted(best, key=lambda x: (-x[2], x[0], x[1]))[:30]


def test_pairs_that_share_a_vocabulary_only_are_never_written(spark, monkeypatch):
    """Sets over few tokens meet in most of them, but few are similar."""
    rng, cut, written = random.Random(7), similarity.cut, {}

    def counted(df, name):
        out = cut(df, name)
        written[name] = written.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(similarity, "cut", counted)
    words = [f"w{i}" for i in range(300)]
    bases = [set(rng.sample(words, 100)) for _ in range(300)]
    sets = bases + [set(rng.sample(sorted(s), 80)) | set(rng.sample(words, 15)) for s in bases[:30]]
    rows = [(i, sorted(s), len(s)) for i, s in enumerate(sets)]
    found = spark.createDataFrame(rows, "uuid long, tokens array<string>, n int").selectExpr("uuid", "tokens", "n", "struct(-n AS less, uuid AS uuid) AS order")
    true = {(i, j, len(s & t)) for i, s in enumerate(sets) for j, t in enumerate(sets[:i]) if 100 * len(s & t) >= 45 * len(s | t)}
    assert len(true) >= 30 and {(max(r[:2]), min(r[:2]), r[2]) for r in similarity.jaccard_pairs(found).collect()} == true
    assert written["candidates"] <= 2 * len(true)


def test_similar_documents_are_one_row_each(spark):
    """Copies and families of near copies: links are counted, not listed."""
    from types import SimpleNamespace

    from turnlake.plans import mining

    rng = random.Random(11)
    words = ["".join(rng.choices("bcdfgmprtk", k=7)) for _ in range(400)]
    base, other = rng.sample(words, 60), rng.sample(words, 8)
    near = [[w if rng.random() > 0.15 else rng.choice(words) for w in base] for _ in range(25)]
    texts = [base] * 40 + [base[::-1]] + near + [other] * 3 + [rng.sample(words, rng.randrange(6, 90)) for _ in range(40)] + [words[:5]] * 2 + [[]]
    order = rng.sample(range(1000), len(texts))
    documents = spark.createDataFrame([(u, u % 3, " ".join(t)) for u, t in zip(order, texts)], "uuid long, session_id long, text string")
    sets = {u: frozenset(t) for u, t in zip(order, texts) if len(set(t)) >= 6}
    true = {}
    for u in order:
        alike = {v: len(sets[u] & sets[v]) for v in sets if v != u and 100 * len(sets[u] & sets[v]) >= 45 * len(sets[u] | sets[v])} if u in sets else {}
        same = [v for v in sets if sets[v] == sets.get(u)]
        true[u] = (min(same, default=None), len(same), len({sets[v] for v in alike} - {sets.get(u)}), len(alike), sum(alike.values()))
    rows = mining.jaccard_pairs(SimpleNamespace(documents=documents)).collect()
    assert len(rows) == len(texts) and {r["uuid"]: (r["class"], r["copies"], r["classes"], r["links"], r["shared"]) for r in rows} == true
    assert max(x[3] for x in true.values()) >= 60


def test_places_of_sets_are_shuffled_once(spark, monkeypatch):
    """Near copies meet in nearly all their tokens; both sides of the join take one shuffle, and no pair is lost."""
    rng = random.Random(3)
    base = [f"w{i}" for i in range(100)]
    rows = [(i, sorted([w for w in base if rng.random() > 0.06] + [f"x{i}"])) for i in range(60)]
    found = spark.createDataFrame(rows, "uuid long, tokens array<string>").selectExpr("uuid", "tokens", "size(tokens) AS n", "struct(-size(tokens) AS less, uuid AS uuid) AS order")
    plans, cut = [], similarity.cut

    def planned(df, name):
        if name == "candidates":
            df.collect()
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return cut(df, name)

    monkeypatch.setattr(similarity, "cut", planned)
    got = {tuple(sorted(r[:2])) for r in similarity.jaccard_pairs(found).collect()}
    assert got == {(i, j) for i in range(60) for j in range(i + 1, 60)}
    final = plans[0].split("Initial Plan")[0]
    assert final.count("ReusedExchange") == 2


def test_documents_cluster_by_their_whole_texts(spark):
    """Texts that begin alike aren't similar if they go on differently."""
    from types import SimpleNamespace

    from turnlake.plans import mining

    rng = random.Random(5)
    words = ["".join(rng.choices("bcdfgmprtk", k=7)) for _ in range(4000)]
    start = words[:130]
    texts = [start + rng.sample(words[130:], 600) for _ in range(8)]
    texts += [[w for w in texts[0] if rng.random() > 0.1] for _ in range(4)]
    documents = spark.createDataFrame([(u, f"s{u % 3}", " ".join(t)) for u, t in enumerate(texts)], "uuid long, session_id string, text string")
    assert [tuple(r) for r in mining.document_clusters(SimpleNamespace(documents=documents)).collect()] == [(0, 5, 3)]


def test_large_sets_that_share_a_vocabulary_are_compared_before_they_are_written(spark, monkeypatch):
    """Parities grow with the sets, and no similar pair is lost."""
    rng, cut, written = random.Random(9), similarity.cut, {}

    def counted(df, name):
        out = cut(df, name)
        written[name] = written.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(similarity, "cut", counted)
    words = [f"w{i}" for i in range(6000)]
    bases = [set(rng.sample(words, 1000)) for _ in range(60)]
    # Near ones of all sizes that allow the similarity.
    sets = bases + [set(rng.sample(sorted(s), rng.randrange(440, 990))) | set(rng.sample(words, 20)) for s in bases[:30]]
    rows = [(i, sorted(s), len(s)) for i, s in enumerate(sets)]
    found = spark.createDataFrame(rows, "uuid long, tokens array<string>, n int").selectExpr("uuid", "tokens", "n", "struct(-n AS less, uuid AS uuid) AS order")
    true = {(i, j, len(s & t)) for i, s in enumerate(sets) for j, t in enumerate(sets[:i]) if 100 * len(s & t) >= 45 * len(s | t)}
    assert len(true) >= 25 and {(max(r[:2]), min(r[:2]), r[2]) for r in similarity.jaccard_pairs(found).collect()} == true
    assert written["candidates"] <= 10 * len(true) and written["likely"] <= 2 * len(true)


@pytest.mark.parametrize("sessions", [6, 64, 65, 90])
def test_phrases_count_sessions_that_are_known(spark, sessions):
    """Sessions as bits (all 64 of them) and as parts; prompts without a session count, but are of none."""
    from collections import Counter, defaultdict

    rng = random.Random(sessions)
    words = ["alpha", "bravo", "charlie", "delta", "echo"]
    rows = [(f"s{k % sessions}" if k % 9 else None, " ".join(rng.choices(words, k=5))) for k in range(4 * sessions)]
    rows += [(f"s{k}", "lima mike") for k in range(3)] + [(None, "lima mike")] + [(f"s{k}", "oscar papa") for k in range(sessions)]
    n, reach = Counter(), defaultdict(set)
    for session, said in rows:
        t = said.split()
        for k in (2, 3, 4):
            for i in range(len(t) - k + 1):
                n[" ".join(t[i : i + k])] += 1
                reach[" ".join(t[i : i + k])] |= {session} - {None}
    found = similarity.phrases(spark.createDataFrame(rows, "session_id string, text string"))
    assert {tuple(r) for r in found.select("phrase", "sessions", "n").collect()} == {(p, len(reach[p]), n[p]) for p in n if len(reach[p]) >= 4}
    assert len(reach["lima mike"]) == 3 and len(reach["oscar papa"]) == sessions
