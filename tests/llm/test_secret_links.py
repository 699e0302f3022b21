import hashlib
import random
import re
import time

from tests.llm.conftest import DOCS, rows_of
from turnlake.llm import secret_links as S

ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]+"), re.compile(r"[0-9a-f]+")


def base(text):
    text = text or ""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if len(m[0]) >= 24]
    return sorted(out)


def linked(text):
    text, strong = text or "", base(text)
    weak = [(m.start(), 3, m.end()) for m in re.finditer(r"(?i)(?<![A-Za-z0-9_])(?:user(?:name)?|login|client_?id|account)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9._@-]{3,}", text, re.A)]
    weak += [(m.start(), 4, m.end()) for m in re.finditer(r"[A-Za-z0-9+/_-]{20,}", text) if all(re.search(c, m[0]) for c in ("[0-9]", "[a-z]", "[A-Z]"))]
    weak += [(m.start(), 5, m.end()) for m in re.finditer(r"(?i)(?<![A-Za-z0-9_])(?:https?|wss?|postgres|mysql|mongodb|redis|s3)://[^\x00-\x20\"'<>]+", text, re.A)]
    over = lambda w, others: any(o[0] < w[2] and w[0] < o[2] for o in others)
    weak = [w for w in weak if not over(w, strong)]
    weak = [w for w in weak if w[1] != 4 or not over(w, [o for o in weak if o[1] in (3, 5)])]
    role = {0: "secret", 1: "account", 2: "secret", 3: "account", 4: "secret", 5: "endpoint"}
    needs = {3: {"secret"}, 4: {"account"}, 5: {"account", "secret"}}
    ends = [w for w in weak if w[1] == 5]
    beside = lambda w: [p for p in strong + weak if abs(p[0] - w[0]) <= S.SCOPE and not over(p, [w]) and not (w[1] == 5 and role[p[1]] == "account" and over(p, ends))]
    return sorted(set(strong) | {w for w in weak if needs[w[1]] <= {role[p[1]] for p in beside(w)}})


def joined(spans):
    return ",".join(f"{S.KINDS[k]}:{a}:{b}" for a, k, b in spans)


def expected(rows):
    out = []
    for i, t in rows:
        b = base(t)
        out.append((i, *[sum(s[1] == k for s in b) for k in range(3)], hashlib.sha256(joined(b).encode()).hexdigest(), joined(linked(t))))
    return out


COLUMNS = ("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")
KEY = "AKIA" + "ABCDEFGH12345678"


def test_matches_brute_force(docs):
    rng = random.Random(3)
    bits = [KEY, "AKIAAKIA" + "Z9" * 9, "password = hunter22", 'Token:"abc"', "SECRET='a.b=c-d/e'", "api_key: token=abcdefgh", "apikey=12345", "deadbeef" * 3, "deadbeef" * 2 + "X", "user: bob.smith", "login=al", "https://db.example.com/x?y=1", "https://h/?user=bob.smith", "user=https://a.b/aB3aB3aB3aB3aB3aB3aB3", "user=aB3aB3aB3aB3aB3aB3aB3", "postgres://h:5432/d", "aB3" * 9, "aB3dE-fG/" * 4, "plain words here", "é" * 7, "😀", "\n", "passwd  =  'qwertyu'", "x" * 150, " " * 60]
    rows = [(i, rng.choice(["", " ", "\n"]).join(rng.choice(bits) for _ in range(rng.randrange(0, 40)))) for i in range(150)]
    rows += [(900, None), (901, ""), (902, (KEY + " " + "aB3" * 8 + " ") * 300), (903, "user: bob.smith " + "x " * 300 + "aB3" * 9)]
    assert rows_of(S.report(docs(*rows)).select(*COLUMNS)) == sorted(expected(rows))


def test_weak_parts_need_their_complements(docs):
    run = "aB3" * 9
    rows = [(1, run), (2, f"{KEY} {run}"), (3, f"{KEY} https://h/x"), (4, f"{KEY} {run} https://h/x"), (5, f"{KEY}{' ' * 200}{run}"), (6, f"{KEY} {'y ' * 70}{run}")]
    n = {r["doc_id"]: r["n_linked"] for r in S.report(docs(*rows)).collect()}
    assert n == {1: 0, 2: 1, 3: 0, 4: 2, 5: 0, 6: 1}


def test_a_part_never_vouches_for_itself(docs):
    alone = "user=Abcdef1234567890ABCDEFGH"
    rows = [(1, alone), (2, f"{alone} {'aB3' * 9} postgres://h/d"), (3, f"wss://h/{'aB3' * 9}"), (4, f"https://h/?user=bob {'aB3' * 9}"), (5, f"{alone} {alone}")]
    spans = {r["doc_id"]: r["spans"] for r in S.report(docs(*rows)).collect()}
    assert [spans[k] for k in (1, 3, 5)] == ["", "", ""]
    assert [x.split(":")[0] for x in spans[2].split(",")] == ["linked_account", "linked_secret", "linked_endpoint"]
    assert [x.split(":")[0] for x in spans[4].split(",")] == ["linked_account", "linked_secret"]  # the account is a piece of the endpoint


def test_repeated_rows_empty_table_and_other_columns(spark, docs):
    got = S.report(docs((1, KEY), (1, KEY))).collect()
    assert [r["n_access"] for r in got] == [1, 1] and got[0]["spans"] == "access:0:20"
    assert S.report(spark.createDataFrame([], DOCS)).count() == 0
    odd = spark.createDataFrame([(None, KEY, 5, "z")], "doc_id long, text string, spans int, base string")
    assert rows_of(S.report(odd), "doc_id", "n_access") == [(None, 1)]


def test_a_text_of_very_many_parts(docs):
    part = lambda k: f"user: u{k:06d} {'aB3xY' * 5}{k} https://h{k}/x secret=v{k:08d}\n"
    text = "".join(part(k) for k in range(25_000))
    began = time.time()
    out = S.report(docs((1, text), (2, part(0)))).collect()
    assert time.time() - began < 60
    by = {r["doc_id"]: r for r in out}
    assert by[1]["n_assign"] == 25_000 and by[1]["n_linked"] == 75_000 and by[2]["n_linked"] == 3
