import pytest
from pyspark.sql import functions as F

from turnlake.functions import paths, pricing, text, times


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first()["y"]


def test_git_output(spark):
    out = "[release/9 beefcafe12] Ship carts\n 1 file changed, 7 insertions(+)\nTo ssh://git.example.org/carts\nsee http://git.example.org/carts/merge_requests/5 and again /carts/merge_requests/5"
    c = one(spark, out, text.commits)[0]
    assert (c["sha"], c["branch"], c["subject"], c["files"], c["insertions"], c["deletions"]) == ("beefcafe12", "release/9", "Ship carts", 1, 7, 0)
    assert one(spark, out, text.pushes) == ["ssh://git.example.org/carts"]
    assert one(spark, out, text.pull_requests) == ["http://git.example.org/carts/merge_requests/5"]


def test_counts_belong_to_a_commit_only_nearby(spark):
    out = "[a 1111111] one\n" + "x" * 500 + "\n[b 2222222] two\n 1 file changed, 1 insertion(+)\n[a 1111111] again\n 9 files changed"
    got = [(c["sha"], c["files"], c["insertions"], c["deletions"]) for c in one(spark, out, text.commits)]
    assert got == [("1111111", 0, 0, 0), ("2222222", 1, 1, 0)]
    assert one(spark, "[main (root-commit) abc1234] x", text.commits) == [] and one(spark, None, text.commits) == []


def test_tickets_need_a_word_like_prefix(spark):
    assert set(one(spark, "SHOP-7, RFC-822 and Q2-3; (WEB2-12) sha-1 ISO-9001 lower-5 Z-9", text.tickets)) == {"SHOP-7", "WEB2-12"}


@pytest.mark.parametrize(
    ("raw", "clean", "slash"),
    [
        ("<command-name>/commit</command-name><command-args>-m x</command-args>", "/commit -m x", "/commit"),
        ("hi <system-reminder>secret</system-reminder> there", "hi  there", None),
        ("<local-command-stdout>echo</local-command-stdout>", "", None),
        (None, "", None),
    ],
)
def test_clean_prompt(spark, raw, clean, slash):
    got = one(spark, raw, text.clean_prompt)
    assert (got["text"], got["slash"]) == (clean, slash)


def test_human_prompt_rules(spark):
    cases = [
        ("typed", None, "do it", False, None, True), (None, None, "do it", False, None, True), ("sdk", None, "do it", False, None, False), (None, None, "Caveat: generated", False, None, False),
        ("typed", None, "x", True, None, False), ("sdk", "human", "override", False, None, True), (None, None, "do it", False, "sdk-cli", False), (None, None, "do it", False, "cli", True),
        (None, None, "<bash-stdout>x</bash-stdout>", False, None, False), (None, None, "", False, None, False),
    ]
    df = spark.createDataFrame(cases, "s string, o string, t string, m boolean, e string, want boolean")
    assert df.where(text.is_human(F.col("s"), F.col("o"), F.col("t"), F.col("m"), F.col("e")) != F.col("want")).count() == 0


def test_intents_and_errors(spark):
    assert set(one(spark, "still broken, please push the branch", text.intents)) == {"correction", "bug/fix", "commit/git"}
    kind = lambda t, n=0: one(spark, t, lambda c: text.error_kind(c, F.lit(n)))
    assert kind("You hit the weekly limit") == "usage_limit" and kind("The cart works.") is None and kind("server says 429") == "rate_limit"
    assert kind("insufficient credit") == "billing" and kind("insufficient credit", 1) is None and kind("weekly limit " * 40) is None


def test_paths(spark):
    assert [one(spark, e, paths.file_category) for e in (".py", ".md", ".weird", None)] == ["code", "docs", "other", "other"]
    assert [one(spark, p, paths.extension) for p in ("C:\\a\\b.PY", "a.b/c", "x.tar.gz", None)] == [".py", None, ".gz", None]
    assert [one(spark, c, paths.shell_program) for c in ("FOO=1 /usr/bin/python a.py", "(cd /r && ls)", "'git' x\nls", "A=1", "")] == ["python", "cd", "git", None, None]
    assert one(spark, "C:\\repo\\demo\\", lambda c: paths.project_of(c, F.lit("dir"))) == "demo"
    assert one(spark, None, lambda c: paths.project_of(c, F.lit("C--repo-demo"))) == "C--repo-demo"
    assert one(spark, " a b/ü_c ", paths.slug) == "a-b-_c"


def test_family_key_masks_digits(spark):
    assert one(spark, "run batch 3", text.family_key) == one(spark, "run  batch 17", text.family_key) == "run batch N"


def test_tokens_and_phrases(spark):
    got = one(spark, "Look at https://x.y/z and FIX-12 in src/a/b.py:\n```code fence``` really 42 parsers, parsers", text.content_tokens)
    assert got == ["look", "src", "parsers", "parsers"]
    assert one(spark, ["a", "b", "c"], lambda c: text.ngrams(c, 2), "array<string>") == ["a b", "b c"]
    assert one(spark, ["a"], lambda c: text.ngrams(c, 2), "array<string>") == []


def test_times(spark):
    got = [str(one(spark, v, times.parsed)) for v in ("2026-08-01T09:00:01.500Z", "2026-08-01T09:00:01", "1750000000000", "nonsense", "")]
    assert got == ["2026-08-01 09:00:01.500000", "2026-08-01 09:00:01", "2025-06-15 15:06:40", "None", "None"]


def test_cost_and_fallbacks(spark):
    rows = spark.createDataFrame([("claude-haiku-4-5-20251001", 10, 20, 100, 1000, 0, 0), ("who", 10, 20, 100, 0, 40, 60)], "model string, input_tokens int, output_tokens int, cache_write int, cache_read int, eph_5m int, eph_1h int")
    from turnlake.operators import responses

    got = {r["model"]: r["cost_usd"] for r in responses.priced(rows).collect()}
    assert got["claude-haiku-4-5-20251001"] == pytest.approx((10 + 100 * 1.25 + 1000 * 0.1) / 1e6 + 20 * 5 / 1e6)
    assert got["who"] == pytest.approx((10 + 40 * 1.25 + 60 * 2.0) * 3 / 1e6 + 20 * 15 / 1e6)
    assert pricing.family_rates("opus") == (15.0, 75.0) and pricing.family_rates("none") is None


def test_filters_of_the_last_days():
    from datetime import date

    from turnlake.filters import Filters

    assert Filters.last_days(7, date(2024, 3, 10)).since == "2024-03-04"
