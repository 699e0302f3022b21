"""Behaviour: session facts, habits and friction."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnlake.filters import EVERYTHING, Filters
from turnlake.functions import pricing, text
from turnlake.operators import ranks
from turnlake.operators import sessions as session_rows
from turnlake.plans.catalogue import STAMP, exprs, query, top


def facts(m, f: Filters) -> DataFrame:
    messages, tools, prompts, turns, events = (f.apply(t) for t in (m.messages, m.tools, m.prompts, m.turns, m.events))
    return session_rows.facts(messages, m.sessions, tools, prompts, turns, events)


def _human(m, f: Filters) -> DataFrame:
    return f.apply(m.prompts).where("is_human = 1")


@query
def session_facts(m, f: Filters = EVERYTHING) -> DataFrame:
    stamps = {c: F.date_format(c, STAMP) for c in ("started", "ended")}
    return facts(m, f).withColumns(stamps).withColumn("nested_cost", F.round("nested_cost", 6))


@query
def slash_usage(m, f: Filters = EVERYTHING) -> DataFrame:
    rows = f.apply(m.prompts).where("is_slash = 1 AND slash_name IS NOT NULL").groupBy(F.col("slash_name").alias("name"))
    return top(rows.agg(*exprs(n="count(1)", sessions="count(DISTINCT session_id)", projects="count(DISTINCT project)", first_day="min(date)", last_day="max(date)")), 40, F.desc("n"), F.asc("name"))


@query
def prompts_per_session(m, f: Filters = EVERYTHING) -> DataFrame:
    """Median, and the value of the nearest rank at nine tenths, over interactive sessions with prompts."""
    rows = facts(m, f).where("headless = 0 AND prompts > 0").select("prompts")
    # Few different counts exist, so ranks are found among them rather than among sessions.
    counts = rows.groupBy("prompts").agg(*exprs(n="count(1)"))
    every = Window.partitionBy()
    ranked = counts.withColumn("upto", F.sum("n").over(every.orderBy("prompts"))).withColumn("total", F.sum("n").over(every))
    p90 = ranked.where("upto > bround((total - 1) * 0.9, 0)").agg(F.min("prompts").alias("p90"))
    return rows.agg(*exprs(median="median(prompts)")).join(p90, F.lit(True))


@query
def actions_per_prompt(m, f: Filters = EVERYTHING) -> DataFrame:
    return facts(m, f).agg(*exprs(actions_per_prompt="coalesce(round(sum(api_calls) / nullif(sum(prompts), 0), 1), 0)", tools_per_prompt="coalesce(round(sum(tool_calls) / nullif(sum(prompts), 0), 1), 0)"))


@query
def openers(m, f: Filters = EVERYTHING) -> DataFrame:
    """How sessions begin: kinds of their first human prompt."""
    first = _human(m, f).groupBy("session_id").agg(F.min_by(F.struct("is_slash", "slash_name", F.left(F.coalesce("text", F.lit("")), F.lit(400)).alias("head")), F.struct("ts", "uuid")).alias("x")).select("x.*")
    size = F.length("head")
    kind = (
        F.when(F.col("is_slash") == 1, F.concat(F.lit("slash "), F.coalesce("slash_name", F.lit("")))).when(text.is_continuation(F.col("head")), "continuation")
        .when(size < 40, "short (<40 chars)").when(size < 400, "medium").otherwise("long (400+ chars)")
    )
    return first.groupBy(kind.alias("kind")).agg(*exprs(n="count(1)"))


@query
def prompt_shape(m, f: Filters = EVERYTHING) -> DataFrame:
    share = "coalesce(round(count_if({}) / nullif(count(1), 0) * 100, 1), 0)"
    short = "is_slash = 0 AND coalesce(chars, 0) < 25"
    return _human(m, f).agg(*exprs(prompts="count(1)", short_prompts=f"count_if({short})", short_prompt_pct=share.format(short), night_pct=share.format("hour <= 5"), weekend_pct=share.format("dow IN (5, 6)")))


@query
def intent_counts(m, f: Filters = EVERYTHING) -> DataFrame:
    rows = _human(m, f)
    total = rows.agg(*exprs(total="count(1)"))
    found = rows.select(F.explode("intents").alias("intent")).groupBy("intent").agg(*exprs(n="count(1)"))
    return found.join(total, F.lit(True)).select("intent", "n", F.round(F.col("n") / F.col("total") * 100, 1).alias("pct"))


@query
def premature_sends(m, f: Filters = EVERYTHING) -> DataFrame:
    """Prompts sent again within ten minutes with more text at the end, and the median wait."""
    before = Window.partitionBy("session_id").orderBy("ts", "uuid")
    head = F.trim(F.left(F.coalesce("text", F.lit("")), F.lit(400)))
    rows = _human(m, f).select("session_id", "ts", "uuid", "is_slash", head.alias("head"))
    rows = rows.withColumn("was", F.lag("head").over(before)).withColumn("gap_s", F.timestamp_diff("SECOND", F.lag("ts").over(before), F.col("ts")))
    again = rows.where((F.col("is_slash") == 0) & (F.length("was") >= 12) & (F.length("head") > F.length("was")) & F.col("head").startswith(F.col("was")) & (F.col("gap_s") <= 600))
    return again.agg(*exprs(premature_sends="count(1)", premature_median_gap_s="coalesce(round(median(gap_s), 0), 0)"))


@query
def by_entrypoint(m, f: Filters = EVERYTHING) -> DataFrame:
    rows = facts(m, f).groupBy(F.expr("CASE WHEN headless = 1 THEN 'headless (sdk)' ELSE 'interactive (cli)' END").alias("entrypoint"))
    return rows.agg(*exprs(sessions="count(1)", cost_usd="round(sum(cost_usd), 2)", prompts="sum(prompts)", api_calls="sum(api_calls)", tool_calls="sum(tool_calls)"))


def _reruns(m, f: Filters) -> DataFrame:
    rows = f.apply(m.prompts).where("is_human = 0 AND source = 'sdk'").groupBy("project", "date", F.left("text", F.lit(80)).alias("head")).agg(*exprs(n="count(1)"))
    return top(rows.where("n > 1"), 15, F.desc("n"), F.asc("project"), F.asc("date"), F.asc("head"))


@query
def headless_reruns(m, f: Filters = EVERYTHING) -> DataFrame:
    """Programs' prompts sent more than once on a day, the 15 most frequent."""
    return _reruns(m, f)


@query
def redundant_reruns(m, f: Filters = EVERYTHING) -> DataFrame:
    return _reruns(m, f).agg(*exprs(redundant_reruns="coalesce(sum(n - 1), 0)"))


DELEGATES = "(agent_calls > 0 OR nested_tools > 0)"


@query
def delegation(m, f: Filters = EVERYTHING) -> DataFrame:
    rows = facts(m, f)
    kind = F.expr(f"CASE WHEN {DELEGATES} THEN 'delegating' WHEN tool_calls > 0 THEN 'direct' END")
    priced = ranks.medians(rows.where("cost_per_tool <> 0").select(kind.alias("kind"), "cost_per_tool").where("kind IS NOT NULL"), ["kind"], "cost_per_tool")
    middles = priced.agg(*exprs(**{f"cost_per_tool_{k}": f"coalesce(round(max(CASE WHEN kind = '{k}' THEN median END), 4), 0)" for k in ("delegating", "direct")}))
    shares = rows.agg(
        *exprs(
            delegating_sessions=f"count_if({DELEGATES})", delegated_tool_share="coalesce(round(sum(nested_tools) / nullif(sum(tool_calls), 0) * 100, 1), 0)",
            delegated_cost_share="round(coalesce(sum(nested_cost), 0) / greatest(1e-9, coalesce(sum(cost_usd), 0)) * 100, 1)",
        )
    )
    return shares.join(middles, F.lit(True))


def _slim(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.select("session_id", "project", "title", F.date_format("started", STAMP).alias("started"), *columns)


@query
def parallel_sessions(m, f: Filters = EVERYTHING) -> DataFrame:
    """Sessions with more model time than time on the clock."""
    return _slim(top(facts(m, f).where("parallelism > 1.05"), 12, F.desc("parallelism"), F.asc("session_id")), "parallelism", "turn_ms", "wall_ms", "cost_usd", "agent_calls")


@query
def overnight_sessions(m, f: Filters = EVERYTHING) -> DataFrame:
    late = facts(m, f).where("wall_ms > 4 * 3600000 AND (hour(started) >= 17 OR hour(started) <= 3)")
    return _slim(top(late, 10, F.desc("wall_ms"), F.asc("session_id")), "wall_ms", "cost_usd", "prompts", "tool_calls")


@query
def habit_counts(m, f: Filters = EVERYTHING) -> DataFrame:
    return facts(m, f).agg(
        *exprs(
            sessions="count(1)", interactive_sessions="count_if(headless = 0)", one_prompt_sessions="count_if(headless = 0 AND prompts <= 1)", long_sessions="count_if(headless = 0 AND prompts >= 10)",
            corrections="coalesce(sum(corrections), 0)", interrupts="coalesce(sum(interrupts), 0)", compactions="coalesce(sum(compactions), 0)",
        )
    )


@query
def habit_ratios(m, f: Filters = EVERYTHING) -> DataFrame:
    """Human prompts that correct something, and sessions that open with a continuation, in hundredths of all; two rows of totals meet."""
    said = f.apply(m.prompts).where("is_human = 1").agg(*exprs(prompts="count(1)", corrections="count_if(array_contains(intents, 'correction'))"))
    opened = openers(m, f).agg(*exprs(sessions="coalesce(sum(n), 0)", continuations="coalesce(sum(CASE WHEN kind = 'continuation' THEN n END), 0)"))
    return said.crossJoin(opened).select(
        "corrections", *exprs(correction_pct="coalesce(round(corrections / nullif(prompts, 0) * 100, 1), 0)", continuation_opener_pct="round(continuations / greatest(1, sessions) * 100, 1)")
    )


@query
def errors(m, f: Filters = EVERYTHING) -> DataFrame:
    return f.apply(m.messages).where("error_kind IS NOT NULL").groupBy("error_kind").agg(*exprs(n="count(1)", sessions="count(DISTINCT session_id)", first_day="min(date)", last_day="max(date)"))


@query
def error_daily(m, f: Filters = EVERYTHING) -> DataFrame:
    return f.apply(m.messages).where("error_kind IS NOT NULL AND date IS NOT NULL").groupBy("date", "error_kind").agg(*exprs(n="count(1)"))


@query
def error_kind(m, f: Filters = EVERYTHING) -> DataFrame:
    """What each reply complains of."""
    return f.apply(m.messages).where("error_kind IS NOT NULL").select("uuid", "error_kind")


@query
def limit_sessions(m, f: Filters = EVERYTHING) -> DataFrame:
    """The latest sessions that met a limit."""
    rows = f.apply(m.messages).where("error_kind IN ('usage_limit', 'rate_limit', 'billing', 'fallback')").groupBy("session_id", "error_kind").agg(F.max("project").alias("project"), *exprs(date="max(date)", n="count(1)"))
    latest = top(rows, 20, F.desc("date"), F.asc("session_id"), F.asc("error_kind"))
    return latest.join(m.sessions.select("session_id", "custom_title", "ai_title", "agent_name"), "session_id", "left").withColumn("title", session_rows.title()).drop("custom_title", "ai_title", "agent_name")


@query
def events_daily(m, f: Filters = EVERYTHING) -> DataFrame:
    return f.apply(m.events).where("date IS NOT NULL").groupBy("date").agg(
        *exprs(interrupts="count_if(kind = 'interrupt')", compactions="count_if(kind = 'compact')", api_errors="count_if(kind = 'system' AND subkind = 'api_error')")
    )


@query
def model_switches(m, f: Filters = EVERYTHING) -> DataFrame:
    return facts(m, f).agg(*exprs(model_switch_sessions="count_if(distinct_models > 1)", sessions_with_compaction="count_if(compactions > 0)", tool_errors="sum(tool_errors)"))


@query
def cost_outliers(m, f: Filters = EVERYTHING) -> DataFrame:
    """Dear sessions whose tool calls cost over three times the median."""
    rows = facts(m, f).where("cost_usd >= 2 AND cost_per_tool <> 0")
    middle = ranks.medians(rows, [], "cost_per_tool").withColumnRenamed("median", "cpt_median")
    far = rows.join(middle, F.lit(True)).where("cost_per_tool > 3 * cpt_median")
    return _slim(top(far, 12, F.desc("cost_per_tool"), F.asc("session_id")), "cost_usd", "tool_calls", "cost_per_tool", "api_calls")


@query
def high_burn_low_tool(m, f: Filters = EVERYTHING) -> DataFrame:
    return _slim(top(facts(m, f).where("cost_usd > 1 AND tool_calls < 10"), 12, F.desc("cost_usd"), F.asc("session_id")), "cost_usd", "tool_calls", "api_calls", "prompts")


@query
def search_heavy(m, f: Filters = EVERYTHING) -> DataFrame:
    rows = facts(m, f).where("tool_calls >= 10 AND readonly_share >= 0.6 AND uses_opus = 1")
    return _slim(top(rows, 12, F.desc("cost_usd"), F.asc("session_id")), "cost_usd", "tool_calls", "readonly_share")


@query
def zero_tool(m, f: Filters = EVERYTHING) -> DataFrame:
    return facts(m, f).where("tool_calls = 0").agg(*exprs(zero_tool_sessions="count(1)", zero_tool_cost="round(coalesce(sum(cost_usd), 0), 2)"))


@query
def median_session_cost(m, f: Filters = EVERYTHING) -> DataFrame:
    cost = facts(m, f).select(F.coalesce("cost_usd", F.lit(0.0)).alias("cost"))
    return ranks.medians(cost, [], "cost").select(F.coalesce(F.round("median", 2), F.lit(0.0)).alias("median_session_cost"))


#: Which lines each scope of the counterfactual has.
SCOPES = {"all": "true", "nested (sub-agents)": session_rows.NESTED, "opus": "model ILIKE 'claude-opus%'", "headless": "coalesce(entrypoint, 'cli') <> 'cli'"}


@query
def routing_counterfactual(m, f: Filters = EVERYTHING) -> DataFrame:
    """What the same tokens would have cost at each family's rates.

    One pass sums the tokens of all scopes; as cost is linear in tokens, sums
    are priced instead of lines.
    """
    lines = f.apply(m.messages).join(m.sessions.select("session_id", "entrypoint"), "session_id", "left")
    lines = lines.withColumn("w5", pricing.five_minute_writes(F.col("cache_write"), F.col("eph_5m"), F.col("eph_1h")))
    parts = {"i": "input_tokens", "o": "output_tokens", "w5": "w5", "w1": "eph_1h", "r": "cache_read", "actual": "cost_usd"}
    sums = lines.agg(*[F.struct(*[F.sum(F.when(F.expr(cond), F.col(c)).otherwise(0)).alias(k) for k, c in parts.items()]).alias(f"s{j}") for j, cond in enumerate(SCOPES.values())])
    scopes = F.array(*[F.struct(F.lit(name).alias("scope"), F.col(f"s{j}").alias("s")) for j, name in enumerate(SCOPES)])
    rows = sums.select(F.explode(scopes).alias("x")).select("x.scope", "x.s.*").where("actual <> 0")
    at = {f"at_{family}": F.round(pricing.cost(*map(F.lit, pricing.family_rates(family)), *map(F.col, ("i", "o", "w5", "w1", "r"))), 2) for family in pricing.FAMILIES}
    return rows.select("scope", F.round("actual", 2).alias("actual"), *[c.alias(k) for k, c in at.items()])


@query
def cache_by_project(m, f: Filters = EVERYTHING) -> DataFrame:
    rows = f.apply(m.messages).where("project IS NOT NULL").groupBy("project").agg(
        *exprs(hit_pct="round(sum(cache_read) * 100D / nullif(sum(cache_read + input_tokens + cache_write), 0), 1)", cache_1h="sum(eph_1h)", cache_5m="sum(eph_5m)", cost_usd="round(sum(cost_usd), 2)")
    )
    return top(rows, 15, F.desc("cost_usd"), F.asc("project"))
