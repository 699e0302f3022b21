"""Text rules as Column expressions: prompts, replies, shell output, issue keys, tokens.

Word boundaries and digits follow Unicode, and only a line feed ends a line,
hence the flags U and d of the patterns.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word lists and patterns that decide results.
HUMAN_SOURCES = ("typed", "queued", "suggestion_accepted")
NOT_HUMAN_PREFIXES = (
    "Caveat:", "<command-", "<local-command", "<system-reminder>", "<user-prompt-submit-hook>", "<task-notification",
    "<bash-stdout", "<bash-stderr", "<bash-input", "Base directory for this skill", "# /",
)
REMINDER = r"(?s)<system-reminder>.*?</system-reminder>"
COMMAND_NAME = r"<command-name>([^<]*)</command-name>"
COMMAND_ARGS = r"(?s)<command-args>(.*?)</command-args>"
COMMAND_OUTPUT = "<local-command-stdout>"
CONTINUATION = r"(?iu)^(yes|ok|okay|continue|go|proceed|do it|now |also |and |next|then |it |still|no[,. ])"
INTENTS = {
    "bug/fix": r"(?iU)\b(bug|fix|broken|error|fail|crash|doesn'?t work|not work|exception|wrong)\b",
    "correction": r"(?imdU)^(no[,. ]|nope|wrong|that'?s not|not what|i said|again|still |you (didn'?t|forgot|were))",
    "verify/test": r"(?iU)\b(test|verify|check|confirm|make sure|validate|run (it|the))\b",
    "commit/git": r"(?iU)\b(commit|push|branch|merge|rebase|pull request|\bpr\b|git)\b",
    "ticket": r"(?iU)\b(jira|ticket|issue|story|epic)\b",
    "build/deploy": r"(?iU)\b(build|deploy|release|docker|pipeline|ci\b|publish|install)\b",
    "explain/ask": r"(?iU)\b(what|why|how|explain|describe|tell me|show me|\?)",
    "continue/go": r"(?iU)^(continue|go|proceed|next|do it|yes|ok|okay|go ahead|carry on)\b",
    "design/ui": r"(?iU)\b(design|ui|ux|layout|css|style|theme|font|colou?r|responsive|mobile)\b",
    "refactor/clean": r"(?iU)\b(refactor|clean ?up|simplify|rename|reorganis|reorganiz|dedup|tidy)\b",
    "docs": r"(?iU)\b(readme|docs?|documentation|comment|changelog|write ?up)\b",
    "plan": r"(?iU)\b(plan|roadmap|architecture|approach|options|strategy|think (about|through))\b",
    "review": r"(?iU)\b(review|audit|critique|look over|check the code|code review)\b",
    "report": r"(?iU)\b(report|summary|summari[sz]e|overview|dashboard|chart)\b",
}
ERROR_KINDS = {
    "usage_limit": r"(?i)usage limit reached|Claude usage limit|weekly limit|5-hour limit|limit will reset",
    "rate_limit": r"rate limit(?:ed|s)? (?:exceeded|reached|hit)|\b429\b|overloaded_error|\bOverloaded\b",
    "billing": r"(?i)credit balance|insufficient credit|billing (?:issue|error|problem)",
    "fallback": r"(?i)falling back to|fallback model|switched to [\w.-]+ model",
    "api_error": r"(?i)^API Error|\"type\":\"error\"|prompt is too long|context.?length exceeded|max_tokens",
}
ERROR_MAX_CHARS = 400
COMMIT = r"(?md)^\[([^\s\]]+)\s+([0-9a-f]{7,40})\]\s*(.*)$"
STAT = r"(\d+) files? changed(?:, (\d+) insertions?\(\+\))?(?:, (\d+) deletions?\(-\))?"
STAT_WITHIN = 400
PUSH = r"(?md)^To\s+(\S+)[ \t\r]*$"
PULL_REQUEST = r"https?://\S+?/(?:pull|pull-requests|merge_requests)/\d+"
GIT_SUBCOMMAND = r"\bgit\s+(?:--?\S+\s+)*([a-z][a-z\-]+)"
TICKET = r"\b([A-Z][A-Z0-9]{1,9})-(\d{1,6})\b"
NOT_TICKETS = """
UTF UTF8 ISO SHA MD RFC CVE CWE HTTP HTTPS IPV AES RSA TLS SSL PEP ES UTC GMT ASCII
BASE SP WCAG ARIA CSS HTML JSON XML SQL API3 X WIN MACOS PYTHON NODE JAVA NET PHP GPT
CLAUDE COVID GB MB KB TB USD EUR AM PM Q H FY T V REV PART STEP FIG TABLE SECTION
CHAPTER PR SHA1 SHA256 MD5 ID UUID GUID CSV PDF PNG JPG SVG RGB HEX DPI FPS MS
""".split()
STOPWORDS = """
a an the and or but if then else of to in on at by for with from as is are was were be been
being it its this that these those i you we they he she me my your our their them him her
do does did done doing have has had having can could should would will shall may might must
not no yes so just also very really please thanks thank ok okay now here there what which who
whom whose when where why how all any some each more most other such only own same than too
s t don ve ll re d m into over under again further once about up down out off above below
between through during before after let make made use using used want need like get got
one two first new file files code line lines thing things way still
""".split()
MASKS = (
    (r"(?s)```.*?```", " "),
    (r"https?://\S+", " URL "),
    (r"(?U)\b[A-Za-z]+-\d+\b", " TICKET "),
    (r"(?iU)(?:[a-z]:)?[\\/][\w\-.\\/]+", " PATH "),
    (r"(?U)\b\d+\b", " N "),
)
#: All that is not [a-z0-9_./-], as ranges: a negated class of ranges and single characters is ten times slower here.
BETWEEN_TOKENS = r"[\x00-,:-^`\x7b-\x{10FFFF}]+"
TOKEN_LIMIT, FAMILY_CHARS = 120, 160


def _list(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def _spaced(text: Column) -> Column:
    """White space runs as single spaces, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def _some(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def clean_prompt(text: Column) -> Column:
    """struct(text, slash): the prompt without injected blocks, and the slash command that it invokes."""
    raw, output = _some(text), _some(text).contains(COMMAND_OUTPUT)
    has_name = raw.rlike(COMMAND_NAME) & ~output
    name = _stripped(F.regexp_extract(raw, COMMAND_NAME, 1))
    args = _stripped(F.regexp_extract(raw, COMMAND_ARGS, 1))
    command = F.concat(name, F.when(args != "", F.concat(F.lit(" "), args)).otherwise(""))
    body = F.when(has_name, command).when(output, "").otherwise(raw)
    return F.struct(_stripped(F.regexp_replace(body, REMINDER, "")).alias("text"), F.when(has_name & (name != ""), name).alias("slash"))


def is_human(source: Column, origin: Column, text: Column, is_meta: Column, entrypoint: Column) -> Column:
    """True if a person typed the prompt; the first rule that applies decides."""
    starts = F.lit(False)
    for p in NOT_HUMAN_PREFIXES:
        starts = starts | _some(text).startswith(p)
    return (
        F.when(F.coalesce(is_meta, F.lit(False)), False)
        .when(origin == "human", True)
        .when(_some(source) != "", source.isin(*HUMAN_SOURCES))
        .when((_some(entrypoint) != "") & (entrypoint != "cli"), False)
        .when(_some(text) == "", False)
        .otherwise(~starts)
    )


def intents(text: Column) -> Column:
    """Names of the intents that a prompt shows, in fixed order."""
    found = [F.when(_some(text).rlike(p), F.lit(name)) for name, p in INTENTS.items()]
    return F.array_compact(F.array(*found))


def is_continuation(text: Column) -> Column:
    return _some(text).rlike(CONTINUATION)


def error_kind(text: Column, tool_uses: Column) -> Column:
    """What a short reply without tools complains of; null for other replies."""
    out = F.when((_some(text) == "") | (F.coalesce(tool_uses, F.lit(0)) != 0) | (F.length(text) > ERROR_MAX_CHARS), F.lit(None).cast("string"))
    for kind, pattern in ERROR_KINDS.items():
        out = out.when(text.rlike(pattern), kind)
    return out


def commits(text: Column) -> Column:
    """Array of (sha, branch, subject, files, insertions, deletions); of repeated shas the first.

    The counts come from a summary within STAT_WITHIN characters of the header.
    What lies between headers and the headers themselves alternate, so running
    sums of their lengths give each header's end.
    """
    text = _some(text)
    kind = "array<struct<header:string,tail:string>>"
    parts = F.zip_with(F.regexp_extract_all(text, F.lit(COMMIT), F.lit(0)), F.split(text, COMMIT, -1), lambda m, gap: F.struct(m.alias("m"), F.length(gap).alias("gap")))

    def step(acc: Column, part: Column) -> Column:
        end = acc["end"] + part["gap"] + F.coalesce(F.length(part["m"]), F.lit(0))
        one = F.struct(part["m"].alias("header"), F.substr(text, end + 1, F.lit(STAT_WITHIN)).alias("tail"))
        return F.struct(end.alias("end"), F.when(part["m"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(one))).alias("out"))

    found = F.aggregate(parts, F.struct(F.lit(0).alias("end"), F.array().cast(kind).alias("out")), step, lambda acc: acc["out"])
    number = lambda c, k: F.coalesce(F.regexp_extract(c["tail"], STAT, k).try_cast("int"), F.lit(0))
    each = F.transform(
        found,
        lambda c: F.struct(
            F.regexp_extract(c["header"], COMMIT, 2).alias("sha"), F.regexp_extract(c["header"], COMMIT, 1).alias("branch"), F.left(_stripped(F.regexp_extract(c["header"], COMMIT, 3)), F.lit(200)).alias("subject"),
            number(c, 1).alias("files"), number(c, 2).alias("insertions"), number(c, 3).alias("deletions"),
        ),
    )
    return F.filter(each, lambda c, k: ~F.exists(F.slice(each, F.lit(1), k), lambda d: d["sha"] == c["sha"]))


def pushes(text: Column) -> Column:
    return F.regexp_extract_all(_some(text), F.lit(PUSH), F.lit(1))


def pull_requests(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(_some(text), F.lit(PULL_REQUEST), F.lit(0))))


def git_subcommands(command: Column) -> Column:
    return F.regexp_extract_all(_some(command), F.lit(GIT_SUBCOMMAND), F.lit(1))


def tickets(text: Column) -> Column:
    """Distinct issue keys, in order of appearance."""
    found = F.array_distinct(F.regexp_extract_all(_some(text), F.lit("(?U)" + TICKET), F.lit(0)))

    def real(key: Column) -> Column:
        prefix = F.substring_index(key, "-", 1)
        return ~F.array_contains(_list(NOT_TICKETS), prefix) & (F.length(F.regexp_replace(prefix, "[0-9]", "")) >= 2)

    return F.filter(found, real)


#: For each mask, in order, what a text must match for it to apply: a pass over the text that copies nothing.
_HAS = (r"```", r"://", r"(?U)-\d", r"[\\/]", r"(?U)\d")


def _masked(text: Column) -> Column:
    """Lower case, with fences dropped and urls, keys, paths and numbers masked, in that order."""

    def masked(out: Column) -> Column:
        for (pattern, mask), has in zip(MASKS, _HAS):
            out = _replaced(out, pattern, mask, has)
        return out

    # Without any of these no mask applies, as for most texts.
    some = lambda x: x.contains("/") | x.contains("\\") | x.contains("`") | x.rlike(r"(?U)\d")
    return F.get(F.transform(F.array(F.lower(_some(text))), lambda x: F.when(some(x), masked(x)).otherwise(x)), F.lit(0))


def _replaced(text: Column, pattern: str, mask: str, has: str) -> Column:
    """All matches of a pattern replaced in texts that match ``has``; an array of one binds the text, which a plain condition would work out twice."""
    return F.get(F.transform(F.array(text), lambda x: F.when(x.rlike(has), F.regexp_replace(x, pattern, mask)).otherwise(x)), F.lit(0))


def normalized(text: Column) -> Column:
    """A text masked, its white space as single spaces."""
    return _spaced(_masked(text))


def content_tokens(text: Column) -> Column:
    """Tokens of more than two characters that aren't stop words, in order; masks vanish, as they are in upper case."""
    # Splitting takes time in proportion to the text; extracting all matches copies it for each of them.
    tokens = F.array_remove(F.split(_masked(text), BETWEEN_TOKENS, -1), "")
    return F.filter(tokens, lambda t: (F.length(t) > 2) & ~t.isin(*STOPWORDS))


def token_set(text: Column, limit: int | None = TOKEN_LIMIT) -> Column:
    """The distinct ones of a prompt's first content tokens, or of all."""
    tokens = content_tokens(text)
    return F.array_distinct(tokens if limit is None else F.slice(tokens, 1, limit))


def family_key(text: Column) -> Column:
    """Key of exact repeats: lower case, numbers masked."""
    return F.left(F.regexp_replace(_spaced(F.lower(_some(text))), r"(?U)\b\d+\b", "N"), F.lit(FAMILY_CHARS))


def ngrams(tokens: Column, n: int) -> Column:
    """Phrases of ``n`` neighbouring tokens."""
    places = F.filter(F.sequence(F.lit(1), F.greatest(F.size(tokens), F.lit(1))), lambda i: i + (n - 1) <= F.size(tokens))
    return F.transform(places, lambda i: F.array_join(F.slice(tokens, i, n), " "))


def word_count(text: Column) -> Column:
    return F.regexp_count(_some(text), F.lit(r"(?U)\S+"))
