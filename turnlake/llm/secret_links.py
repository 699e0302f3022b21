"""Secret scan with multipart credential linking.

Labelled assignments, access key identifiers and long hex runs are secrets by
themselves. A high-entropy run, an account name or an endpoint is not; each is
reported only where the complementary parts stand nearby in the same document:
an interval join, within a scope of so many code points, of access identifiers,
secrets and endpoints.

No text counts for two parts: what overlaps a labelled secret is no candidate,
a run of characters that overlaps an account or endpoint is a piece of it and no
secret, and an account inside an endpoint complements secrets but no endpoint.
A part therefore never vouches for itself.

The join meets bins as wide as the scope: any two parts of one bin are near
enough, and of the bins beside it only the nearest part can matter, so each bin
keeps its first and last position of each role. Places and overlaps come from
running sums and maxima along a text. A document with any number of parts thus
costs a few rows for each part, never a pair for each two.

Only built-in functions run. Spans count code points, end exclusive.

Defined results: null and empty texts have no spans and the digest of an empty
list; a span found twice counts once; repeated rows are scanned each; an empty
table gives an empty result; other columns are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnlake.llm.common import cut, pick, text_of

# The patterns of the base kinds.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: Least length of an assigned value.
ASSIGNED = 6
#: Parts that count only beside their complements.
ACCOUNT = r"(?i)(?<![A-Za-z0-9_])(?:user(?:name)?|login|client_?id|account)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9._@-]{3,}"
RUN = r"[A-Za-z0-9+/_-]{20,}"
ENDPOINT = r"(?i)(?<![A-Za-z0-9_])(?:https?|wss?|postgres|mysql|mongodb|redis|s3)://[^\x00-\x20\"'<>]+"
#: All kinds in the order in which spans that start together are listed.
KINDS = ("assign", "access", "hex", "linked_account", "linked_secret", "linked_endpoint")
#: Roles of each kind in a credential; an account inside an endpoint isn't one apart.
ROLES = {"assign": ("secret",), "access": ("account", "account apart"), "hex": ("secret",), "linked_account": ("account", "account apart"), "linked_secret": ("secret",), "linked_endpoint": ()}
#: What a part that is weak by itself needs nearby.
NEEDS = {"linked_account": ("secret",), "linked_secret": ("account",), "linked_endpoint": ("account apart", "secret")}
#: Code points between the starts of two parts of one credential, at most.
SCOPE = 200

_SPAN = "array<struct<start:int,kind:int,end:int>>"
_HIT = "array<struct<kind:int,k:int,gap:int,length:int,fits:boolean>>"


def _hits(kind: str, text: Column, pattern: str, good=None) -> Column:
    """Leftmost, non-overlapping matches of a pattern, in order: k, gap (what lies between the one before and this), length, and whether the match is one of the kind.

    What lies between the matches and the matches themselves alternate, so
    running sums of the two lengths give the places.
    """
    found, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    fits = lambda m: F.lit(True) if good is None else good(m)
    hit = lambda m, gap: F.struct(F.length(gap).alias("gap"), F.length(m).alias("length"), fits(m).alias("fits"))
    each = F.zip_with(found, F.slice(between, F.lit(1), F.size(found)), hit)
    full = F.transform(each, lambda h, k: F.struct(F.lit(KINDS.index(kind)).alias("kind"), k.alias("k"), h["gap"].alias("gap"), h["length"].alias("length"), h["fits"].alias("fits")))
    return F.when(text.rlike(pattern), full).otherwise(F.array().cast(_HIT))


def _mixed(run: Column) -> Column:
    """Letters of both cases and digits: unlike a word, a number or a path."""
    return run.rlike("[0-9]") & run.rlike("[a-z]") & run.rlike("[A-Z]")


def hits(text: Column) -> Column:
    """The matches of all kinds, base kinds first."""
    value = lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= ASSIGNED
    base = (_hits("assign", text, ASSIGN, value), _hits("access", text, ACCESS), _hits("hex", text, HEX))
    return F.concat(*base, _hits("linked_account", text, ACCOUNT), _hits("linked_secret", text, RUN, _mixed), _hits("linked_endpoint", text, ENDPOINT))


def written(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def _by_kind(lists: dict[str, tuple]) -> Column:
    """The texts of a kind, whose number is in the column ``kind``."""
    return F.element_at(F.array(*[F.array(*[F.lit(x) for x in lists.get(k, ())]).cast("array<string>") for k in KINDS]), F.col("kind") + 1)


def linked(parts: DataFrame) -> DataFrame:
    """The weak parts of (row, start, kind, end, strong, inside) that have their complements in scope; ``inside`` says that a part is inside an endpoint."""
    parts = parts.withColumn("bin", F.floor(F.col("start") / SCOPE))
    roles = F.filter(_by_kind(ROLES), lambda r: (r != "account apart") | ~F.col("inside"))
    bins = parts.select("row", "start", "bin", F.explode(roles).alias("role")).groupBy("row", "role", "bin").agg(F.min("start").alias("first"), F.max("start").alias("last"))
    asked = parts.where("not strong").select("row", "start", "kind", "end", F.explode(_by_kind(NEEDS)).alias("role"), "bin")
    asked = asked.withColumn("bin", F.explode(F.array(F.col("bin") - 1, F.col("bin"), F.col("bin") + 1)))
    near = asked.join(bins, ["row", "role", "bin"]).where(F.least(F.abs(F.col("start") - F.col("first")), F.abs(F.col("start") - F.col("last"))) <= SCOPE)
    met = near.groupBy("row", "start", "kind", "end").agg(F.count_distinct("role").alias("met"))
    return met.where(F.col("met") == F.size(_by_kind(NEEDS))).drop("met")


def _overlaps(of: Column) -> Column:
    """Whether the row's span overlaps a span of its text for which ``of`` holds.

    Of those that start no later, the greatest end tells; of those that start
    no sooner, the least start: a running maximum and a running minimum along the
    text, whatever the number of spans.
    """
    along = Window.partitionBy("row").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.max(F.when(of, F.col("end"))).over(along.orderBy("start"))
    start = F.min(F.when(of, F.col("start"))).over(along.orderBy(F.desc("start")))
    return F.coalesce(end > F.col("start"), F.lit(False)) | F.coalesce(start < F.col("end"), F.lit(False))


def _is(*kinds: str) -> Column:
    return F.col("kind").isin(*[KINDS.index(k) for k in kinds])


def placed(found: DataFrame) -> DataFrame:
    """row, kind, start and end of each match of ``found`` (row, hits) that is one of its kind."""
    each = found.select("row", F.explode("hits").alias("h")).select("row", "h.*").repartition("row")
    upto = Window.partitionBy("row", "kind").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("gap") + F.col("length")).over(upto).cast("int")
    return each.withColumn("end", end).where("fits").select("row", "kind", (F.col("end") - F.col("length")).alias("start"), "end")


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, base and linked spans (arrays of start, kind, end), for each row of ``docs``."""
    strong = _is("assign", "access", "hex")
    found = cut(pick(docs, "doc_id", "text").select(F.monotonically_increasing_id().alias("row"), "doc_id", hits(text_of()).alias("hits")), "secret-hits")
    spans = placed(found.where(F.size("hits") > 0))
    # What overlaps a labelled secret is none, and a run that overlaps an account or endpoint is a piece of it.
    kept = spans.withColumn("taken", _overlaps(strong)).where(strong | ~F.col("taken")).drop("taken")
    kept = kept.withColumns({"piece": _overlaps(_is("linked_account", "linked_endpoint")), "in_endpoint": _overlaps(_is("linked_endpoint"))}).where(~(_is("linked_secret") & F.col("piece")))
    parts = cut(kept.select("row", "start", "kind", "end", strong.alias("strong"), (_is("linked_account", "access") & F.col("in_endpoint")).alias("inside")), "secret-parts")
    more = linked(parts).select("row", "start", "kind", "end", F.lit(False).alias("strong"))
    told = parts.where("strong").select("row", "start", "kind", "end", "strong").unionByName(more)
    span = F.struct("start", "kind", "end")
    lists = told.groupBy("row").agg(F.sort_array(F.collect_set(F.when(F.col("strong"), span))).alias("base"), F.collect_set(F.when(~F.col("strong"), span)).alias("linked"))
    none = F.array().cast(_SPAN)
    return found.select("row", "doc_id").join(lists, "row", "left").select("doc_id", F.coalesce("base", none).alias("base"), F.coalesce("linked", none).alias("linked"))


def report(docs: DataFrame) -> DataFrame:
    """The digest columns of :func:`scan`."""
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    return scan(docs).select(
        "doc_id", count("assign"), count("access"), count("hex"),
        F.sha2(written(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        written(F.array_sort(F.concat("base", "linked"))).alias("spans"),
        F.size("linked").cast("long").alias("n_linked"),
    )
