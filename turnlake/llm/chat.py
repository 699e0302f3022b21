"""Chat formatting of typed content parts.

A message's content is a list of typed parts. Each part is visited in order and
flattened: text is escaped and written as it stands; an image, a sound or a
document becomes a placeholder of its kind, its reference goes to a list of
attachments, and the tokens to which it expands are counted. One string comes
out for each conversation, with the spans of it that a model is trained on.

The template is ``<|im_start|>role<|im_sep|>content<|im_end|>`` and a line feed
for each message. Inside roles and texts a backslash is doubled and ``<|``
becomes ``<\\|``, so no text can hold a control string, and taking each
backslash's next character as it is gives the text back.

Only built-in functions run. A conversation is one row of the result, so it is
gathered whole, as its formatted string has to be; nothing else meets in a
task.

Defined results: a null text or role counts as empty; messages are ordered by
turn (null first), then role, then content, so repeated rows and ties give the
same string on each run; a null conv_id is a conversation of its own; a part of
an unknown or null type counts as text; an empty table gives an empty result;
other columns are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnlake.llm.common import pick

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n"
#: Placeholder of each kind of attachment.
PLACEHOLDERS = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}
#: Tokens for each unit of an attachment's extent: an image's tile, a second of sound, a document's page.
TOKENS_PER_UNIT = {"image": 256, "audio": 25, "document": 512}
#: The role whose messages are trained on.
TRAINED = "assistant"
PARTS = "array<struct<type:string,text:string,ref:string,extent:int>>"


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def text_part(text: Column) -> Column:
    """Content that consists of one text."""
    part = F.struct(F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("int").alias("extent"))
    return F.array(part).cast(PARTS)


def _case(part: Column, of: dict, other: Column) -> Column:
    out = None
    for kind, value in of.items():
        out = (F.when if out is None else out.when)(part["type"] == kind, value)
    return out.otherwise(other)


def visited(part: Column) -> Column:
    """The string that a part becomes."""
    return _case(part, {k: F.lit(v) for k, v in PLACEHOLDERS.items()}, escaped(F.coalesce(part["text"], F.lit(""))))


def attachment_tokens(part: Column) -> Column:
    """Tokens that stand for a part's placeholder; 0 for text."""
    return _case(part, {k: F.greatest(F.coalesce(part["extent"], F.lit(1)), F.lit(0)) * n for k, n in TOKENS_PER_UNIT.items()}, F.lit(0))


def format_chats(messages: DataFrame) -> DataFrame:
    """One row for each conversation of ``messages`` (conv_id, turn, role, parts).

    formatted: the string. mask: for each message the offsets at which it, its
    content and what follows the content start, and whether the content is
    trained on. attachments: reference, type, message, part, offset of the
    placeholder's message and tokens, in order. attachment_tokens: their sum.
    """
    rows = pick(messages, "conv_id", "turn", "role", "parts").select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce(F.col("parts").cast(PARTS), F.array().cast(PARTS)).alias("parts")
    )
    rows = rows.select("*", F.concat(F.lit(START), escaped(F.col("role")), F.lit(SEP)).alias("head"), F.array_join(F.transform("parts", visited), "").alias("body"))
    in_order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "body")
    size = F.length("head") + F.length("body") + len(END)
    rows = rows.withColumn("at", F.coalesce(F.sum(size).over(in_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")).withColumn("message", F.row_number().over(in_order) - 1)
    content_at = F.col("at") + F.length("head")
    files = F.filter(
        F.transform("parts", lambda p, k: F.struct(F.col("message").alias("message"), k.alias("part"), p["type"].alias("type"), p["ref"].alias("ref"), F.col("at").alias("message_at"), attachment_tokens(p).alias("tokens"))),
        lambda f: f["type"].isin(*PLACEHOLDERS),
    )
    mask = F.struct(F.col("at").alias("start"), content_at.alias("content"), (content_at + F.length("body")).alias("end"), (F.col("role") == TRAINED).alias("trained"))
    # Rows go to their conversation once, ordered there by their number.
    one = F.struct("message", F.concat("head", "body", F.lit(END)).alias("piece"), mask.alias("mask"), files.alias("files"))
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(one)).alias("all"))
    return whole.select(
        "conv_id",
        F.array_join("all.piece", "").alias("formatted"),
        F.col("all.mask").alias("mask"),
        F.flatten("all.files").alias("attachments"),
        F.aggregate(F.flatten("all.files"), F.lit(0).cast("long"), lambda n, f: n + f["tokens"]).alias("attachment_tokens"),
    )


def read_back(chats: DataFrame) -> DataFrame:
    """What a reader of ``formatted`` and ``mask`` gets: messages (role, text) and the trained texts, in order."""
    pieces = F.slice(F.split("formatted", r"<\|im_end\|>\n", -1), F.lit(1), F.size("mask"))
    role_text = lambda s: F.split(F.substr(s, F.lit(len(START) + 1)), r"<\|im_sep\|>", 2)
    messages = F.transform("pieces", lambda s: F.struct(unescaped(F.get(role_text(s), F.lit(0))).alias("role"), unescaped(F.get(role_text(s), F.lit(1))).alias("text")))
    # The mask's offsets count from the whole string's start; taken from the message's own piece, each costs its own length only.
    span = lambda s, m: F.substr(s, (m["content"] - m["start"] + 1).cast("int"), (m["end"] - m["content"]).cast("int"))
    trained = F.zip_with("pieces", "mask", lambda s, m: F.when(m["trained"], unescaped(span(s, m))).otherwise(""))
    return chats.withColumn("pieces", pieces).select("conv_id", "formatted", messages.alias("messages"), trained.alias("trained"), "attachments", "attachment_tokens")


def digest(chats: DataFrame) -> DataFrame:
    """Counts and digests of what :func:`read_back` gives."""
    turns = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit("\n"), m["text"], F.lit("\n"))), "")
    loss = F.array_join("trained", "")
    return read_back(chats).select(
        "conv_id", F.size("messages").cast("long").alias("n_turns"), F.sha2(turns.cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"), F.col("attachment_tokens").cast("long").alias("attachment_tokens"),
    )
