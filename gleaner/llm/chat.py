"""Chat formatting of typed content parts, by DataFrame functions only.

A message is a sequence of parts: text, image, audio or document. A visitor flattens them in order: text is escaped,
every other part becomes a numbered placeholder such as ``<|image:0|>`` and is recorded as an attachment with its
reference and the number of tokens into which a model expands it. Messages become turns of the template

    <|im_start|>ROLE\\nCONTENT<|im_end|>\\n

Control strings begin with ``<|``. Inside texts and roles a backslash goes between ``<`` and ``|`` (and one more where
there are some already), which is undone by taking one away: the escaping is a bijection, and no text can hold a
control string. Back slashes and line feeds of roles are escaped too, as a role ends at the line feed.

The loss mask is a list of code point spans of the formatted text: the contents of the assistant's turns.

Defined cases: null texts, roles and parts are empty; turns of equal number are ordered by role, then text; null turns
come first; repeated rows are turns of their own; rows without conv_id are one conversation; an empty table gives no
conversation; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"
LEARNED_ROLE = "assistant"
#: Kinds of parts besides text, and how many tokens one expands to.
PATCH, AUDIO_RATE, PAGE_TOKENS = 14, 25, 256
PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"


def escape(c: Column) -> Column:
    return F.regexp_replace(c, r"<(\\*)\|", r"<\\$1|")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"<\\(\\*)\|", r"<$1|")


def escape_role(c: Column) -> Column:
    return escape(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescape_role(c: Column) -> Column:
    """Undoes ``escape_role``; a doubled back slash is set aside while line feeds come back."""
    parts = F.split(unescape(c), r"\\\\", -1)
    return F.array_join(F.transform(parts, lambda p: F.replace(p, F.lit("\\n"), F.lit("\n"))), "\\")


def expanded_tokens(part: Column) -> Column:
    """Tokens that a part other than text expands to; a part without measures is one token."""
    image = F.ceil(part["width"] / PATCH) * F.ceil(part["height"] / PATCH)
    audio = F.ceil(part["seconds"] * AUDIO_RATE)
    pages = part["pages"] * F.lit(PAGE_TOKENS)
    by_kind = F.when(part["type"] == "image", image).when(part["type"] == "audio", audio).when(part["type"] == "document", pages)
    return F.greatest(F.coalesce(by_kind, F.lit(1)), F.lit(1)).cast("long")


def is_attachment(part: Column) -> Column:
    return F.coalesce(part["type"], F.lit("text")).isin("image", "audio", "document")


def flatten(parts: Column, numbered_from: Column) -> Column:
    """The content of one message: its parts' escaped texts and placeholders, parted by ``<|part|>``. Attachments are
    numbered from ``numbered_from`` through the conversation. Parts of an unknown type count as text."""

    def one(part: Column, i: Column) -> Column:
        earlier = F.size(F.filter(F.slice(parts, F.lit(1), i), is_attachment))
        mark = F.concat(F.lit("<|"), part["type"], F.lit(":"), (numbered_from + earlier).cast("string"), F.lit("|>"))
        return F.when(is_attachment(part), mark).otherwise(escape(F.coalesce(part["text"], F.lit(""))))

    return F.array_join(F.transform(parts, one), "<|part|>")


def text_parts(text: Column) -> Column:
    """A plain text as a single text part."""
    return F.from_json(F.lit("[{}]"), f"array<{PART}>") if text is None else F.array(
        F.struct(
            F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"),
            *[F.lit(None).cast(t).alias(n) for n, t in (("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))],
        )
    )


def format_chats(messages: DataFrame, *, parts: Column | None = None, learned_role: str = LEARNED_ROLE) -> DataFrame:
    """(conv_id, formatted, loss_mask, attachments, n_attachment_tokens) from (conv_id, turn, role, text); ``parts``: a
    column of typed parts in place of ``text``. One shuffle, by conversation; each conversation becomes one string."""
    content = text_parts(F.col("text")) if parts is None else F.coalesce(parts, F.array().cast(f"array<{PART}>"))
    rows = messages.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), content.alias("parts")
    ).withColumn("attached", F.filter("parts", is_attachment))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", F.to_json("parts"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    numbered = rows.withColumn("first", F.coalesce(F.sum(F.size("attached")).over(before), F.lit(0)).cast("long"))
    pieces = numbered.withColumn("content", flatten(F.col("parts"), F.col("first"))).withColumn("head", F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n")))
    placed = pieces.withColumn(
        "at", F.coalesce(F.sum(F.length("head") + F.length("content") + F.lit(len(END))).over(before), F.lit(0)).cast("long")
    ).withColumn("k", F.row_number().over(order))
    begin = F.col("at") + F.length("head")
    marked = placed.select(
        "conv_id", "k", F.concat("head", "content", F.lit(END)).alias("piece"), (F.col("role") == learned_role).alias("learned"),
        F.struct(begin.alias("start"), (begin + F.length("content")).alias("end")).alias("span"),
        F.transform("attached", lambda a, i: F.struct((F.col("first") + i).alias("number"), a["type"].alias("type"), a["ref"].alias("ref"), expanded_tokens(a).alias("tokens"))).alias("attached"),
    )
    turns = F.array_sort(F.collect_list(F.struct("k", "piece", "learned", "span", "attached")))
    return marked.groupBy("conv_id").agg(turns.alias("turns")).select(
        "conv_id",
        F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("formatted"),
        F.transform(F.filter("turns", lambda t: t["learned"]), lambda t: t["span"]).alias("loss_mask"),
        F.flatten(F.transform("turns", lambda t: t["attached"])).alias("attachments"),
    ).withColumn("n_attachment_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda n, a: n + a["tokens"]))


def read_back(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of (role, text), unescaped."""
    ended = F.split(formatted, r"<\|im_end\|>\n", -1)
    turns = F.slice(ended, F.lit(1), F.greatest(F.size(ended) - 1, F.lit(0)))

    def turn(t: Column) -> Column:
        body = F.substr(t, F.lit(len(START) + 1))
        end = F.instr(body, "\n")
        return F.struct(unescape_role(F.substr(body, F.lit(1), end - 1)).alias("role"), unescape(F.substr(body, end + 1)).alias("text"))

    return F.transform(turns, turn)


def masked_text(formatted: Column, mask: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(mask, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")


def chats(conversations: DataFrame) -> DataFrame:
    """One row per conversation, read back from the formatted text: conv_id, n_turns, turns_sha256, loss_chars,
    loss_sha256, formatted_chars."""
    loss = masked_text(F.col("formatted"), F.col("loss_mask"))
    back = format_chats(conversations).select("conv_id", "formatted", read_back(F.col("formatted")).alias("turns"), loss.alias("loss"))
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )
