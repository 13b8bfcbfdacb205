r"""Chat formatting over typed content parts.

A message holds ordered parts of type text, image, audio or document. ``flatten_parts`` visits them in
order: text is escaped, every other part becomes a numbered placeholder, its reference is recorded, and
the tokens it will expand to are counted. ``format_conversations`` joins the turns of a conversation into
one string with its loss mask; ``read_back`` takes such strings apart again.

Escaping is reversible: in texts and roles ``\`` becomes ``\b`` and ``<`` becomes ``\l``, so that a ``<`` in the
output always belongs to the template; in roles a line end becomes ``\n``, so that the first line of a turn is its role.

Defined results: a null text, role or part list counts as empty; a null conversation id forms a
conversation of its own; turns with the same number stand in the order of role and text; null turns come
first; repeated rows are repeated turns; an empty table gives an empty table. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<turn>", "</turn>\n"
#: Tokens that a part of each type expands to; a document adds its pages.
PART_TOKENS = {"image": 576, "audio": 750, "document": 1024}
PARTS_TYPE = "array<struct<type:string,text:string,ref:string,units:int>>"


def escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l"))


def unescape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


def escape_role(c: Column) -> Column:
    return F.replace(escape(c), F.lit("\n"), F.lit("\\n"))


def unescape_role(c: Column) -> Column:
    return unescape(F.replace(c, F.lit("\\n"), F.lit("\n")))


def text_part(text: Column) -> Column:
    """A part list that holds one text."""
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("int").alias("units")))


def flatten_parts(parts: Column, part_tokens: dict[str, int] = PART_TOKENS) -> Column:
    """struct(body, attachments, expanded_tokens) of a part list.

    body: escaped texts and placeholders ``<image:1>`` in the order of the parts, numbered by type.
    attachments: (slot, type, ref) in that order. expanded_tokens: tokens of a part's type times its units
    (1 where null). A part of another type, or without one, counts as text.
    """
    parts = F.coalesce(parts, F.array().cast(PARTS_TYPE))
    known = list(part_tokens)
    media = F.filter(parts, lambda p: p["type"].isin(known))

    def number(p: Column, i: Column) -> Column:
        return F.size(F.filter(F.slice(parts, F.lit(1), i + 1), lambda q: q["type"] == p["type"]))

    def visit(p: Column, i: Column) -> Column:
        slot = F.concat(F.lit("<"), p["type"], F.lit(":"), number(p, i).cast("string"), F.lit(">"))
        return F.when(p["type"].isin(known), slot).otherwise(escape(F.coalesce(p["text"], F.lit(""))))

    def cost(p: Column) -> Column:
        each = F.lit(0)
        for kind, n in part_tokens.items():
            each = F.when(p["type"] == kind, F.lit(n)).otherwise(each)
        return each * F.coalesce(p["units"], F.lit(1))

    slots = F.filter(F.transform(parts, lambda p, i: F.struct(visit(p, i).alias("slot"), p["type"].alias("type"), p["ref"].alias("ref"))), lambda a: a["type"].isin(known))
    return F.struct(
        F.array_join(F.transform(parts, visit), "").alias("body"),
        F.when(F.size(media) > 0, slots).otherwise(F.array().cast("array<struct<slot:string,type:string,ref:string>>")).alias("attachments"),
        F.aggregate(media, F.lit(0), lambda s, p: s + cost(p)).alias("expanded_tokens"),
    )


def _running(numbers: Column) -> Column:
    """array<long>: for each number, the sum of those before it."""
    return F.aggregate(numbers, F.struct(F.array().cast("array<long>").alias("at"), F.lit(0).cast("long").alias("sum")), lambda s, n: F.struct(F.concat(s["at"], F.array(s["sum"])).alias("at"), (s["sum"] + n).alias("sum")), lambda s: s["at"])


def running_sums(numbers: Column, block: int = 256) -> Column:
    """As _running, by blocks: appending to one array would cost the square of its length."""
    blocks = F.transform(F.sequence(F.lit(0), F.greatest((F.size(numbers) - 1).cast("int"), F.lit(0)), F.lit(block)), lambda i: F.slice(numbers, i + 1, F.lit(block)))
    before = _running(F.transform(blocks, lambda b: F.aggregate(b, F.lit(0).cast("long"), lambda s, n: s + n)))
    return F.flatten(F.zip_with(blocks, before, lambda b, base: F.transform(_running(b), lambda at: at + base)))


def format_conversations(turns: DataFrame, parts: Column | None = None, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", train_on: str = "assistant") -> DataFrame:
    """One row per conversation: conv_id, n_turns, formatted, loss_spans, attachments, expanded_tokens.

    loss_spans are (start, length) code points of ``formatted`` that the loss covers: the bodies of the
    ``train_on`` turns. Only the turns of one conversation meet in one task, as they make one string.
    """
    flat = flatten_parts(text_part(F.col(text)) if parts is None else parts)
    bodies = turns.select(F.col(conv).alias("conv_id"), F.col(turn).alias("_qs_turn"), F.coalesce(F.col(role), F.lit("")).alias("_qs_role"), flat.alias("_qs_flat"))
    piece = F.concat(F.lit(OPEN), escape_role(F.col("_qs_role")), F.lit("\n"), F.col("_qs_flat.body"), F.lit(CLOSE))
    bodies = bodies.select("conv_id", F.struct(F.col("_qs_turn").alias("turn"), F.col("_qs_role").alias("role"), F.col("_qs_flat.body").alias("body"), piece.alias("piece"), F.col("_qs_flat.attachments").alias("attachments"), F.col("_qs_flat.expanded_tokens").alias("tokens")).alias("t"))
    rows = bodies.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    lengths = F.transform("ts", lambda t: F.length(t["piece"]))
    rows = rows.withColumn("lengths", lengths).withColumn("at", running_sums(F.col("lengths")))
    span = F.zip_with("ts", "at", lambda t, at: F.struct(t["role"].alias("role"), (at + len(OPEN) + F.length(escape_role(t["role"])) + 1).cast("int").alias("start"), F.length(t["body"]).alias("length")))
    return rows.select(
        "conv_id",
        F.size("ts").cast("long").alias("n_turns"),
        F.array_join(F.transform("ts", lambda t: t["piece"]), "").alias("formatted"),
        F.transform(F.filter(span, lambda s: s["role"] == train_on), lambda s: F.struct(s["start"].alias("start"), s["length"].alias("length"))).alias("loss_spans"),
        F.flatten(F.transform("ts", lambda t: t["attachments"])).alias("attachments"),
        F.aggregate("ts", F.lit(0).cast("long"), lambda s, t: s + t["tokens"]).alias("expanded_tokens"),
    )


def read_back(formatted: Column) -> Column:
    """array<struct<role,text>> of a formatted string, unescaped (placeholders stay as they are)."""
    pieces = F.filter(F.split(formatted, CLOSE), lambda p: p != "")

    def turn(p: Column) -> Column:
        inner = F.substr(p, F.lit(len(OPEN) + 1))
        cut = F.locate("\n", inner)
        return F.struct(unescape_role(F.substr(inner, F.lit(1), cut - 1)).alias("role"), unescape(F.substr(inner, cut + 1)).alias("text"))

    return F.transform(pieces, turn)


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, s["start"] + 1, s["length"]))), "")


def digest(chats: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, each read from the formatted strings."""
    read = chats.select("conv_id", "formatted", read_back(F.col("formatted")).alias("turns"), loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
