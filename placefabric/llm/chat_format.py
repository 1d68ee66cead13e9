"""Chat logs folded into messages and rendered through a template, all in DataFrame expressions.

A log has a row for each event of a conversation: `message` opens a position with a role and a text, `delta` adds to the
text there, `edit` and `regenerate` begin it anew, `delete` takes it out. All but `delta` also take back whatever stood
at later positions: an edited question loses the answers that followed it. An event therefore counts if no event but a delta
comes after it at its own or an earlier position, which is one running minimum over the sorted log.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SPAN = 1 << 12  # sequence numbers of a conversation that one window sees
TURNS = 1 << 10  # turns of a conversation that are numbered by one window
STEP = 32  # bits of a sequence number for the events of one turn
DELTA = 256  # code points of a streamed piece
KINDS = ("message", "delta", "edit", "regenerate", "delete")


@dataclass(frozen=True)
class Template:
    """The marks of a turn: opening, role, middle, text, close; start stands once before the first turn.

    Marks have two characters or more and no backslash, and the first character of each stands nowhere else in a mark, so
    that no mark can begin in a text and end in a mark.
    """

    start: str
    opening: str
    middle: str
    close: str
    trained: tuple[str, ...] = ("assistant",)

    def __post_init__(self):
        marks = self.marks()
        heads = {m[0] for m in marks}
        if any(len(m) < 2 or "\\" in m or heads & set(m[1:]) for m in marks):
            raise ValueError("marks need two characters, no backslash, and a first character that stands in no mark again")

    def marks(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys(m for m in (self.start, self.opening, self.middle, self.close) if m))

    def escape(self, text: Column) -> Column:
        """A backslash goes before every backslash and into every mark, after its first character."""
        text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
        for m in self.marks():
            text = F.replace(text, F.lit(m), F.lit(f"{m[0]}\\{m[1:]}"))
        return text


HEADER = Template("<|begin_of_text|>", "<|start_header_id|>", "<|end_header_id|>", "<|eot_id|>")
INSTRUCT = Template("<s>", "[INST]", "[/INST]", "</s>")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(r"(?s)\\(.)"), F.lit("$1"))


def numbered(rows: DataFrame, key: str, order: str, ties: list[str], span: int) -> DataFrame:
    """Adds position (from 0) by key in the order of an integer column, null first, then of ties.

    A window sees so many values of the order column at most; counts of these ranges give what stands before.
    """
    rows = rows.withColumn("_group", F.struct(F.col(key).alias("key"), F.expr(f"`{order}` div {span}").alias("range")))
    w = Window.partitionBy("_group.key").orderBy("_group.range").rowsBetween(Window.unboundedPreceding, -1)
    before = rows.groupBy("_group").agg(F.count(F.lit(1)).alias("_n")).select("_group", F.sum("_n").over(w).alias("_before")).where("_before is not null")
    own = F.row_number().over(Window.partitionBy("_group").orderBy(F.col(order).asc_nulls_first(), *ties)) - 1
    joined = rows.withColumn("_own", own.cast("long")).join(before, "_group", "left")
    return joined.withColumn("position", F.col("_own") + F.coalesce("_before", F.lit(0))).drop("_group", "_own", "_before")


def event_log(turns: DataFrame) -> DataFrame:
    """turns (conv_id, turn, role, text) -> conv_id, seq, position, kind, role, text: a log that leads to these turns.

    Turns stand by turn, null first; ties by role and text, so that equal rows stay apart. A trained role's text comes in
    deltas; by a hash of the text every third such turn was begun otherwise and regenerated, and every third other turn was
    posted short and edited. Null roles and texts are empty.
    """
    rows = numbered(turns.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")), "conv_id", "turn", ["role", "text"], TURNS)
    pieces = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{DELTA}}}"), F.lit(0))
    redone = F.pmod(F.xxhash64("text"), F.lit(3)) == 0

    def event(kind: str, text: Column, role: Column | None = None) -> Column:
        return F.struct(F.lit(kind).alias("kind"), (F.lit(None).cast("string") if role is None else role).alias("role"), text.alias("text"))

    empty, short = F.lit(""), F.element_at(F.concat(pieces, F.array(F.lit(""))), 1)
    deltas = F.transform(pieces, lambda p: event("delta", p))
    streamed = F.concat(F.array(event("message", empty, F.col("role"))), F.when(redone, F.array(event("delta", F.reverse(short)), event("regenerate", empty))).otherwise(F.array()), deltas)
    posted = F.when(redone, F.array(event("message", short, F.col("role")), event("edit", F.col("text")))).otherwise(F.array(event("message", F.col("text"), F.col("role"))))
    events = rows.select("conv_id", "position", F.posexplode(F.when(F.col("role").isin(*HEADER.trained), streamed).otherwise(posted)).alias("step", "e"))
    return events.select("conv_id", (F.shiftleft("position", STEP) + F.col("step")).alias("seq"), "position", "e.kind", "e.role", "e.text")


def fold_events(events: DataFrame, span: int = SPAN) -> DataFrame:
    """events (conv_id, seq long, position long, kind, role, text) -> conv_id, position, role, text of the messages that remain.

    A role is the last one that an event at the position names; a text is what counting events put together, empty if none
    does. An event delivered twice counts once. Events of one seq stand by position, kind and text; those without
    seq come first, those without position or with a kind of no meaning count for nothing. A null conv_id is a conversation.
    span: sequence numbers that one window sees; a conversation with more is folded range by range, with the least
    position that later ranges reset carried over.
    """
    e = events.where(F.col("position").isNotNull() & F.col("kind").isin(*KINDS)).select(
        F.struct(F.col("conv_id").alias("key"), F.expr(f"seq div {span}").alias("range")).alias("_group"), "seq", "position", "kind", "role", "text",
        F.when(F.col("kind") != "delta", F.col("position")).alias("_reset"),
    )
    later = Window.partitionBy("_group.key").orderBy(F.col("_group.range").desc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    ranges = e.groupBy("_group").agg(F.min("_reset").alias("_reset")).select("_group", F.min("_reset").over(later).alias("_later")).where("_later is not null")
    order = [F.col(c).desc_nulls_last() for c in ("seq", "position", "kind", "text", "role")]
    e = e.withColumn("_next", F.min("_reset").over(Window.partitionBy("_group").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))).join(ranges, "_group", "left")
    counts = F.coalesce(F.least("_next", "_later") > F.col("position"), F.lit(True))
    piece = F.struct("seq", "kind", F.when(F.col("kind") == "delete", F.lit("")).otherwise(F.coalesce("text", F.lit(""))).alias("text"))
    messages = e.groupBy(F.col("_group.key").alias("conv_id"), "position").agg(
        F.array_sort(F.collect_set(F.when(counts, piece))).alias("_pieces"),
        F.max(F.when(F.col("role").isNotNull(), F.struct("seq", "role"))).alias("_role"),
    )
    kept = F.exists("_pieces", lambda p: p["kind"] != "delete")
    return messages.where(kept).select("conv_id", "position", F.coalesce("_role.role", F.lit("")).alias("role"), F.array_join(F.transform("_pieces", lambda p: p["text"]), "").alias("text"))


def render(messages: DataFrame, template: Template = HEADER) -> DataFrame:
    """messages (conv_id, position, role, text) -> conv_id, segments array<struct<text, loss>>, a row for each conversation.

    The segments in order are the training text, and loss is its mask: true for the whole text of a trained turn, marks and
    roles excluded. Texts and roles are escaped message by message, before a conversation meets. Null texts and roles are
    empty; messages of one position stand by role and text. A conversation is one row, which Spark bounds at 2 GB.
    """
    role, text = (template.escape(F.coalesce(F.col(c), F.lit(""))) for c in ("role", "text"))
    trained = F.coalesce(F.col("role").isin(*template.trained), F.lit(False))

    def segment(of: Column, loss: Column) -> Column:
        return F.struct(of.alias("text"), loss.alias("loss"))

    turn = F.array(segment(F.concat(F.lit(template.opening), role, F.lit(template.middle)), F.lit(False)), segment(text, trained), segment(F.lit(template.close), F.lit(False)))
    turns = messages.select("conv_id", F.struct("position", "role", "text").alias("at"), turn.alias("turn")).select("conv_id", F.struct("at.position", "turn").alias("piece"))
    whole = F.flatten(F.transform(F.array_sort(F.collect_list("piece")), lambda p: p["turn"]))
    return turns.groupBy("conv_id").agg(F.concat(F.array(segment(F.lit(template.start), F.lit(False))), whole).alias("segments"))


def read_back(formatted: DataFrame, template: Template = HEADER) -> DataFrame:
    """formatted (conv_id, segments) -> conv_id, formatted (the text), turns array<struct<role, text>>, loss (all text under the mask, unescaped).

    Turns are cut from the formatted text by its marks alone.
    """
    text = F.array_join(F.transform("segments", lambda s: s["text"]), "")
    read = formatted.select("conv_id", text.alias("formatted"), F.filter("segments", lambda s: s["loss"]).alias("_trained"))
    quoted = r"\Q" + template.opening + r"\E"
    parts = F.slice(F.split("formatted", quoted), 2, F.length("formatted"))

    def turn(p: Column) -> Column:
        at = F.instr(p, F.lit(template.middle))
        start = at + len(template.middle)
        return F.struct(unescape(F.substring(p, F.lit(1), at - 1)).alias("role"), unescape(F.substring(p, start, F.length(p) - start - len(template.close) + 1)).alias("text"))

    return read.select("conv_id", "formatted", F.transform(parts, turn).alias("turns"), F.array_join(F.transform("_trained", lambda s: unescape(s["text"])), "").alias("loss"))


def chat_digests(turns: DataFrame, template: Template = HEADER) -> DataFrame:
    """turns -> conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars: logged, folded, rendered and read back."""
    back = read_back(render(fold_events(event_log(turns), TURNS << STEP), template), template)
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def with_probe(turns: DataFrame, spark: SparkSession) -> DataFrame:
    """The conversations and one more, -7, of a user and an assistant who both speak in control strings."""
    said = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text").unionByName(probe)
