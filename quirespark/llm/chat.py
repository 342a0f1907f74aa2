"""Chat formatting in budgeted windows; DataFrame functions only.

Prefix sums of the turns' tokens cut a conversation into turn-aligned spans: a span holds the
turns that lie wholly inside one stride of the token axis, and a turn that crosses a stride's
end is a span of its own. So no span exceeds the stride unless a single turn does, and no
conversation is ever folded in one task. Each span becomes a window: the system turn (that of
a conversation that opens with one), the turns of at most ``history`` tokens just before the
span, repeated, and then the span's own turns. Only the assistant texts of a window's own
turns are under its loss mask, so each one is a target once.

Turns are written as ``<|turn|>role\\ntext<|end|>``, repeated ones as ``<|seen|>...``. Control
strings inside roles and texts get a backslash behind their first character; one that already
has backslashes there gets one more, which makes this reversible.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURN, SEEN, END, NEWLINE = "<|turn|>", "<|seen|>", "<|end|>", "<|nl|>"
_SAID = "struct<kind:int,n:int,role:string,text:string>"
_AHEAD = r"(?=\||/?s>|</?SYS>>|/?INST\])"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"(<|\[)(\\*)" + _AHEAD, r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(<|\[)\\(\\*)" + _AHEAD, "$1$2")


def _escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit(NEWLINE))


def _unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit(NEWLINE), F.lit("\n")))


def count_tokens(text: Column) -> Column:
    """Runs of letters or digits, and single marks; four more for the turn's own marks."""
    return F.regexp_count(text, F.lit(r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]")).cast("long") + 4


def format_chats(
    chats: DataFrame, budget: int = 512, history: int = 128, conv_col: str = "conv_id", turn_col: str = "turn",
    role_col: str = "role", text_col: str = "text",
) -> DataFrame:
    """One row a window: conv_id, window, text, targets (start and length in characters), tokens.

    Turns go by turn, then role, then text; repeated rows are turns like any others. Null
    roles and texts are empty ones, null turns come first, and rows of a null conv_id are one
    conversation. An empty table gives no window; other columns are not read. A window's
    tokens are within the budget unless a single turn, or the system turn, leaves no room.
    """
    order = Window.partitionBy("conv").orderBy("turn", "role", "text")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    turns = chats.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    ).withColumn("tokens", count_tokens(F.col("text")))
    turns = turns.withColumn("n", F.row_number().over(order)).withColumn("system", (F.col("n") == 1) & (F.col("role") == "system"))
    counted = F.when(F.col("system"), 0).otherwise(F.col("tokens"))
    turns = (
        turns.withColumn("opening", F.max(F.when(F.col("system"), F.col("tokens")).otherwise(0)).over(so_far))
        .withColumn("begin", F.coalesce(F.sum(counted).over(before), F.lit(0)))
        .withColumn("end", F.col("begin") + counted)
        .withColumn("stride", F.greatest(F.lit(budget - history) - F.col("opening"), F.lit(max(budget // 8, 1))))
        .withColumn("step", F.floor(F.col("begin") / F.col("stride")))
        .withColumn("crosses", (F.col("end") > (F.col("step") + 1) * F.col("stride")) & (F.col("begin") > F.col("step") * F.col("stride")))
        .withColumn("span", (F.col("step") * 2 + F.col("crosses").cast("long")).cast("long"))
    )
    # All of this needs one order of a conversation's turns: one shuffle, and frames that spill.
    said = lambda kind: F.struct(F.lit(kind).alias("kind"), "n", "role", "text")
    turns = turns.withColumn("opens", (F.row_number().over(Window.partitionBy("conv", "span").orderBy("n")) == 1) & (F.col("begin") > 0))
    if history > 0:
        # Earlier turns begin before this one; those that begin within ``history`` are repeated.
        near = Window.partitionBy("conv").orderBy("begin").rangeBetween(-history, -1)
        turns = turns.withColumn("past", F.when(F.col("opens"), F.collect_list(F.when(~F.col("system"), said(1))).over(near)))
    else:
        turns = turns.withColumn("past", F.array().cast(f"array<{_SAID}>"))
    start = F.first(F.when(F.col("system"), said(0))).over(so_far)
    turns = turns.withColumn("start", F.when(F.col("opens"), F.array_compact(F.array(start))))
    windows = turns.groupBy("conv", "span").agg(
        F.sort_array(F.concat(F.flatten(F.collect_list("start")), F.flatten(F.collect_list("past")), F.collect_list(said(2)))).alias("turns")
    )
    tokens = F.aggregate("turns", F.lit(0).cast("long"), lambda a, t: a + count_tokens(t["text"]))
    head = lambda t: F.concat(F.when(t["kind"] == 2, F.lit(TURN)).otherwise(F.lit(SEEN)), _escape_role(t["role"]), F.lit("\n"))
    windows = windows.withColumn(
        "parts",
        F.transform("turns", lambda t: F.struct(
            head(t).alias("head"), escape(t["text"]).alias("body"), ((t["kind"] == 2) & (t["role"] == "assistant")).alias("target"))),
    )
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("found"))
    size = lambda x: F.length(x).cast("long")
    targets = F.aggregate(
        "parts", zero,
        lambda a, p: F.struct(
            (a["at"] + size(p["head"]) + size(p["body"]) + len(END)).alias("at"),
            F.when(p["target"], F.concat(a["found"], F.array(F.struct((a["at"] + size(p["head"])).alias("start"), size(p["body"]).alias("length")))))
            .otherwise(a["found"]).alias("found")),
        lambda a: a["found"],
    )
    text = F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"], F.lit(END))), "")
    return windows.select(F.col("conv").alias("conv_id"), F.col("span").alias("window"), text.alias("text"), targets.alias("targets"), tokens.alias("tokens"))


def read_back(windows: DataFrame) -> DataFrame:
    """What the formatted windows say, by conversation, with digests.

    turns_sha256 covers role, newline, text, newline of every turn that is not a repetition;
    loss_sha256 all text under the loss masks. A digest is of one conversation's whole text,
    which therefore has to fit in a row.
    """
    pattern = r"(?s)<\|turn\|>([^\n]*)\n(.*?)<\|end\|>"
    roles = F.regexp_extract_all("text", F.lit(pattern), F.lit(1))
    texts = F.regexp_extract_all("text", F.lit(pattern), F.lit(2))
    said = F.zip_with("roles", "texts", lambda r, t: F.concat(_unescape_role(r), F.lit("\n"), unescape(t), F.lit("\n")))
    masked = F.transform("targets", lambda s: unescape(F.substring("text", s["start"] + 1, s["length"])))
    parsed = windows.withColumns({"roles": roles, "texts": texts}).select(
        "conv_id", "window", F.size("roles").cast("long").alias("n"), F.array_join(said, "").alias("said"),
        F.array_join(masked, "").alias("loss"), F.length("text").cast("long").alias("chars"),
    )
    whole = parsed.groupBy("conv_id").agg(
        F.sum("n").alias("n_turns"), F.sort_array(F.collect_list(F.struct("window", "said", "loss"))).alias("w"), F.sum("chars").alias("formatted_chars")
    )
    return whole.withColumns({"said": F.array_join("w.said", ""), "loss": F.array_join("w.loss", "")}).select(
        "conv_id", "n_turns", F.sha2("said", 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars",
    )
