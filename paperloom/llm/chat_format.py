"""Chat formatting in budgeted windows; DataFrame functions only.

Prefix sums of the turns' tokens over a conversation choose turn-aligned spans; each
span becomes one window: the leading system turn, the last turns before the span within the
history budget, then the span's own turns.  Only assistant texts of a window's own turns
are under the loss mask, so a target that history repeats is masked and each is learned once.

Template: ``[SYS] t [/SYS]``, ``[INST] t [/INST]`` (user), ``<s>t</s>`` (assistant) and
``[ROLE r] t [/ROLE]`` (any other role).  Inside texts a backslash becomes ``\\0`` and the first
character of a control string ``\\1`` (square bracket) or ``\\2`` (angle); all are undone by
`unescape`.

Spans: with room R = budget - system - history, the prefix sums are cut into cells of R/2
tokens; a turn belongs to the cell in which it begins, and a turn above R/2 tokens stands
alone.  So a window keeps the budget unless a single turn is itself too long; such a turn
stays whole.

Defined cases: a null text or role is empty; rows with equal turn numbers are ordered by
role and text; repeated rows are repeated turns; a null conv_id is one conversation; an
empty table gives no windows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUDGET = 2048
HISTORY = 256
#: The template's control strings.
CONTROL = ("[INST]", "[/INST]", "[SYS]", "[/SYS]", "[ROLE", "[/ROLE]", "<s>", "</s>")
_TURNS = r"(?s)\[INST\] .*? \[/INST\]|\[SYS\] .*? \[/SYS\]|\[ROLE [^\]]*\] .*? \[/ROLE\]|<s>.*?</s>"


def escape(c: Column) -> Column:
    c = F.replace(c, F.lit("\\"), F.lit("\\0"))
    for s in CONTROL:
        c = F.replace(c, F.lit(s), F.lit(("\\1" if s[0] == "[" else "\\2") + s[1:]))
    return c


def unescape(c: Column) -> Column:
    for code, s in (("\\3", "]"), ("\\2", "<"), ("\\1", "["), ("\\0", "\\")):
        c = F.replace(c, F.lit(code), F.lit(s))
    return c


def tokens(text: Column) -> Column:
    """A token estimate that needs no tokenizer.

    A token for each started four of the ASCII letters and blanks, one for each other ASCII character, and
    one for each UTF-8 byte of all others, of which no byte-level vocabulary makes more; four for the marks.
    """
    others = F.regexp_replace(text, r"[A-Za-z\s]+", "")
    return F.ceil((F.length(text) - F.length(others)) / 4) + F.octet_length(others) + 4


def _marks(role: Column) -> tuple[Column, Column]:
    other = F.concat(F.lit("[ROLE "), F.replace(escape(role), F.lit("]"), F.lit("\\3")), F.lit("] "))
    before = F.when(role == "user", "[INST] ").when(role == "system", "[SYS] ").when(role == "assistant", "<s>").otherwise(other)
    after = F.when(role == "user", " [/INST]").when(role == "system", " [/SYS]").when(role == "assistant", "</s>").otherwise(" [/ROLE]")
    return before, after


def format_windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", tokens_col: str | None = None) -> DataFrame:
    """conv_id, window, text, n_repeated (turns that an earlier window has) and loss_spans (start, length in code points).

    ``tokens_col`` may name a column with the number of tokens of each turn's text, as an encoder counts them;
    without one, or where it is null, `tokens` estimates them.
    """
    size = tokens(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    size = size if tokens_col is None else F.coalesce(F.col(tokens_col) + 4, size)
    role, raw = F.coalesce(F.col(role_col).cast("string"), F.lit("")), F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    x = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), role.alias("role"), raw.alias("raw"), size.cast("long").alias("tok"))
    by_conv = Window.partitionBy("conv_id").orderBy("turn", "role", "raw")
    x = x.withColumn("pos", F.row_number().over(by_conv))
    before, after = _marks(F.col("role"))
    x = x.select(
        "conv_id", "pos",
        ((F.col("pos") == 1) & (F.col("role") == "system")).alias("lead"),
        (F.col("role") == "assistant").alias("target"),
        before.alias("before"), escape(F.col("raw")).alias("body"), after.alias("after"),
        "tok",
    )
    piece = F.struct("pos", "target", "before", "body", "after")
    so_far = Window.partitionBy("conv_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = F.when(F.col("lead"), F.lit(0)).otherwise(F.col("tok"))
    x = x.withColumn("begins", F.sum(own).over(so_far) - own)
    x = x.withColumn("system", F.first(F.when(F.col("lead"), piece)).over(so_far))
    x = x.withColumn("sys_tok", F.first(F.when(F.col("lead"), F.col("tok")).otherwise(F.lit(0))).over(so_far))
    cell = F.greatest(F.lit(1), F.floor((F.lit(budget - history) - F.col("sys_tok")) / 2))
    x = x.withColumn("big", ~F.col("lead") & (F.col("tok") > cell)).withColumn("cell", F.floor(F.col("begins") / cell))
    last = Window.partitionBy("conv_id").orderBy("pos")
    was_lead, was_big, was_cell = (F.lag(c).over(last) for c in ("lead", "big", "cell"))
    starts = was_cell.isNull() | (~was_lead & (F.col("big") | was_big | (F.col("cell") != was_cell)))
    x = x.withColumn("starts", starts)
    x = x.withColumn("window", F.sum(F.col("starts").cast("long")).over(so_far) - 1)
    near = Window.partitionBy("conv_id").orderBy("begins").rangeBetween(-history, -1)
    x = x.withColumn("past", F.collect_list(F.when(~F.col("lead"), piece)).over(near))
    x = x.withColumn("past", F.when(F.col("starts"), F.col("past")))
    # a window is bounded by the budget and one turn, so its pieces fit in one row
    w = x.groupBy("conv_id", "window").agg(
        F.sort_array(F.collect_list(F.struct("pos", "target", "before", "body", "after"))).alias("own"),
        F.first("past", ignorenulls=True).alias("past"),
        F.first("system").alias("system"),
    )
    led = F.when((F.col("window") > 0) & F.col("system").isNotNull(), F.array("system")).otherwise(F.slice(F.col("own"), 1, 0))
    w = w.select("conv_id", "window", F.concat(led, F.coalesce(F.sort_array("past"), F.slice("own", 1, 0))).alias("repeated"), "own")
    joined = lambda c: F.array_join(F.transform(c, lambda p: F.concat(p["before"], p["body"], p["after"])), "")
    size = lambda p: F.length(p["before"]) + F.length(p["body"]) + F.length(p["after"])
    w = w.withColumn("head", joined(F.col("repeated")))
    spans = F.aggregate(
        F.col("own"),
        F.struct(F.length("head").alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans")),
        lambda acc, p: F.struct(
            (acc["at"] + size(p)).alias("at"),
            F.when(p["target"], F.concat(acc["spans"], F.array(F.struct((acc["at"] + F.length(p["before"])).alias("start"), F.length(p["body"]).alias("length"))))).otherwise(acc["spans"]).alias("spans"),
        ),
        lambda acc: acc["spans"],
    )
    return w.select("conv_id", "window", F.concat("head", joined(F.col("own"))).alias("text"), F.size("repeated").alias("n_repeated"), spans.alias("loss_spans"))


def read_windows(windows: DataFrame) -> DataFrame:
    """conv_id, window, turns (role and text of the window's own turns) and loss (the unescaped text under the mask)."""
    found = F.regexp_extract_all("text", F.lit(_TURNS), F.lit(0))
    own = windows.select("conv_id", "window", "loss_spans", F.col("text").alias("formatted"), F.slice(found, F.col("n_repeated") + 1, F.greatest(F.size(found), F.lit(1))).alias("marked"))

    def turn(m: Column) -> Column:
        inner = lambda head, tail: F.substring(m, F.lit(head + 1), F.length(m) - F.lit(head + tail))
        name = F.regexp_extract(m, r"^\[ROLE ([^\]]*)\] ", 1)
        role = F.when(m.startswith("[INST]"), "user").when(m.startswith("[SYS]"), "system").when(m.startswith("<s>"), "assistant").otherwise(unescape(name))
        text = (
            F.when(m.startswith("[INST]"), inner(7, 8))
            .when(m.startswith("[SYS]"), inner(6, 7))
            .when(m.startswith("<s>"), inner(3, 4))
            .otherwise(F.substring(m, F.length(name) + 9, F.length(m) - F.length(name) - 16))
        )
        return F.struct(role.alias("role"), unescape(text).alias("text"))

    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["length"]))), "")
    return own.select("conv_id", "window", F.transform("marked", turn).alias("turns"), loss.alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"))


def digest(windows: DataFrame) -> DataFrame:
    """What the formatted windows hold, read back, one row for each conversation."""
    read = read_windows(windows).select(
        "conv_id", "window", "loss", "formatted_chars", F.size("turns").alias("n"),
        F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("said"),
    )
    parts = F.sort_array(F.collect_list(F.struct("window", "said", "loss")))
    conv = read.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), parts.alias("parts"), F.sum("formatted_chars").alias("formatted_chars"))
    whole = lambda field: F.array_join(F.transform("parts", lambda p: p[field]), "")
    return conv.select(
        "conv_id", "n_turns",
        F.sha2(whole("said"), 256).alias("turns_sha256"),
        F.length(whole("loss")).cast("long").alias("loss_chars"),
        F.sha2(whole("loss"), 256).alias("loss_sha256"),
        "formatted_chars",
    )
