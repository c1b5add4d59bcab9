"""Chat formatting in token-budgeted windows, in DataFrame operations alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quirework.llm.common import written

#: The marks of the template.
START, END = "<|im_start|>", "<|im_end|>"
#: What a text must not hold as it is: a head, any backslashes, and a rest that makes a control string of a usual template.
CONTROL = r"([<\[])(\\*)(\||/?s>|<SYS>>|</SYS>>|/?INST\])"
ESCAPED = r"([<\[])\\(\\*)(\||/?s>|<SYS>>|</SYS>>|/?INST\])"
#: What counts as a token of the ASCII characters of a text: up to eight letters, up to three digits, or another one that
#: isn't blank. Other characters count a token for each of their UTF-8 bytes, the most that byte-level vocabularies make
#: of them, so unspaced scripts fill a window no less than spaced ones.
TOKEN, OTHER = r"[A-Za-z]{1,8}|[0-9]{1,3}|[!-/:-@\[-`{-~\x00-\x08\x0E-\x1F\x7F]", r"[\x00-\x7F]"
#: Tokens that a turn's marks take.
MARKS = 4
#: Turns whose numbers share this quotient are numbered together; a long conversation has many such blocks.
TURNS_PER_BLOCK = 256


def escape(text: Column) -> Column:
    """One backslash more after the head of every control string; unescape takes it away again."""
    return F.regexp_replace(text, CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$2$3")


def _escape_role(role: Column) -> Column:
    for char, code in (("%", "%25"), ("\n", "%0A"), ("<", "%3C"), ("[", "%5B")):
        role = F.replace(role, F.lit(char), F.lit(code))
    return role


def _unescape_role(role: Column) -> Column:
    for char, code in (("\n", "%0A"), ("<", "%3C"), ("[", "%5B"), ("%", "%25")):
        role = F.replace(role, F.lit(code), F.lit(char))
    return role


def _numbered(turns: DataFrame) -> DataFrame:
    """Each row with its tokens, the tokens before it in its conversation, and what the first row says if it is a system turn.

    Running sums go block by block, so no task holds all rows of a long conversation.
    """
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    beyond = F.octet_length("text") - F.regexp_count("text", F.lit(OTHER))
    rows = rows.withColumn("tokens", (F.regexp_count("text", F.lit(TOKEN)) + beyond + MARKS).cast("long"))
    rows = rows.withColumn("block", F.coalesce(F.floor(F.col("turn") / TURNS_PER_BLOCK), F.lit(2**62)).cast("long"))
    order = F.struct(F.col("turn").isNull(), "turn", "role", "text")
    blocks = rows.groupBy("conv_id", "block").agg(F.count("*").alias("n"), F.sum("tokens").alias("sum"), F.min_by(F.struct("role", "text", "tokens"), order).alias("first"))
    by_block = Window.partitionBy("conv_id").orderBy("block")
    before = by_block.rowsBetween(Window.unboundedPreceding, 0)
    blocks = blocks.select(
        F.col("conv_id").alias("b_conv"),
        F.col("block").alias("b_block"),
        (F.sum("n").over(before) - F.col("n")).alias("rows_before"),
        (F.sum("sum").over(before) - F.col("sum")).alias("tokens_before"),
        F.first("first").over(before).alias("head"),
    )
    inside = Window.partitionBy("conv_id", "block").orderBy(F.col("turn").asc_nulls_last(), "role", "text")
    rows = rows.withColumn("seq", F.row_number().over(inside)).withColumn("upto", F.sum("tokens").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.join(blocks, rows["conv_id"].eqNullSafe(blocks["b_conv"]) & (rows["block"] == blocks["b_block"]))
    system = F.when(F.col("head.role") == "system", F.col("head"))
    return rows.select(
        "conv_id", "role", "text", "tokens",
        (F.col("rows_before") + F.col("seq")).alias("seq"),
        (F.col("tokens_before") + F.col("upto") - F.col("tokens")).alias("start"),
        (F.col("tokens_before") + F.col("upto")).alias("stop"),
        system.alias("system"),
    )


def format_windows(turns: DataFrame, budget: int = 1024, history: int = 192) -> DataFrame:
    """Format conversations as windows of at most budget tokens, a row a window.

    turns: conv_id, turn, role, text; other columns are ignored. A window is made of whole turns: first the
    conversation's system turn (when its first row has that role) and up to history tokens of the turns just before,
    both masked, then turns that no earlier window has. Windows follow from prefix sums of turn tokens: the tokens of a
    conversation are cut into strides, a turn belongs to the stride in which it starts, and the one turn that may pass
    the end of its stride opens a window of its own where it would pass the budget. Only a turn that is over the budget
    with its system turn makes a window that is. The loss mask covers each assistant text once.
    Tokens are bounds of our own (see TOKEN), not those of one vocabulary.

    Rows go by turn, null last, then role and text; null texts and roles are empty; null conv_id is a conversation; an
    empty table gives no windows. Returns conv_id, window (a number that orders a conversation's windows), formatted,
    context_turns (masked turns in front), loss_spans (array of start, length, in code points), tokens.
    """
    rows = _numbered(turns)
    spare = F.lit(budget - history) - F.coalesce(F.col("system.tokens"), F.lit(0))
    rows = rows.withColumn("stride", F.greatest(spare, F.lit(max(budget // 4, history, 1))).cast("long"))
    rows = rows.withColumn("cell", F.floor(F.col("start") / F.col("stride")))
    rows = rows.withColumn("cell_start", F.min("start").over(Window.partitionBy("conv_id", "cell")))
    own = (F.col("stop") - F.col("cell_start") > F.col("stride")) & (F.col("start") > F.col("cell_start"))
    rows = written(rows.withColumn("window", F.col("cell") * 2 + own.cast("long")).drop("cell_start"), "chat-rows")

    fresh = rows.select("conv_id", "window", F.lit(2).alias("part"), "seq", "role", "text", "tokens", (F.col("role") == "assistant").alias("loss"))
    windows = rows.groupBy("conv_id", "window", "cell").agg(F.min("start").alias("first"), F.min("seq").alias("first_seq"), F.sum("tokens").alias("new"), F.any_value("system").alias("system"))
    kept = windows.filter(F.col("system").isNotNull() & (F.col("first_seq") > 1)).select("conv_id", "window", F.lit(0).alias("part"), F.lit(1).cast("long").alias("seq"), F.col("system.role").alias("role"), F.col("system.text").alias("text"), F.col("system.tokens").alias("tokens"), F.lit(False).alias("loss"))
    # A turn can be history of the windows that start within its reach: those of its own stride and of the next ones.
    reach = rows.filter(~(F.col("system").isNotNull() & (F.col("seq") == 1)) & (F.col("tokens") <= history))
    reach = reach.withColumn("of_cell", F.explode(F.sequence("cell", F.floor((F.col("start") + history) / F.col("stride")))))
    targets = windows.select(F.col("conv_id").alias("w_conv"), F.col("cell").alias("w_cell"), F.col("window").alias("w"), "first", F.least(F.lit(history), F.lit(budget) - F.coalesce(F.col("system.tokens"), F.lit(0)) - F.col("new")).alias("room"))
    old = reach.join(targets, reach["conv_id"].eqNullSafe(targets["w_conv"]) & (F.col("of_cell") == F.col("w_cell")) & (F.col("w") > F.col("window")) & (F.col("stop") <= F.col("first")) & (F.col("start") + F.col("room") >= F.col("first")))
    old = old.select("conv_id", F.col("w").alias("window"), F.lit(1).alias("part"), "seq", "role", "text", "tokens", F.lit(False).alias("loss"))

    parts = fresh.unionByName(kept).unionByName(old)
    head = F.concat(F.lit(START), _escape_role(F.col("role")), F.lit("\n"))
    parts = parts.withColumn("head", head).withColumn("body", escape(F.col("text")))
    parts = parts.withColumn("turn", F.struct("part", "seq", F.concat("head", "body", F.lit(f"{END}\n")).alias("said"), F.length("head").alias("lead"), F.length("body").alias("length"), "loss"))
    out = parts.groupBy("conv_id", "window").agg(F.array_sort(F.collect_list("turn")).alias("turns"), F.sum("tokens").alias("tokens"))
    offsets = F.aggregate(
        "turns",
        F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,length:int>>)").alias("spans")),
        lambda a, t: F.struct(
            (a["at"] + F.length(t["said"])).alias("at"),
            F.when(t["loss"], F.concat(a["spans"], F.array(F.struct((a["at"] + t["lead"]).alias("start"), t["length"].alias("length"))))).otherwise(a["spans"]).alias("spans"),
        ),
        lambda a: a["spans"],
    )
    return out.select(
        "conv_id", "window",
        F.array_join(F.transform("turns", lambda t: t["said"]), "").alias("formatted"),
        F.size(F.filter("turns", lambda t: t["part"] < 2)).alias("context_turns"),
        offsets.alias("loss_spans"),
        "tokens",
    )


def read_back(windows: DataFrame) -> DataFrame:
    """The turns (array of role, text, masked ones left out) and the loss text of each window, from its output alone."""
    marks = F.split("formatted", START.replace("|", r"\|"))
    parts = F.slice(marks, F.col("context_turns") + 2, F.greatest(F.size(marks) - F.col("context_turns") - 1, F.lit(0)))
    role = lambda p: F.substring_index(p, "\n", 1)
    turns = F.transform(parts, lambda p: F.struct(_unescape_role(role(p)).alias("role"), unescape(p.substr(F.length(role(p)) + 2, F.length(p) - F.length(role(p)) - 2 - len(END))).alias("text")))
    loss = F.transform("loss_spans", lambda s: unescape(F.col("formatted").substr(s["start"] + 1, s["length"])))
    return windows.withColumn("turns", turns).withColumn("loss_text", F.array_join(loss, ""))


def digests(windows: DataFrame) -> DataFrame:
    """A row a conversation: digests of its turns and of its loss text, as the windows read back."""
    back = read_back(windows).select(
        "conv_id",
        F.struct("window", F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("said"), "loss_text").alias("w"),
        F.size("turns").alias("n"),
        F.length("formatted").cast("long").alias("chars"),
    )
    whole = back.groupBy("conv_id").agg(F.array_sort(F.collect_list("w")).alias("ws"), F.sum("n").cast("long").alias("n_turns"), F.sum("chars").cast("long").alias("formatted_chars"))
    joined = lambda field: F.array_join(F.transform("ws", lambda w: w[field]), "")
    whole = whole.withColumn("said", joined("said")).withColumn("loss", joined("loss_text"))
    return whole.select("conv_id", "n_turns", F.sha2("said", 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return digests(format_windows(turns.unionByName(extra)))
