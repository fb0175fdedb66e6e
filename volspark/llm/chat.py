"""Chat formatting in DataFrame operations only: budgeted, turn-aligned windows with a loss mask.

A turn is ``<|im_start|>role<|im_sep|>text<|im_end|>``; a turn that a later window repeats starts with
``<|im_repeat|>`` instead. Inside roles and texts a backslash is doubled, and one is put into each control
string (``<|``, ``<s>``, ``</s>``, ``[INST]``, ``<<SYS>>`` ...) behind its first character; as other backslashes
are doubled, a single one marks an escape and both steps can be undone.

Windows come from prefix sums of turn tokens (a quarter of the characters of the formatted turn, rounded up). Of the ``budget``
tokens of a window, the system turn and up to ``history`` tokens of the turns before it are set aside; what is left is
the capacity for own turns. Turns of more than half of it are windows of their own. With q the largest of the others,
turns whose start lies in the same slice of capacity - q tokens form a window, so their sum is within the capacity and no turn is ever
cut. Each later window repeats the system turn and those turns of the window before it that end within what the budget still
holds, ``history`` tokens at most; repeated turns are never loss targets. So every turn is own turn of exactly one window, every
assistant text is under the loss mask once, and a window keeps to its budget unless one own turn alone exceeds it.

The only shuffle is by conversation; windows and the read-back reuse that partitioning. Prefix sums are sorted
running windows (constant memory, spilled where needed); the digest of a conversation needs its whole text in one row.

Defined cases: null role or text is empty; turns are ordered by turn (null first), role, text; repeated rows are
turns of their own; rows with null conv_id form one conversation; a very long text is one turn and one window, never cut; a system turn of
more than half the budget is not repeated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from volspark.llm.common import table

START, REPEAT, SEP, END = "<|im_start|>", "<|im_repeat|>", "<|im_sep|>", "<|im_end|>"
_CONTROL = r"(\||/?s>|/?INST\]|/?<?/?SYS>>)"


def escape(c: Column) -> Column:
    return F.regexp_replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), rf"([<\[]){_CONTROL}", r"$1\\$2")


def unescape(c: Column) -> Column:
    return F.replace(F.regexp_replace(c, rf"([<\[])\\{_CONTROL}", "$1$2"), F.lit("\\\\"), F.lit("\\"))


def format_conversations(turns: DataFrame, budget: int = 2048, history: int = 512) -> DataFrame:
    """turns: conv_id, turn, role, text. Returns a row per window: conv_id, win, formatted, loss_spans (start, len in characters)."""
    if not 0 <= history <= budget:
        raise ValueError("history must lie within 0 and budget")
    t = turns.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    t = t.withColumn("n", F.ceil((F.lit(len(REPEAT) + len(SEP) + len(END)) + F.length(escape(F.col("role"))) + F.length(escape(F.col("text")))) / 4))
    conv, whole = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text"), Window.partitionBy("conv_id")
    t = t.withColumn("pos", F.row_number().over(conv)).withColumn("head", F.first(F.struct("role", "text", "n")).over(conv))
    t = t.withColumn("stop", F.sum("n").over(conv.rowsBetween(Window.unboundedPreceding, 0))).withColumn("start", F.col("stop") - F.col("n"))
    t = t.withColumn("system_n", F.when((F.col("head.role") == "system") & (F.col("head.n") * 2 <= budget), F.col("head.n")).otherwise(0))
    t = t.withColumn("before", F.least(F.lit(history), F.floor((F.lit(budget) - F.col("system_n")) / 2)))
    t = t.withColumn("room", F.lit(budget) - F.col("system_n") - F.col("before")).withColumn("alone", F.col("n") * 2 > F.col("room"))
    t = t.withColumn("slice", F.floor(F.col("start") / (F.col("room") - F.coalesce(F.max(F.when(~F.col("alone"), F.col("n"))).over(whole), F.lit(0)))))
    place = Window.partitionBy("conv_id").orderBy("pos")
    last = lambda c: F.lag(c).over(place)
    opens = (F.col("pos") == 1) | F.col("alone") | last("alone") | (last("slice") != F.col("slice"))
    t = t.withColumn("opens", opens).withColumn("win", F.sum(F.col("opens").cast("long")).over(place.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    own = Window.partitionBy("conv_id", "win")
    t = t.withColumn("own_n", F.sum("n").over(own))
    t = t.withColumn("keeps", (F.col("win") > 0) & (F.col("system_n") > 0) & (F.col("system_n") + F.col("own_n") <= budget))
    left = F.lit(budget) - F.col("own_n") - F.when(F.col("keeps"), F.col("system_n")).otherwise(0)
    # for the turns of a window: from which token on they are history of the next
    since = F.col("start") - F.greatest(F.lit(0), F.least(F.col("before"), left))
    t = t.withColumn("next_since", F.min(F.when(F.col("opens"), since)).over(Window.partitionBy("conv_id").orderBy("win").rangeBetween(1, 1)))
    is_head = (F.col("pos") == 1) & (F.col("role") == "system")
    piece = lambda win, rank, repeat, role, text: F.struct(win.alias("win"), F.lit(rank).alias("rank"), F.col("pos"), F.lit(repeat).alias("repeat"), role.alias("role"), text.alias("text"))
    own = piece(F.col("win"), 2, False, F.col("role"), F.col("text"))
    again = F.when((F.col("start") >= F.col("next_since")) & ~is_head, piece(F.col("win") + 1, 1, True, F.col("role"), F.col("text")))
    kept = F.when(F.col("opens") & F.col("keeps"), piece(F.col("win"), 0, True, F.col("head.role"), F.col("head.text")))
    rows = t.select("conv_id", F.explode(F.array_compact(F.array(own, again, kept))).alias("p")).select("conv_id", F.col("p.win").alias("win"), "p")
    parts = rows.groupBy("conv_id", "win").agg(F.sort_array(F.collect_list(F.struct("p.rank", "p.pos", "p.repeat", "p.role", "p.text"))).alias("ps"))
    marked = F.transform("ps", lambda p: F.struct(F.concat(F.when(p["repeat"], REPEAT).otherwise(START), escape(p["role"]), F.lit(SEP)).alias("head"), escape(p["text"]).alias("body"), (~p["repeat"] & (p["role"] == "assistant")).alias("target")))
    parts = parts.select("conv_id", "win", marked.alias("ms"))
    step = lambda a, m: F.struct(
        (a["at"] + F.length(m["head"]) + F.length(m["body"]) + len(END)).cast("long").alias("at"),
        F.when(m["target"], F.concat(a["spans"], F.array(F.struct((a["at"] + F.length(m["head"])).cast("long").alias("start"), F.length(m["body"]).cast("long").alias("len"))))).otherwise(a["spans"]).alias("spans"),
    )
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.expr("cast(array() as array<struct<start:bigint,len:bigint>>)").alias("spans"))
    text = F.array_join(F.transform("ms", lambda m: F.concat(m["head"], m["body"], F.lit(END))), "")
    return parts.select("conv_id", "win", text.alias("formatted"), F.aggregate("ms", zero, step, lambda a: a["spans"]).alias("loss_spans"))


def read_back(windows: DataFrame) -> DataFrame:
    """Own turns (role, text) and loss texts of each window, from its formatted text and spans: conv_id, win, formatted, turns, loss."""
    segments = F.filter(F.split("formatted", r"<\|im_end\|>", -1), lambda s: F.startswith(s, F.lit(START)))
    turn = lambda s: F.struct(unescape(F.substr(F.substring_index(s, SEP, 1), F.lit(len(START) + 1))).alias("role"), unescape(F.substring_index(s, SEP, -1)).alias("text"))
    loss = F.transform("loss_spans", lambda s: unescape(F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), s["len"].cast("int"))))
    return windows.select("conv_id", "win", "formatted", F.transform(segments, turn).alias("turns"), loss.alias("loss"))


def digests(back: DataFrame) -> DataFrame:
    per = back.select("conv_id", "win", F.size("turns").alias("n"), F.length("formatted").alias("f"), F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("t"), F.array_join("loss", "").alias("l"))
    all_of = per.groupBy("conv_id").agg(F.sum("n").cast("long").alias("n_turns"), F.sum("f").cast("long").alias("formatted_chars"), F.sum(F.length("l")).cast("long").alias("loss_chars"), F.sort_array(F.collect_list(F.struct("win", "t", "l"))).alias("ws"))
    joined = lambda k: F.sha2(F.array_join(F.transform("ws", lambda w: w[k]), "").cast("binary"), 256)
    return all_of.select("conv_id", "n_turns", joined("t").alias("turns_sha256"), "loss_chars", joined("l").alias("loss_sha256"), "formatted_chars")


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.sql(f"select * from values (-1L, 0L, 'user', '{said}'), (-1L, 1L, 'assistant', '{said}') as t(conv_id, turn, role, text)")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return digests(read_back(format_conversations(turns)))


_CONTROL_SQL = r"([<\[])(\||/?s>|/?INST\]|/?<?/?SYS>>)"


def _escaped_length(column: str) -> str:
    return rf"length(regexp_replace(replace({column}, '\', '\\'), '{_CONTROL_SQL}', '\1\\\2', 'g'))"


OP7_SQL = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
z AS (SELECT *, {_escaped_length("role")} + {_escaped_length("text")} AS size FROM t),
o AS (SELECT *, CAST(ceil(({len(REPEAT) + len(SEP) + len(END)} + size) / 4) AS BIGINT) AS n, row_number() OVER w AS pos FROM z WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
p AS (SELECT *, sum(n) OVER w - n AS start, first_value(CASE WHEN role = 'system' THEN n ELSE 0 END) OVER w AS head_n, first_value(role) OVER w AS head_role, first_value(size) OVER w AS head_size FROM o WINDOW w AS (PARTITION BY conv_id ORDER BY pos)),
q AS (SELECT *, CASE WHEN head_n * 2 <= 2048 THEN head_n ELSE 0 END AS system_n FROM p),
r AS (SELECT *, least(512, (2048 - system_n) // 2) AS before FROM q),
a AS (SELECT *, n * 2 > 2048 - system_n - before AS alone FROM r),
l AS (SELECT *, start // (2048 - system_n - before - coalesce(max(n) FILTER (WHERE NOT alone) OVER (PARTITION BY conv_id), 0)) AS slice FROM a),
e AS (SELECT *, pos = 1 OR alone OR coalesce(lag(alone) OVER w, false) OR coalesce(lag(slice) OVER w <> slice, true) AS opens FROM l WINDOW w AS (PARTITION BY conv_id ORDER BY pos)),
v AS (SELECT *, CAST(sum(opens::INTEGER) OVER (PARTITION BY conv_id ORDER BY pos) AS BIGINT) - 1 AS win FROM e),
s AS (SELECT *, sum(n) OVER (PARTITION BY conv_id, win) AS own_n, win > 0 AND system_n > 0 AND system_n + sum(n) OVER (PARTITION BY conv_id, win) <= 2048 AS keeps FROM v),
f AS (SELECT conv_id, win, keeps, head_size, start - greatest(0, least(before, 2048 - own_n - CASE WHEN keeps THEN system_n ELSE 0 END)) AS since FROM s WHERE opens),
own AS (SELECT conv_id, sum({len(START) + len(SEP) + len(END)} + size) AS c FROM s GROUP BY conv_id),
again AS (SELECT s.conv_id, sum({len(REPEAT) + len(SEP) + len(END)} + size) AS c FROM s JOIN f ON f.conv_id = s.conv_id AND f.win = s.win + 1
          WHERE s.start >= f.since AND NOT (s.pos = 1 AND s.role = 'system') GROUP BY s.conv_id),
kept AS (SELECT conv_id, sum({len(REPEAT) + len(SEP) + len(END)} + head_size) AS c FROM f WHERE keeps GROUP BY conv_id),
d AS (SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
             coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256
      FROM s GROUP BY conv_id)
SELECT d.conv_id, n_turns, turns_sha256, CAST(loss_chars AS BIGINT) AS loss_chars, loss_sha256, CAST(own.c + coalesce(again.c, 0) + coalesce(kept.c, 0) AS BIGINT) AS formatted_chars
FROM d JOIN own USING (conv_id) LEFT JOIN again USING (conv_id) LEFT JOIN kept USING (conv_id)
"""
