"""Chat formatting in budgeted windows (DataFrame functions only).

Prefix sums of turn tokens cut a conversation at turns into windows that fit a token budget. Each window keeps the
conversation's system turn and repeats a limited stretch of the turns before it; repeated assistant turns are left
out of the loss mask, so each target is learnt once.

Template: ``<|role|>`` role ``<|text|>`` text ``<|end|>`` for each turn. ``<``, any backslashes and ``|`` inside a
role or text get one more backslash before the ``|``, which no marker has, and lose it again on reading.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from isohyet.llm.common import cut, n_words, table

BUDGET = 512
#: Turns of a conversation that one task orders together.
CHUNK = 256


def escape(x: Column) -> Column:
    return F.regexp_replace(F.coalesce(x, F.lit("")), r"<(\\*)\|", r"<$1\\|")


def unescape(x: Column) -> Column:
    return F.regexp_replace(x, r"<(\\*)\\\|", r"<$1|")


def piece(role: Column, text: Column) -> Column:
    return F.concat(F.lit("<|role|>"), escape(role), F.lit("<|text|>"), escape(text), F.lit("<|end|>"))


def windows(rows: DataFrame, budget: int = BUDGET) -> DataFrame:
    """(conv_id, turn, role, text) -> (conv_id, window, text, n_repeated, loss array<struct<start, length>>, n_tokens).

    Rows of a conversation are ordered by turn, role and text, nulls first; a null role or text is empty, rows with
    null conv_id form one conversation, equal rows are turns of their own, very long texts are kept whole. A turn counts
    its words and one. The first turn, if its role is system, is the system turn; what it leaves of the budget is the
    room. A turn longer than 3/8 of the room gets a window of its own, whole. A window holds at most the budget, unless
    the system turn and the one turn it is for are longer together. History takes at most a quarter of the room, and
    no more than is left. loss gives code point offsets of assistant texts, as escaped, that are not repeats. An empty
    table gives an empty table; further columns, also of the result's names, are ignored.

    With stride = 3/8 of the room, turns whose tokens begin in one stride share a window: at most two strides. A turn
    longer than the stride ends beyond it, so it is the last of its stride and can stand alone.
    """
    one = rows.select("conv_id", "turn", "role", "text").withColumns({"tok": n_words(F.col("text")) + 1, "chunk": F.floor(F.coalesce(F.col("turn"), F.lit(-1)) / CHUNK)})
    in_chunk = Window.partitionBy("conv_id", "chunk").orderBy(*[F.col(c).asc_nulls_first() for c in ("turn", "role", "text")])
    before = Window.partitionBy("__conv").orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = one.groupBy(F.col("conv_id").alias("__conv"), F.col("chunk").alias("__chunk")).agg(F.count("*").alias("n"), F.sum("tok").alias("tok_sum"), F.min(F.struct("turn", "role", "text", "tok")).alias("first"))
    first = F.first("first").over(Window.partitionBy("__conv").orderBy("__chunk"))
    meta = chunks.select("__conv", "__chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rank0"), F.coalesce(F.sum("tok_sum").over(before), F.lit(0)).alias("tok0"), first.alias("head"))
    meta = meta.select("__conv", "__chunk", "rank0", "tok0", F.when(F.coalesce(F.col("head.role") == "system", F.lit(False)), F.col("head")).alias("sys"))
    x = one.withColumns({"r": F.row_number().over(in_chunk), "c": F.sum("tok").over(in_chunk.rowsBetween(Window.unboundedPreceding, -1))})
    x = x.join(meta, F.col("conv_id").eqNullSafe(F.col("__conv")) & (F.col("chunk") == F.col("__chunk"))).drop("__conv", "__chunk")
    sys_tok = F.coalesce(F.col("sys.tok"), F.lit(0))
    room = F.greatest(F.lit(budget) - sys_tok, F.lit(0))
    x = x.withColumns({"rank": F.col("rank0") + F.col("r"), "is_sys": F.col("sys").isNotNull() & (F.col("rank0") + F.col("r") == 1), "stride": F.greatest(F.floor(room * 3 / 8), F.lit(1)), "room": room, "history": F.floor(room / 4), "at": F.greatest(F.col("tok0") + F.coalesce("c", F.lit(0)) - sys_tok, F.lit(0))})
    x = x.withColumns({"block": F.when(F.col("is_sys"), F.lit(0)).otherwise(F.floor(F.col("at") / F.col("stride"))), "alone": F.when(~F.col("is_sys") & (F.col("tok") > F.col("stride")), 1).otherwise(0)})
    x = cut(x.select("conv_id", "rank", "is_sys", "stride", "room", "history", "at", "block", "alone", "tok", "role", "text"), "chat-turns")
    own = F.col("block") * 2 + F.col("alone")
    left = F.when(F.col("alone") == 1, F.greatest(F.least("history", F.col("room") - F.col("tok")), F.lit(0))).otherwise(F.col("history"))
    wins = x.groupBy("conv_id", own.alias("window")).agg(F.min("at").alias("start"), F.min(left).alias("left"))
    # A turn can be history only of the window alone at its stride's end and of the two of the next stride.
    near = (F.col("block") + 1) * F.col("stride") - F.col("at") <= F.col("history")
    short = (F.col("alone") == 0) & ~F.col("is_sys")
    to = F.concat(F.array(own), F.when(short, F.array(own + 1)).otherwise(F.array().cast("array<bigint>")), F.when(short & near, F.array(own + 2, own + 3)).otherwise(F.array().cast("array<bigint>")))
    seen = x.withColumn("own", own).withColumn("window", F.explode(to)).drop("stride", "room", "history", "block", "alone")
    w = wins.select(F.col("conv_id").alias("__conv"), F.col("window").alias("__window"), "start", "left")
    seen = seen.join(w, F.col("conv_id").eqNullSafe(F.col("__conv")) & (F.col("window") == F.col("__window"))).where((F.col("own") == F.col("window")) | (F.col("at") >= F.col("start") - F.col("left")))
    again = F.col("own") != F.col("window")
    # The system turn goes to every other window of its conversation, one row each.
    heads = x.where("is_sys").select(F.col("conv_id").alias("__conv"), "role", "text", "tok")
    kept = wins.where("window > 0").join(heads, F.col("conv_id").eqNullSafe(F.col("__conv"))).select("conv_id", "window", F.lit(1).cast("long").alias("rank"), F.lit(True).alias("again"), "role", "text", "tok")
    parts = seen.select("conv_id", "window", "rank", again.alias("again"), "role", "text", "tok").unionByName(kept)
    learnt = ~F.col("again") & F.coalesce(F.col("role") == "assistant", F.lit(False))
    parts = parts.select("conv_id", "window", "tok", F.struct("rank", "again", learnt.alias("learnt"), piece(F.col("role"), F.col("text")).alias("piece"), F.length(escape(F.col("text"))).alias("n")).alias("p"))
    full = parts.groupBy("conv_id", "window").agg(F.array_sort(F.collect_list("p")).alias("ps"), F.sum("tok").alias("n_tokens"))
    ends = F.transform("ps", lambda p, i: F.aggregate(F.slice("ps", F.lit(1), i + 1), F.lit(0), lambda a, q: a + F.length(q.piece)))
    spans = F.filter(F.transform("ps", lambda p, i: F.struct((F.element_at(F.col("ends"), i + 1) - F.lit(len("<|end|>")) - p.n).alias("start"), p.n.alias("length"), p.learnt.alias("on"))), lambda s: s.on)
    return full.withColumn("ends", ends).select(
        "conv_id", "window", F.array_join(F.transform("ps", lambda p: p.piece), "").alias("text"), F.size(F.filter("ps", lambda p: p.again)).alias("n_repeated"),
        F.transform(spans, lambda s: F.struct(s.start.alias("start"), s.length.alias("length"))).alias("loss"), "n_tokens",
    )


def read_turns(text: Column) -> Column:
    """Formatted text -> array<struct<role, text>>."""
    pieces = F.split(text, r"<\|end\|>")
    return F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), lambda p: F.struct(
        unescape(F.substring_index(F.substring_index(p, "<|text|>", 1), "<|role|>", -1)).alias("role"),
        unescape(F.substring_index(p, "<|text|>", -1)).alias("text"),
    ))


def op8_budgeted_windows(spark, sf_dir: str) -> DataFrame:
    """One row for each conversation, its figures read back from the formatted windows. See windows()."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.sql(f"SELECT -7L AS conv_id, turn, role, '{said}' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)")
    out = windows(rows.unionByName(more))
    turns = F.slice(F.col("turns"), F.col("n_repeated") + 1, F.greatest(F.size("turns") - F.col("n_repeated"), F.lit(0)))
    out = out.withColumn("turns", read_turns(F.col("text"))).withColumn("turns", turns)
    learnt = F.transform("loss", lambda s: unescape(F.substring(F.col("text"), s.start + 1, s.length)))
    read = out.select(
        "conv_id", F.length("text").alias("chars"), F.size("turns").alias("n"),
        F.struct("window", F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "").alias("said"), F.array_join(learnt, "").alias("learnt")).alias("w"),
    )
    whole = read.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"), F.array_sort(F.collect_list("w")).alias("ws"))
    joined = lambda f: F.array_join(F.transform("ws", f), "")
    return whole.withColumns({"said": joined(lambda w: w.said), "learnt": joined(lambda w: w.learnt)}).select(
        "conv_id", "n_turns", F.sha2(F.col("said").cast("binary"), 256).alias("turns_sha256"), F.length("learnt").cast("long").alias("loss_chars"),
        F.sha2(F.col("learnt").cast("binary"), 256).alias("loss_sha256"), F.col("formatted_chars").cast("long").alias("formatted_chars"),
    )


OP8_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
r AS (
  SELECT *, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) + 1 AS tok,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS rank FROM c),
s AS (
  SELECT *, coalesce(max(CASE WHEN rank = 1 AND role = 'system' THEN tok END) OVER (PARTITION BY conv_id), 0) AS sys_tok,
         sum(tok) OVER (PARTITION BY conv_id ORDER BY rank) - tok AS before FROM r),
x AS (
  SELECT *, rank = 1 AND sys_tok > 0 AS is_sys, greatest(512 - sys_tok, 0) AS room, greatest(before - sys_tok, 0) AS at_tok,
         length('<|role|><|text|><|end|>') + length(regexp_replace(coalesce(role, ''), '<(\\*)\|', '<\1\\|', 'g'))
         + length(regexp_replace(coalesce(text, ''), '<(\\*)\|', '<\1\\|', 'g')) AS chars FROM s),
y AS (SELECT *, greatest(room * 3 // 8, 1) AS stride, room // 4 AS history FROM x),
z AS (
  SELECT *, CASE WHEN is_sys THEN 0 ELSE at_tok // stride END AS block, CASE WHEN NOT is_sys AND tok > stride THEN 1 ELSE 0 END AS alone FROM y),
w AS (SELECT conv_id, block * 2 + alone AS win, min(at_tok) AS start_tok, min(CASE WHEN alone = 1 THEN greatest(least(history, room - tok), 0) ELSE history END) AS spare FROM z GROUP BY 1, 2),
o AS (
  SELECT conv_id, chars FROM z
  UNION ALL
  SELECT z.conv_id, chars FROM z JOIN w ON z.conv_id IS NOT DISTINCT FROM w.conv_id AND w.win BETWEEN block * 2 + 1 AND block * 2 + 3
  WHERE alone = 0 AND NOT is_sys AND at_tok >= start_tok - spare AND (w.win = block * 2 + 1 OR (block + 1) * stride - at_tok <= history)
  UNION ALL
  SELECT z.conv_id, chars FROM z JOIN w ON z.conv_id IS NOT DISTINCT FROM w.conv_id WHERE is_sys AND w.win > 0),
f AS (SELECT conv_id, CAST(sum(chars) AS BIGINT) AS formatted_chars FROM o GROUP BY 1),
t AS (
  SELECT conv_id, count(*) AS n_turns, sha256(string_agg(coalesce(role, '') || chr(10) || coalesce(text, '') || chr(10), '' ORDER BY rank)) AS turns_sha256,
         coalesce(string_agg(text, '' ORDER BY rank) FILTER (WHERE role = 'assistant'), '') AS learnt FROM r GROUP BY 1)
SELECT t.conv_id, n_turns, turns_sha256, length(learnt) AS loss_chars, sha256(learnt) AS loss_sha256, formatted_chars
FROM t JOIN f ON t.conv_id IS NOT DISTINCT FROM f.conv_id
"""
