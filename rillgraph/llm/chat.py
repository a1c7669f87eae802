"""Chat formatting in budgeted windows, in DataFrame functions only.

Template: a turn is `<s>[role]text</s>`. In roles and texts `~`, `<`, `[` and `]` become `~0`, `~1`, `~2`, `~3`, so no control
string can occur in them, and the way back is exact.

Windows: a turn costs TURN_TOKENS plus a quarter of its characters (rounded up; a stand-in for a tokenizer's count). A leading
system turn is retained in every window; what it leaves of the budget is the room. A quarter of the room, at most
HISTORY_BUDGET, is for history and half of the rest is the stride: the prefix sum of costs says in which stride a turn
begins, and a turn that costs more than a stride has a span of its own. A window is the system turn, up to HISTORY turns
before its span (what fits beside it), then the span, so system, history and span together cost at most BUDGET, unless the
system turn and one single turn are longer already (turns are never cut): such windows repeat no history and say
`over_budget`. Only the span's assistant turns are under the loss mask: what is repeated is masked, so every assistant text is
a target exactly once.

Turns stay rows until a window's text is made: a turn knows its window and the windows that repeat it, and a window's rows are
grouped. Only digests() joins a conversation, once, because its text must be hashed as one. Turns are ordered by (turn, role,
text).

Defined results: null texts and roles are empty; null turns sort first; repeated rows are repeated turns; rows of a null
conv_id are one conversation; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUDGET, TURN_TOKENS, HISTORY, HISTORY_BUDGET = 1024, 4, 2, 256
ESCAPES = [("~", "~0"), ("<", "~1"), ("[", "~2"), ("]", "~3")]


def escape(text: Column) -> Column:
    for plain, marked in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(marked))
    return text


def unescape(text: Column) -> Column:
    for plain, marked in reversed(ESCAPES):
        text = F.replace(text, F.lit(marked), F.lit(plain))
    return text


def placed(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY, history_budget: int = HISTORY_BUDGET) -> DataFrame:
    """Turns with k (place in the conversation), cost, window (from 0) and `also`: the later windows that repeat them as history."""
    turns = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("body"))
    own = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "body")
    turns = (
        turns.withColumn("k", F.row_number().over(own) - 1)
        .withColumn("cost", (TURN_TOKENS + F.floor((F.length("body") + 3) / 4)).cast("long"))
        .withColumn("system_cost", F.first(F.when(F.col("role") == "system", F.col("cost"))).over(own))
        .withColumn("room", F.greatest(budget - F.coalesce("system_cost", F.lit(0)), F.lit(0)))
        .withColumn("aside", F.least(F.lit(history_budget), F.floor(F.col("room") / 4)))
        .withColumn("stride", F.greatest(F.floor((F.col("room") - F.col("aside")) / 2), F.lit(1)))
        .withColumn("is_system", (F.col("k") == 0) & F.col("system_cost").isNotNull())
        .withColumn("spent", F.when(F.col("is_system"), 0).otherwise(F.col("cost")))
        .withColumn("before", F.sum("spent").over(own) - F.col("spent"))
        .withColumn("long", (F.col("spent") > F.col("stride")).cast("int"))
        .withColumn("place", F.struct((2 * F.sum("long").over(own) - F.col("long")).alias("apart"), F.floor(F.col("before") / F.col("stride")).alias("bin")))
    )
    after_system = (F.col("k") == 1) & F.col("system_cost").isNotNull()  # the first span begins behind the system turn
    moved = (F.col("k") == 0) | ((F.col("place") != F.lag("place").over(own)) & ~after_system)
    aside = F.when(F.col("long") == 1, F.least("aside", F.greatest(F.col("room") - F.col("spent"), F.lit(0)))).otherwise(F.col("aside"))
    turns = turns.withColumn("begins", moved).withColumn("window", F.sum(F.col("begins").cast("int")).over(own) - 1)
    turns = turns.withColumn("start", F.when(F.col("begins"), F.struct("window", (F.col("before") - aside).alias("reach"))))
    nexts = [F.lead("start", d).over(own) for d in range(1, history + 1)]
    also = F.filter(F.array(*nexts) if nexts else F.array(F.lit(None).cast("struct<window:bigint,reach:bigint>")), lambda s: s.isNotNull() & (F.col("before") >= s["reach"]) & ~F.col("is_system"))
    return turns.withColumn("also", F.transform(also, lambda s: s["window"]))


def windows(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY, history_budget: int = HISTORY_BUDGET) -> DataFrame:
    """One row per window: conv_id, window (from 0), text, n_repeated (turns before its span), loss (array of start, length in code points), tokens, over_budget."""
    own = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "body")
    turns = placed(conversations, budget, history, history_budget)
    head = F.concat(F.lit("<s>["), escape(F.col("role")), F.lit("]"))
    turn = F.struct("k", "cost", F.col("role").alias("role"), head.alias("head"), escape(F.col("body")).alias("escaped"))
    turns = turns.withColumn("t", turn).withColumn("system", F.when(F.col("begins") & (F.col("k") > 0) & F.col("system_cost").isNotNull(), F.first("t").over(own)))
    copy = lambda window, again, t: F.struct(window.cast("long").alias("window"), F.lit(again).alias("again"), t.alias("t"))
    copies = F.concat(
        F.array(copy(F.col("window"), False, F.col("t"))),
        F.transform("also", lambda w: copy(w, True, F.col("t"))),
        F.filter(F.array(copy(F.col("window"), True, F.col("system"))), lambda c: c["t"].isNotNull()),
    )
    rows = turns.select("conv_id", F.explode(copies).alias("c")).select("conv_id", "c.window", "c.again", "c.t.*")
    inside = Window.partitionBy("conv_id", "window").orderBy("k")
    size = F.length("head") + F.length("escaped") + 4
    rows = rows.withColumn("at", F.sum(size).over(inside) - size)
    target = F.when(~F.col("again") & (F.col("role") == "assistant"), F.struct((F.col("at") + F.length("head")).cast("int").alias("start"), F.length("escaped").alias("length")))
    piece = F.struct("k", F.concat("head", "escaped", F.lit("</s>")).alias("piece"))
    found = rows.groupBy("conv_id", "window").agg(
        F.array_sort(F.collect_list(piece)).alias("pieces"), F.count_if("again").cast("int").alias("n_repeated"), F.array_sort(F.collect_list(target)).alias("loss"), F.sum("cost").alias("tokens")
    )
    return found.select("conv_id", "window", F.array_join(F.transform("pieces", lambda p: p["piece"]), "").alias("text"), "n_repeated", "loss", "tokens", (F.col("tokens") > budget).alias("over_budget"))


def digests(formatted: DataFrame) -> DataFrame:
    """Per conversation, read back from windows(): n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    pieces = F.split(F.col("text"), "</s>")
    own = F.slice(pieces, F.col("n_repeated") + 1, F.size(pieces) - 1 - F.col("n_repeated"))
    plain = F.transform(own, lambda p: F.concat(unescape(F.regexp_extract(p, r"(?s)^<s>\[([^\]]*)\]", 1)), F.lit("\n"), unescape(F.regexp_extract(p, r"(?s)^<s>\[[^\]]*\](.*)$", 1)), F.lit("\n")))
    masked = F.transform("loss", lambda s: unescape(F.substring(F.col("text"), s["start"] + 1, s["length"])))
    rows = formatted.select("conv_id", F.struct("window", F.size(own).alias("n"), F.array_join(plain, "").alias("plain"), F.array_join(masked, "").alias("masked"), F.length("text").alias("chars")).alias("w"))
    convs = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("w")).alias("w"))
    joined = lambda field: F.array_join(F.transform("w", lambda w: w[field]), "")
    total = lambda field: F.aggregate("w", F.lit(0).cast("long"), lambda acc, w: acc + w[field])
    loss = joined("masked")
    return convs.select(
        "conv_id", total("n").alias("n_turns"), F.sha2(joined("plain").cast("binary"), 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"), total("chars").alias("formatted_chars"),
    )


def oracle() -> str:
    """DuckDB SQL for digests(windows(conversations with conversation -1))."""
    probe = "</s>[INST] ok [/INST]"
    esc = lambda c: f"replace(replace(replace(replace({c}, '~', '~0'), '<', '~1'), '[', '~2'), ']', '~3')"
    own = "PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, body"
    return f"""
WITH rows_ AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS body FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '{probe}'), (-1, 1, 'assistant', '{probe}')),
costed AS (SELECT *, row_number() OVER ({own}) - 1 AS k, {TURN_TOKENS} + (length(body) + 3) // 4 AS cost,
  length({esc("role")}) + 5 + length({esc("body")}) + 4 AS size FROM rows_),
firsts AS (SELECT conv_id, cost AS system_cost, size AS system_size FROM costed WHERE k = 0 AND role = 'system'),
shares AS (SELECT c.*, system_cost IS NOT NULL AS has_system, greatest({BUDGET} - coalesce(system_cost, 0), 0) AS room,
  coalesce(system_size, 0) AS system_size FROM costed c LEFT JOIN firsts f ON c.conv_id IS NOT DISTINCT FROM f.conv_id),
strides AS (SELECT *, least({HISTORY_BUDGET}, room // 4) AS aside, greatest((room - least({HISTORY_BUDGET}, room // 4)) // 2, 1) AS stride,
  CASE WHEN has_system AND k = 0 THEN 0 ELSE cost END AS spent FROM shares),
sums AS (SELECT *, sum(spent) OVER ({own}) - spent AS before_, 2 * sum((spent > stride)::INT) OVER ({own}) - (spent > stride)::INT AS apart FROM strides),
spots AS (SELECT *, CASE WHEN has_system AND k = 0 THEN NULL ELSE apart END AS a, CASE WHEN has_system AND k = 0 THEN NULL ELSE before_ // stride END AS b FROM sums),
spans AS (SELECT conv_id, a, b, min(k) AS first_, min(before_) AS reach, sum(size) AS own_size,
  any_value(CASE WHEN spent > stride THEN least(aside, greatest(room - spent, 0)) ELSE aside END) AS aside, any_value(system_size) AS system_size
  FROM spots WHERE NOT (has_system AND k = 0) GROUP BY ALL),
repeated AS (SELECT s.conv_id, s.first_, sum(p.size) AS more FROM spans s JOIN spots p ON p.conv_id IS NOT DISTINCT FROM s.conv_id AND p.k < s.first_
  AND NOT (p.has_system AND p.k = 0) AND p.k >= s.first_ - {HISTORY} AND p.before_ >= s.reach - s.aside GROUP BY ALL),
lone AS (SELECT conv_id, system_size AS chars FROM firsts ANTI JOIN spans USING (conv_id)),
parts AS (SELECT s.conv_id, own_size + system_size + coalesce(more, 0) AS chars FROM spans s LEFT JOIN repeated r ON s.conv_id IS NOT DISTINCT FROM r.conv_id AND s.first_ = r.first_
  UNION ALL SELECT * FROM lone),
sizes AS (SELECT conv_id, sum(chars)::BIGINT AS formatted_chars FROM parts GROUP BY ALL),
texts AS (SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || body || chr(10), '' ORDER BY turn NULLS FIRST, role, body)) AS turns_sha256,
  coalesce(string_agg(body, '' ORDER BY turn NULLS FIRST, role, body) FILTER (role = 'assistant'), '') AS loss FROM rows_ GROUP BY ALL)
SELECT t.conv_id, n_turns, turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars
FROM texts t JOIN sizes s ON t.conv_id IS NOT DISTINCT FROM s.conv_id"""
