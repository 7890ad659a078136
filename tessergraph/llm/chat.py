"""Chat formatting by event-sourced reconstruction, in DataFrame functions only.

A log row is an event of a conversation: ``message`` opens a message; ``delta`` appends to one, ``edit`` and
``regenerate`` start its text anew. Events are dealt by conversation, sorted by sequence and folded into final messages,
which are rendered with a template. Control strings inside texts are escaped: each backslash is doubled and ``<|`` becomes
``<\\|``, so the template's marks never occur in a body and the output can be read back exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessergraph.llm.common import table

TURN, BODY, END = "<|turn|>", "<|body|>", "<|end|>\n"
#: Roles whose bodies are under the loss mask.
LOSS_ROLES = ("assistant",)


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def fold_events(events: DataFrame) -> DataFrame:
    """Folds (conv_id, seq, kind, msg, role, text) into (conv_id, messages array<struct<seq,role,text>>).

    Null texts and roles are empty; a null kind is ``message``, a null msg the event's own seq. Changes are folded message by
    message, so only final messages meet in their conversation. Messages with one sequence number keep the order of role,
    then text; repeated message rows stay repeated. A message that was never opened is opened, empty, by its first change, whose
    place and role it gets; changes that name none (msg and seq null) make one message of their own. A null conversation id
    is a conversation of its own. Other columns are not read.
    """
    filled = events.select(
        "conv_id",
        F.col("seq").cast("long").alias("seq"),
        F.coalesce("kind", F.lit("message")).alias("kind"),
        F.coalesce("msg", "seq").cast("long").alias("msg"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    opens = F.col("kind") == "message"
    own = filled.groupBy("conv_id", "msg", (~opens & F.col("msg").isNull()).alias("nameless")).agg(
        F.collect_list(F.when(opens, F.struct("seq", "role", "text"))).alias("opened"),
        F.sort_array(F.collect_list(F.when(~opens, F.struct("seq", "kind", "text", "role")))).alias("log"),
    )
    first = F.array(F.struct(F.col("log")[0]["seq"].alias("seq"), F.col("log")[0]["role"].alias("role"), F.lit("").alias("text")))
    own = own.withColumn("opened", F.when(F.size("opened") > 0, F.col("opened")).otherwise(first))
    resets = F.expr("filter(transform(log, (e, i) -> if(e.kind = 'delta', -1, i)), i -> i >= 0)")
    own = own.withColumn("reset", F.coalesce(F.array_max(resets), F.lit(-1)))
    own = own.withColumn("said", F.array_join(F.expr("transform(slice(log, greatest(reset, 0) + 1, size(log)), e -> e.text)"), ""))
    text = lambda m: F.when(F.col("reset") >= 0, F.col("said")).otherwise(F.concat(m["text"], F.col("said")))
    final = own.select("conv_id", F.transform("opened", lambda m: F.struct(m["seq"].alias("seq"), m["role"].alias("role"), text(m).alias("text"))).alias("own"))
    return final.groupBy("conv_id").agg(F.sort_array(F.flatten(F.collect_list("own"))).alias("messages"))


def render(folded: DataFrame) -> DataFrame:
    """Adds ``segments`` (array of struct<text, loss>: the output cut at the loss mask) and ``formatted``, their join."""
    segments = F.flatten(
        F.transform(
            "messages",
            lambda m: F.array(
                F.struct(F.concat(F.lit(TURN), escape(m["role"]), F.lit(BODY)).alias("text"), F.lit(False).alias("loss")),
                F.struct(escape(m["text"]).alias("text"), m["role"].isin(*LOSS_ROLES).alias("loss")),
                F.struct(F.lit(END).alias("text"), F.lit(False).alias("loss")),
            ),
        )
    )
    return folded.withColumn("segments", segments).withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def read_back(formatted: Column) -> Column:
    """The turns of a rendered conversation: array<struct<role, text>>."""
    pieces = F.filter(F.split(formatted, r"<\|end\|>\n"), lambda p: p != "")
    return F.transform(
        pieces,
        lambda p: F.struct(
            unescape(F.substring_index(F.substr(p, F.lit(len(TURN) + 1)), BODY, 1)).alias("role"),
            unescape(F.substr(p, F.locate(BODY, p) + len(BODY))).alias("text"),
        ),
    )


def digest(rendered: DataFrame) -> DataFrame:
    turns = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    under = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
    return (
        rendered.withColumn("turns", read_back(F.col("formatted")))
        .withColumn("under", under)
        .select(
            "conv_id",
            F.size("turns").cast("long").alias("n_turns"),
            F.sha2(F.array_join(turns, ""), 256).alias("turns_sha256"),
            F.length("under").cast("long").alias("loss_chars"),
            F.sha2("under", 256).alias("loss_sha256"),
            F.length("formatted").cast("long").alias("formatted_chars"),
        )
    )


def as_events(rows: DataFrame) -> DataFrame:
    """The log that leads to rows (conv_id, turn, role, text): each turn opens a message and ends, after changes, as its text.

    An assistant's draft is streamed in deltas and regenerated in two more; any other turn is opened with its first half and
    streams the rest, or is opened with a draft and edited, by turns.
    """
    text, n = F.coalesce("text", F.lit("")), F.length(F.coalesce("text", F.lit("")))
    half = F.floor(n / 2).cast("int")
    head, tail = F.substr(text, F.lit(1), half), F.substr(text, half + 1)
    event = lambda step, kind, said: F.struct(F.lit(step).cast("long").alias("step"), F.lit(kind).alias("kind"), said.alias("text"))
    empty, draft = F.lit(""), F.concat(F.lit("draft "), head)
    logs = (
        F.when(F.col("role") == "assistant", F.array(event(0, "message", empty), event(1, "delta", draft), event(2, "delta", tail), event(3, "regenerate", head), event(4, "delta", tail)))
        .when(F.pmod("turn", F.lit(4)) == 2, F.array(event(0, "message", draft), event(1, "delta", tail), event(2, "edit", text)))
        .otherwise(F.array(event(0, "message", head), event(1, "delta", tail)))
    )
    numbered = rows.select("conv_id", "turn", "role", "text", F.monotonically_increasing_id().alias("msg"))
    each = numbered.select("conv_id", "turn", "role", "msg", F.explode(logs).alias("event"))
    seq = F.when(F.col("event.kind") == "message", F.col("turn")).otherwise(F.col("event.step"))
    return each.select("conv_id", seq.cast("long").alias("seq"), "event.kind", "msg", "role", "event.text")


def query(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = spark.sql(
        "SELECT -7L AS conv_id, CAST(turn AS LONG) AS turn, role, '</s>[INST] ok [/INST]' AS text FROM VALUES (0, 'user'), (1, 'assistant') AS t(turn, role)"
    )
    return digest(render(fold_events(as_events(rows.unionByName(control)))))


ORACLE_SQL = r"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, 8 + 8 + 8 + length(replace(replace(role, '\', '\\'), '<|', '<\|')) + length(replace(replace(text, '\', '\\'), '<|', '<\|')) AS n FROM r
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(n) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
