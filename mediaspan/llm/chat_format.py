r"""Chat formatting with a grammar round trip, in SQL expressions only.

Template of a turn: ``### role`` newline, text, ``</turn>`` newline. Turns are rendered raw first and the rendered
conversation is parsed again; where the grammar is broken or the recovered turns differ from the source, the turns are escaped
and the round trip is repeated. Every turn says by ``### `` or ``##\ `` whether its parts are raw or escaped, so that parsing needs nothing else.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Marks of the template.
END, RAW, ESCAPED = "</turn>\n", "### ", "##\\ "
#: (control string, its escaped form); backslashes are doubled before, so each escaped form holds the only single backslash.
CONTROLS = (("</turn>", "<\\/turn>"), ("### ", "#\\## "))
#: In roles, also the line end; its form has no sign of a control string, so it makes none with what is beside it.
ROLE_CONTROLS = (*CONTROLS, ("\n", "%\\n%"))
ASSISTANT = "assistant"


def _swap(c: Column, old: str, new: str) -> Column:
    return F.replace(c, F.lit(old), F.lit(new))


def escape(c: Column, controls: tuple = CONTROLS) -> Column:
    c = _swap(c, "\\", "\\\\")
    for plain, safe in controls:
        c = _swap(c, plain, safe)
    return c


def unescape(c: Column, controls: tuple = CONTROLS) -> Column:
    for plain, safe in reversed(controls):
        c = _swap(c, safe, plain)
    return _swap(c, "\\\\", "\\")


def render(turns: Column, escaped: bool) -> Column:
    """Text of an array of structs (role, text)."""
    one = lambda t: F.concat(F.lit(ESCAPED), escape(t["role"], ROLE_CONTROLS), F.lit("\n"), escape(t["text"]), F.lit(END)) if escaped else F.concat(F.lit(RAW), t["role"], F.lit("\n"), t["text"], F.lit(END))
    return F.array_join(F.transform(turns, one), "")


def parse(rendered: Column) -> Column:
    """Turns (role, text) of a rendered conversation; null if it breaks the grammar.

    A turn is a mark, a role up to the line end, a text, END; neither role nor text may hold a control string.
    """
    pieces = F.split(rendered, "\\Q" + END + "\\E", -1)
    pieces = F.slice(pieces, 1, F.size(pieces) - 1)

    def one(piece: Column) -> Column:
        head = F.substring_index(piece, "\n", 1)
        text = F.substring(piece, F.length(head) + 2, F.length(piece))
        role = F.substring(head, 5, F.length(head))
        safe = F.startswith(piece, F.lit(ESCAPED))
        return F.struct(F.when(safe, unescape(role, ROLE_CONTROLS)).otherwise(role).alias("role"), F.when(safe, unescape(text)).otherwise(text).alias("text"))

    clash = F.exists(pieces, lambda p: F.contains(p, F.lit(CONTROLS[0][0])) | F.contains(F.substring(p, 5, F.length(p)), F.lit(CONTROLS[1][0])))
    return F.when(~clash, F.transform(pieces, one))


def format_chats(turns: DataFrame) -> DataFrame:
    """One row per conv_id: conv_id, formatted, escaped (whether the raw form failed its round trip), turns (read back).

    ``turns``: conv_id, turn, role, text; rows are ordered by turn, equal turns by role and text, null turns first. Null roles and texts
    are empty, a null conv_id is a conversation of its own, repeated rows stay, other columns are ignored. A conversation that
    does not survive the escaped round trip raises an error (none does; checked on each run).
    """
    rows = turns.select("conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    chats = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    chats = chats.select("conv_id", F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("source"))
    chats = chats.withColumn("raw", render(F.col("source"), False))
    chats = chats.withColumn("escaped", ~parse(F.col("raw")).eqNullSafe(F.col("source")))
    chats = chats.withColumn("formatted", F.when(F.col("escaped"), render(F.col("source"), True)).otherwise(F.col("raw")))
    chats = chats.withColumn("turns", parse(F.col("formatted")))
    turns_back = F.when(F.col("turns").eqNullSafe(F.col("source")), F.col("turns")).otherwise(F.raise_error(F.lit("a conversation changed in its round trip")))
    return chats.select("conv_id", "formatted", "escaped", turns_back.alias("turns"))


def loss_text(turns: Column) -> Column:
    """All text under the loss mask: each assistant text, in order."""
    return F.array_join(F.transform(F.filter(turns, lambda t: t["role"] == ASSISTANT), lambda t: t["text"]), "")


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation and conversation -7: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, escaped."""
    said = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, ASSISTANT, said)], "conv_id long, turn long, role string, text string")
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").unionByName(extra)
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return format_chats(rows).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        sha(turns).alias("turns_sha256"),
        F.length(loss_text(F.col("turns"))).cast("long").alias("loss_chars"),
        sha(loss_text(F.col("turns"))).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "escaped",
    )


#: The template and its escapes said again in SQL.
OP10_SQL = r"""
with r as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'
), c as (
  select conv_id, count(*) as n_turns, bool_or(contains(role || text, '</turn>') or contains(role || chr(10) || text, '### ') or contains(role, chr(10))) as escaped,
    string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text) as turns,
    coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '') as loss,
    sum(length(role) + length(text) + 13) as raw_n,
    sum(13 + length(replace(replace(replace(replace(role, '\', '\\'), '</turn>', '<\/turn>'), '### ', '#\## '), chr(10), '%\n%'))
      + length(replace(replace(replace(text, '\', '\\'), '</turn>', '<\/turn>'), '### ', '#\## '))) as safe_n
  from r group by conv_id
)
select conv_id, n_turns, sha256(turns) as turns_sha256, length(loss) as loss_chars, sha256(loss) as loss_sha256,
  cast(case when escaped then safe_n else raw_n end as bigint) as formatted_chars, escaped from c
"""
