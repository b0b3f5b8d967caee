"""Operator 4: chat formatting by prefix-target expansion.

Every assistant turn becomes an example: all turns before it as context, and
only that reply trainable. A conversation that doesn't end with a reply gives
one more example without anything trainable, so that nothing is lost. DataFrame
functions only: a row is never expanded into all its examples at once, the
positions are exploded first and each example's text is joined in its own row.

Template: ``<s>reply</s>`` for an assistant turn, ``[INST]role\\ntext[/INST]``
for any other. Control strings inside roles and texts get one backslash more
after their first character, which reading takes away again.

Null texts and roles are empty; a null conv_id is a conversation; turns are
ordered by (turn, role, text), nulls first, so ties and repeated rows have one
order and are all kept; an empty table gives no rows; other columns are not
read. A conversation's text is one value, as its digest is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

ASSISTANT = "assistant"
#: Fixed value: the texts of conversation -1.
CONTROL_TEXT = "</s>[INST] ok [/INST]"

_CONTROL = r"([<\[])(\\*)(/?(?:s>|INST\]))"
_ESCAPED = r"([<\[])\\(\\*)(/?(?:s>|INST\]))"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "$1$2$3")


def _turn(t: Column) -> Column:
    role = F.regexp_replace(F.regexp_replace(escape(t["role"]), "%", "%25"), "\n", "%0A")
    return F.when(t["role"] == ASSISTANT, F.concat(F.lit("<s>"), escape(t["text"]), F.lit("</s>"))).otherwise(
        F.concat(F.lit("[INST]"), role, F.lit("\n"), escape(t["text"]), F.lit("[/INST]")))


def examples(conversations: DataFrame) -> DataFrame:
    """(conv_id, example, text, loss_from, loss_to, last): code points of ``text``
    from..to are trainable (none where null); ``last`` holds the whole conversation."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    whole = conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    whole = whole.select("conv_id", F.transform("turns", _turn).alias("parts"),
                         F.transform("turns", lambda t: t["role"] == ASSISTANT).alias("reply"))
    ends = F.filter(F.sequence(F.lit(1), F.size("parts")), lambda k: F.element_at("reply", k) | (k == F.size("parts")))
    each = whole.select("conv_id", "parts", "reply", F.posexplode(ends).alias("example", "end"))
    context = F.array_join(F.slice("parts", F.lit(1), F.col("end") - 1), "")
    each = each.select("conv_id", "example", context.alias("context"), F.element_at("parts", F.col("end")).alias("turn"),
                       F.element_at("reply", F.col("end")).alias("reply"), (F.col("end") == F.size("parts")).alias("last"))
    before = F.length("context") + 3
    return each.select("conv_id", "example", F.concat("context", "turn").alias("text"),
                       F.when(F.col("reply"), before).alias("loss_from"),
                       F.when(F.col("reply"), before + F.length("turn") - 7).alias("loss_to"), "last")


def read_back(formatted: DataFrame) -> DataFrame:
    """Turns and trainable text of every conversation, from its examples."""
    loss = F.when(F.col("loss_from").isNotNull(), F.struct("example", F.substring("text", F.col("loss_from") + 1, F.col("loss_to") - F.col("loss_from")).alias("t")))
    by = formatted.groupBy("conv_id").agg(F.max(F.when(F.col("last"), F.col("text"))).alias("text"), F.sort_array(F.collect_list(loss)).alias("loss"),
                                          F.sum(F.length("text").cast("long")).alias("formatted_chars"))
    parts = F.filter(F.split("text", r"(?<=</s>|\[/INST\])"), lambda p: p != "")

    def turn(p: Column) -> Column:
        inner = F.substr(p, F.lit(7), F.length(p) - 13)
        role = F.substring_index(inner, "\n", 1)
        role = unescape(F.regexp_replace(F.regexp_replace(role, "%0A", "\n"), "%25", "%"))
        text = F.substr(inner, F.instr(inner, "\n") + 1)
        return F.when(p.startswith("<s>"), F.concat(F.lit(ASSISTANT + "\n"), unescape(F.substr(p, F.lit(4), F.length(p) - 7)), F.lit("\n"))).otherwise(
            F.concat(role, F.lit("\n"), unescape(text), F.lit("\n")))

    by = by.select("conv_id", "formatted_chars", F.transform(parts, turn).alias("turns"), F.array_join(F.transform("loss", lambda x: unescape(x["t"])), "").alias("loss"))
    return by.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(F.array_join("turns", "").cast("binary"), 256).alias("turns_sha256"),
                     F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), "formatted_chars")


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise(ASSISTANT).alias("role"), F.lit(CONTROL_TEXT).alias("text"))
    return read_back(written(examples(rows.union(extra)), "op4-examples"))


#: Lengths are counted from the template: 7 characters around a reply, 14 and the role around another turn.
OP4_SQL = r"""
with c as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
), t as (
  select *, row_number() over w as k, count(*) over (partition by conv_id) as n,
         sum(length(text) + len(regexp_extract_all(text, '[<\[]\\*/?(?:s>|INST\])')) + case when role = 'assistant' then 7 else 14 + length(role) end) over (w rows unbounded preceding) as upto
  from c window w as (partition by conv_id order by turn, role, text)
)
select conv_id, cast(max(n) as bigint) as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by k)) as turns_sha256,
       cast(coalesce(sum(length(text)) filter (where role = 'assistant'), 0) as bigint) as loss_chars,
       sha256(coalesce(string_agg(text, '' order by k) filter (where role = 'assistant'), '')) as loss_sha256,
       cast(sum(upto) filter (where role = 'assistant' or k = n) as bigint) as formatted_chars
from t group by conv_id
"""
