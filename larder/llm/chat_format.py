"""Chat formatting: every assistant turn becomes an example of its own, with all turns before it as context.

Turns are rendered as <|role|>, a line end, the text, <|end|> and a line end; "<|" inside a text becomes "< |", so that no text
can open or close a turn. The context ends with the assistant's header; only the reply and its end mark are trainable, and
train_start and train_stop give their place in `example` in characters.

Defined results: turns of a conversation are ordered by turn number, then role, then text; rows that repeat all three are one
turn. Roles are compared trimmed and in lower case. Null conv_ids, turns, roles or texts are left out; an empty reply gives no example, and empty
turns of others stay in the context. A conversation of any length is kept whole: n turns make examples of up to n turns each, so
that their text grows with the square of n, and so does the time of the one task that a conversation is. A reply without a turn before it has the header alone as context. Other columns, whatever their names, aren't
looked at. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

END = "<|end|>\n"


def examples(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, n_context, context, reply, example, train_start, train_stop), one row for each assistant turn."""
    role = F.lower(F.trim(F.col("role").cast("string")))
    rows = turns.select("conv_id", "turn", role.alias("role"), F.replace(F.col("text").cast("string"), F.lit("<|"), F.lit("< |")).alias("text"))
    rows = rows.where("conv_id is not null and turn is not null and role is not null and text is not null")
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    same = F.lag(F.struct("turn", "role", "text")).over(order).eqNullSafe(F.struct("turn", "role", "text"))
    rows = rows.withColumn("repeat", same).where("not repeat").drop("repeat")  # within the one exchange and sort that the context needs
    rows = rows.withColumn("shown", F.concat(F.lit("<|"), F.replace("role", F.lit("<|"), F.lit("< |")), F.lit("|>\n"), F.col("text"), F.lit(END)))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    made = rows.withColumn("turns", F.collect_list("shown").over(before)).where("role = 'assistant' and text <> ''")
    context = F.concat(F.array_join("turns", ""), F.lit("<|assistant|>\n"))
    made = made.select("conv_id", "turn", F.size("turns").alias("n_context"), context.alias("context"), F.concat("text", F.lit(END)).alias("reply"))
    start = F.length("context")
    return made.withColumns({"example": F.concat("context", "reply"), "train_start": start, "train_stop": start + F.length("reply")})
