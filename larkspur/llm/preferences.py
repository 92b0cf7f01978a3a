"""Preference pairs: a shared prompt and two masked completions, in DataFrame functions only.

The turns of a pair's chosen and rejected conversations are compared by role and
text from the first on.  The longest common prefix is rendered once as the
prompt; what follows on either side is its completion.  A mask gives, as runs of
``characters:trained`` over a completion, which characters a model learns from:
the text and closing mark of the assistant's turns.

One shuffle gathers the turns of a pair.  A pair becomes one row of rendered
strings, so its turns meet in one task by the nature of the result; nothing else
is grouped, and common turns or equal conversations do not meet.

Cases.  Turns are ordered by turn, role and text, nulls first; so are ties.  Null
role is rendered as ``unknown``, null text as empty; nulls are equal to each
other.  Turns without a pair are left out.  A pair with one side only has an
empty prompt, null for the missing side and complete = false.  Equal sides leave
empty completions; a side that is a prefix of the other leaves one.  Repeated
turn rows are turns of their own.  An empty table gives no rows.  Other columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRAINED_ROLE = "assistant"


def _head(turn: Column) -> Column:
    return F.concat(F.lit("<|"), F.coalesce(turn["role"], F.lit("unknown")), F.lit("|>\n"))


def _body(turn: Column) -> Column:
    return F.concat(F.coalesce(turn["text"], F.lit("")), F.lit("<|end|>\n"))


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), _body(t))), "")


def mask(turns: Column, trained_role: str = TRAINED_ROLE) -> Column:
    """Runs of characters, each with 1 if they are learnt from."""

    def runs(t: Column) -> Column:
        head, body = F.length(_head(t)), F.length(_body(t))
        return F.when(t["role"] == trained_role, F.concat_ws(",", F.concat(head, F.lit(":0")), F.concat(body, F.lit(":1")))).otherwise(F.concat(head + body, F.lit(":0")))

    return F.array_join(F.transform(turns, runs), ",")


def common_turns(a: str, b: str) -> Column:
    """Number of leading turns of two columns that are equal in role and text."""
    n = F.least(F.size(a), F.size(b))
    same = F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: x["role"].eqNullSafe(y["role"]) & x["text"].eqNullSafe(y["text"]))
    first = F.array_position(same, False)
    return F.when(first > 0, first - 1).otherwise(n).cast("int")


def format_preferences(turns: DataFrame, pair: Column, chosen: Column, trained_role: str = TRAINED_ROLE) -> DataFrame:
    """pair_id, complete, prompt_turns, prompt, chosen, chosen_mask, rejected, rejected_mask
    of ``turns`` (turn, role, text); ``chosen`` says which side a turn is of."""
    turn = F.struct(F.col("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    sided = turns.select(pair.alias("pair_id"), chosen.alias("side"), turn.alias("t")).where("pair_id is not null and side is not null")
    pairs = sided.groupBy("pair_id").agg(F.sort_array(F.collect_list(F.when(F.col("side"), F.col("t")))).alias("a"), F.sort_array(F.collect_list(F.when(~F.col("side"), F.col("t")))).alias("b"))
    counted = pairs.select("*", common_turns("a", "b").alias("n"))
    rest = lambda c: F.slice(c, F.col("n") + 1, F.greatest(F.size(c) - F.col("n"), F.lit(0)))
    present = lambda c, x: F.when(F.size(c) > 0, x)
    return counted.select(
        "pair_id",
        ((F.size("a") > 0) & (F.size("b") > 0)).alias("complete"),
        F.col("n").alias("prompt_turns"),
        render(F.slice("a", 1, F.col("n"))).alias("prompt"),
        present("a", render(rest("a"))).alias("chosen"),
        present("a", mask(rest("a"), trained_role)).alias("chosen_mask"),
        present("b", render(rest("b"))).alias("rejected"),
        present("b", mask(rest("b"), trained_role)).alias("rejected_mask"),
    )


_TURN = "'<|' || coalesce(t.role, 'unknown') || '|>' || chr(10)"
_TEXT = "coalesce(t.text, '') || '<|end|>' || chr(10)"


def _oracle_side(c: str, name: str) -> str:
    rest = f"{c}[n + 1:]"
    runs = f"CASE WHEN t.role = '{TRAINED_ROLE}' THEN length({_TURN}) || ':0,' || length({_TEXT}) || ':1' ELSE length({_TURN} || {_TEXT}) || ':0' END"
    return f"""CASE WHEN len({c}) > 0 THEN coalesce(array_to_string(list_transform({rest}, lambda t: {_TURN} || {_TEXT}), ''), '') END AS {name},
       CASE WHEN len({c}) > 0 THEN coalesce(array_to_string(list_transform({rest}, lambda t: {runs}), ','), '') END AS {name}_mask"""


ORACLE = f"""
WITH s AS (SELECT conv_id // 2 AS pair_id, conv_id % 2 = 0 AS side, {{'turn': turn, 'role': role, 'text': text}} AS t FROM conversations WHERE conv_id IS NOT NULL),
     p AS (SELECT pair_id, coalesce(list(t ORDER BY t.turn NULLS FIRST, t.role NULLS FIRST, t.text NULLS FIRST) FILTER (WHERE side), []) AS a,
                  coalesce(list(t ORDER BY t.turn NULLS FIRST, t.role NULLS FIRST, t.text NULLS FIRST) FILTER (WHERE NOT side), []) AS b FROM s GROUP BY 1),
     e AS (SELECT *, least(len(a), len(b)) AS m FROM p),
     f AS (SELECT *, list_position(list_transform(range(1, m + 1), lambda i: a[i].role IS NOT DISTINCT FROM b[i].role AND a[i].text IS NOT DISTINCT FROM b[i].text), false) AS x FROM e),
     g AS (SELECT *, (CASE WHEN x > 0 THEN x - 1 ELSE m END)::INTEGER AS n FROM f)
SELECT pair_id, len(a) > 0 AND len(b) > 0 AS complete, n AS prompt_turns,
       coalesce(array_to_string(list_transform(a[1:n], lambda t: {_TURN} || {_TEXT}), ''), '') AS prompt,
       {_oracle_side("a", "chosen")},
       {_oracle_side("b", "rejected")}
FROM g
"""
