"""Formatting of preference pairs: the common turns once as a prompt, the two ways on as masked completions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE, END = "<|", "|>", "<|end|>"


def _render(turn):
    """One turn: role line, text, end line. The opening of a marker inside texts is broken up, so that no text can forge one."""
    safe = lambda c: F.replace(F.coalesce(c, F.lit("")), F.lit(OPEN), F.lit("< |"))
    return F.concat(F.lit(OPEN), safe(turn["role"]), F.lit(CLOSE + "\n"), safe(turn["text"]), F.lit("\n" + END + "\n"))


def _text(turns):
    return F.array_join(F.transform(turns, _render), "")


def format_preferences(pairs: DataFrame, chosen: str = "chosen", rejected: str = "rejected", learn: str = "assistant") -> DataFrame:
    """pairs without the two columns of turns (arrays of struct<role, text>), plus n_prompt, prompt, and for chosen and rejected
    the completion and its mask: spans struct<start, end> in characters of the completion that are learned, the texts with their end
    marks of the turns of role `learn`. Everything else, the prompt included, is masked.

    n_prompt is the length of the longest common prefix of turns (equal role and text; nulls count as empty). If one conversation continues
    the other, the shorter's completion is empty; equal ones leave both empty. Null or empty arrays are conversations of no turns.
    Columns of pairs that have a name of the result are replaced by it; all others stay. Repeated rows stay rows of their own; texts of any length are
    rendered whole; an empty table gives an empty result.
    """
    empty = F.array().cast("array<struct<role:string,text:string>>")
    a, b = F.coalesce(F.col(chosen), empty), F.coalesce(F.col(rejected), empty)
    shorter = F.least(F.size(a), F.size(b))
    blank = lambda c: F.coalesce(c, F.lit(""))
    differs = F.zip_with(F.slice(a, 1, shorter), F.slice(b, 1, shorter), lambda x, y: (blank(x["role"]) != blank(y["role"])) | (blank(x["text"]) != blank(y["text"])))
    at = F.array_position(differs, True)
    out = pairs.withColumn("n_prompt", F.when(at > 0, at - 1).otherwise(shorter).cast("long"))
    n = F.col("n_prompt").cast("int")
    out = out.withColumn("prompt", _text(F.slice(a, 1, n)))
    for name, turns in (("chosen", a), ("rejected", b)):
        rest = F.slice(turns, n + 1, F.greatest(F.size(turns) - n, F.lit(0)))
        blank = F.array().cast("array<struct<start:bigint,end:bigint>>")
        start = F.struct(F.lit(0).cast("long").alias("at"), blank.alias("spans"))

        def step(acc, t):
            whole = F.char_length(_render(t)).cast("long")
            head = F.char_length(F.replace(F.coalesce(t["role"], F.lit("")), F.lit(OPEN), F.lit("< |"))) + len(OPEN + CLOSE) + 1
            span = F.struct((acc["at"] + head).cast("long").alias("start"), (acc["at"] + whole - 1).alias("end"))
            return F.struct((acc["at"] + whole).alias("at"), F.when(t["role"] == learn, F.array_append(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

        out = out.withColumn(f"{name}_completion", _text(rest)).withColumn(f"{name}_mask", F.aggregate(rest, start, step, lambda acc: acc["spans"]))
    return out.drop(*[c for c in (chosen, rejected)])


def conversation_pairs(conversations: DataFrame) -> DataFrame:
    """conv_id, chosen, rejected: each conversation against itself with a stale last answer.

    chosen: the turns by `turn` (null first; repeated numbers by role, then text). rejected: the same with the text of the last assistant turn
    replaced by that of the first, if it differs, else by the empty text. A conversation without assistant turns
    is its own rejected one. Rows with a null conv_id are one conversation. A conversation is one value, so its turns must fit a task.
    """
    turns = F.sort_array(F.collect_list(F.struct("turn", "role", "text")))
    talks = conversations.groupBy("conv_id").agg(turns.alias("t"))
    chosen = F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text")))
    talks = talks.select("conv_id", chosen.alias("chosen"))
    answers = F.filter(F.transform("chosen", lambda x, i: F.struct(i.alias("i"), x["role"].alias("role"), F.coalesce(x["text"], F.lit("")).alias("text"))), lambda x: x["role"] == "assistant")
    talks = talks.withColumn("answers", answers)
    first, last = F.get("answers", F.lit(0)), F.get("answers", F.size("answers") - 1)
    stale = F.when(first["text"] == last["text"], F.lit("")).otherwise(first["text"])
    rejected = F.transform("chosen", lambda x, i: F.when(i == last["i"], F.struct(x["role"].alias("role"), stale.alias("text"))).otherwise(x))
    return talks.select("conv_id", "chosen", rejected.alias("rejected"))
