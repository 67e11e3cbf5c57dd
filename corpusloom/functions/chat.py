"""Conversations as marked-up text and as ids with a supervision mask.

A conversation's messages are gathered in one array: conversations are bounded, the corpus isn't.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions.bpe import SPLIT, Bpe

BETWEEN = "\n\n"


def merged_turns(turns: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The turns without a leading system message, which goes before the next message's text."""
    w = Window.partitionBy(key).orderBy(turn)
    rows = turns.withColumn("_n", F.row_number().over(w)).withColumn("_role", F.lag(role).over(w)).withColumn("_text", F.lag(text).over(w))
    led = (F.col("_n") == 2) & (F.col("_role") == "system")
    rows = rows.where(~((F.col("_n") == 1) & (F.col(role) == "system")))
    return rows.withColumn(text, F.when(led, F.concat("_text", F.lit(BETWEEN), F.col(text))).otherwise(F.col(text))).drop("_n", "_role", "_text")


def conversations(turns: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """key and messages: array<struct<role, text>> in order, the system message merged."""
    each = turns.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(turn).alias("o"), F.col(role).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")))).alias("m"))
    led = (F.element_at("m", 1)["role"] == "system") & (F.size("m") > 1)
    second = F.element_at("m", 2)
    joined = F.struct(second["role"].alias("role"), F.concat(F.element_at("m", 1)["text"], F.lit(BETWEEN), second["text"]).alias("text"))
    plain = F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text")))
    return each.select(key, F.when(led, F.concat(F.array(joined), F.slice(plain, F.lit(3), F.size("m")))).otherwise(plain).alias("messages"))


def is_valid(messages: Column) -> Column:
    """Whether there is a message and user and assistant take turns, the user first."""
    return (F.size(messages) > 0) & F.forall(F.transform(messages, lambda x, i: x["role"] == F.when(i % 2 == 0, "user").otherwise("assistant")), lambda ok: ok)


def rendered(messages: Column) -> Column:
    """The conversation with its special tokens as text."""
    return F.concat(F.lit("<|bos|>"), F.array_join(F.transform(messages, lambda x: F.concat(F.lit("<|"), x["role"], F.lit("_start|>"), x["text"], F.lit("<|"), x["role"], F.lit("_end|>"))), ""))


def completion_prompt(messages: Column) -> Column:
    """The text up to the last answer, which is left out; null if the last message isn't the assistant's."""
    own = F.slice(messages, F.lit(1), F.greatest(F.size(messages) - 1, F.lit(0)))
    return F.when((F.size(messages) > 0) & (F.element_at(messages, -1)["role"] == "assistant"), F.concat(rendered(own), F.lit("<|assistant_start|>")))


ROLES = ("user", "assistant")
#: Types of parts, and the name of the marks around them.
MARKS = {"text": None, "python": "python", "python_output": "output"}
#: Pieces that a task keeps the ids of, before it starts anew.
MOST_KNOWN = 200_000


def well_formed(messages: list[dict]) -> bool:
    """Whether user and assistant take turns and every part has a known type and a text."""
    return all(m is not None and m["role"] == ROLES[i % 2] and all(p is not None and p["type"] in MARKS and p["text"] is not None for p in m["parts"] or ()) for i, m in enumerate(messages))


PART = T.StructType([T.StructField("type", T.StringType()), T.StructField("text", T.StringType())])
RESULT = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("mask", T.ArrayType(T.IntegerType()))])


def conversation_ids(messages: Column, model: Bpe, most: int = 2048, for_completion: bool = False) -> Column:
    """ids and mask of array<struct<role, parts: array<struct<type, text>>>>, cut to ``most``.

    Null where roles don't take turns, a part's type is unknown or, for a completion, the last message isn't the
    assistant's: one bad row doesn't end a job. What the assistant is to learn has mask 1: its text, its tool calls with their marks, and the mark that
    ends its turn. Tool output, other messages and all other marks have mask 0.
    """
    merges, specials = model.merges, model.specials

    def run(x: pa.Array) -> pa.Array:
        import regex

        own, split, known = Bpe(merges, specials), regex.compile(SPLIT), {}
        special = own.special_ids

        def encode(text: str) -> list[int]:
            out = []
            for p in split.findall(text):
                if p not in known:
                    if len(known) >= MOST_KNOWN:
                        known.clear()
                    known[p] = own.piece(p.encode("utf-8", "replace"))
                out += known[p]
            return out

        def one(messages: list[dict] | None) -> dict | None:
            if messages is None or not well_formed(messages):
                return None
            if for_completion:
                if not messages or messages[-1]["role"] != "assistant":
                    return None
                messages = messages[:-1]
            spans = [([special["<|bos|>"]], 0)]
            for i, m in enumerate(messages):
                role = ROLES[i % 2]
                learned = int(role == "assistant")
                spans.append(([special[f"<|{role}_start|>"]], 0))
                for part in m["parts"] or ():
                    mark = MARKS[part["type"]]
                    taught = learned and mark != "output"
                    ids = encode(part["text"])
                    spans.append(([special[f"<|{mark}_start|>"], *ids, special[f"<|{mark}_end|>"]] if mark else ids, int(taught)))
                spans.append(([special[f"<|{role}_end|>"]], learned))
            if for_completion:
                spans.append(([special["<|assistant_start|>"]], 0))
            ids = [i for s, _ in spans for i in s]
            mask = [k for s, k in spans for _ in s]
            return {"ids": ids[:most], "mask": mask[:most]}

        return pa.array([one(v) for v in x.to_pylist()], pa.struct([("ids", pa.list_(pa.int32())), ("mask", pa.list_(pa.int32()))]))

    run.__annotations__ = {"x": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, RESULT)(messages)
