"""Datasets as conversations, and the judging of answers."""

from __future__ import annotations

import subprocess
import sys
import tempfile
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions import text as tx

LETTERS = ("A", "B", "C", "D")


def _message(role: str, content: Column) -> Column:
    parts = F.array(F.struct(F.lit("text").alias("type"), content.alias("text")))
    return F.struct(F.lit(role).alias("role"), parts.alias("parts"))


def four_choices(rows: DataFrame, question: str = "question", choices: str = "choices", answer: str = "answer") -> DataFrame:
    """Adds messages and letters to questions with four choices and the right one's place."""
    letters = F.array(*map(F.lit, LETTERS))
    checked = F.when(F.size(choices) == len(LETTERS), F.col(choices)).otherwise(F.raise_error(F.lit("a question hasn't four choices")))
    prompt = tx.multiple_choice(F.col(question), letters, checked)
    return rows.withColumn("letters", letters).withColumn("messages", F.array(_message("user", prompt), _message("assistant", F.element_at(letters, F.col(answer) + 1))))


def lettered_choices(rows: DataFrame, question: str = "question", texts: str = "texts", letters: str = "letters", answer: str = "answer") -> DataFrame:
    """Adds messages to questions whose choices bring their own letters; the answer is one of them."""
    right = F.when(F.array_contains(F.col(letters), F.col(answer)), F.col(answer)).otherwise(F.raise_error(F.lit("the answer is none of the letters")))
    return rows.withColumn("messages", F.array(_message("user", tx.multiple_choice(F.col(question), F.col(letters), F.col(texts))), _message("assistant", right)))


def worked_answers(rows: DataFrame, question: str = "question", answer: str = "answer") -> DataFrame:
    """Adds messages to questions whose answers have calculations in them: those become tool calls with their output."""
    parts = F.transform(tx.calculation_parts(F.col(answer)), lambda p: F.struct(p["kind"].alias("type"), p["value"].alias("text")))
    return rows.withColumn("messages", F.array(_message("user", F.col(question)), F.struct(F.lit("assistant").alias("role"), parts.alias("parts"))))


def programs(rows: DataFrame, prompt: str = "prompt", solution: str = "canonical_solution") -> DataFrame:
    """Adds messages to programming problems: the prompt, and the prompt with its solution."""
    return rows.withColumn("messages", F.array(_message("user", F.col(prompt)), _message("assistant", F.concat_ws("\n", F.col(prompt), F.col(solution)))))


def same_answer(reference: Column, response: Column) -> Column:
    """Whether two worked answers end in the same number; two without any are equal."""
    return tx.answer(reference).eqNullSafe(tx.answer(response))


def right_letter(reference: Column, response: Column, letters: Column) -> Column:
    """Whether the response is the right letter; a response that is no letter at all is an error."""
    return F.when(F.array_contains(letters, response), response == reference).otherwise(F.raise_error(F.lit("the response is none of the letters")))


def runnable(prompt: Column, response: Column, test: Column, entry_point: Column) -> Column:
    """The program that tests a response: the prompt's imports, the response's code, the test and its call."""
    return F.concat_ws("\n\n", tx.imports(prompt), tx.program(response), test, F.concat(F.lit("check("), entry_point, F.lit(")")))


def executed(source: Column, seconds: float = 5.0, megabytes: int = 256) -> Column:
    """Whether each program ends well, in a process of its own with bounded time, memory and folder.

    A guard against accidents, not against attacks: run it where nothing can be harmed.
    """

    def one(code: str | None) -> bool | None:
        if code is None:
            return None
        import resource

        def bound() -> None:
            for what, most in ((resource.RLIMIT_AS, megabytes << 20), (resource.RLIMIT_CPU, int(seconds) + 1), (resource.RLIMIT_FSIZE, 1 << 20)):
                resource.setrlimit(what, (most, most))

        with tempfile.TemporaryDirectory() as folder:
            try:
                done = subprocess.run([sys.executable, "-I", "-c", code], cwd=folder, timeout=seconds, preexec_fn=bound, capture_output=True, env={})
            except subprocess.TimeoutExpired:
                return False
            return done.returncode == 0

    def run(x: pa.Array) -> pa.Array:
        return pa.array([one(v) for v in x.to_pylist()], pa.bool_())

    run.__annotations__ = {"x": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, T.BooleanType())(source)


#: Tasks by name: what makes messages of their rows. Callers may add their own.
TASKS: dict[str, Callable[..., DataFrame]] = {"four_choices": four_choices, "lettered_choices": lettered_choices, "worked_answers": worked_answers, "programs": programs}


def conversations_of(task: str, rows: DataFrame, **columns: str) -> DataFrame:
    if task not in TASKS:
        raise ValueError(f"no task {task}; known: {', '.join(sorted(TASKS))}")
    return TASKS[task](rows, **columns)
