"""Question-answer pairs and histories from conversations (conv_id, turn, role, text)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import vocabulary as V
from ..functions import text as X


def pairs(turns: DataFrame, skip_others: bool = False) -> DataFrame:
    """conv_id, turn, question, answer: a user's turn and the assistant's right after. ``skip_others``: other roles don't come between."""
    rows = turns.where(F.col("role").isin("user", "assistant")) if skip_others else turns
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = rows.select("conv_id", "turn", "role", F.col("text").alias("question"), F.lead("role").over(w).alias("next"), F.lead("text").over(w).alias("answer"))
    return rows.where("role = 'user' and next = 'assistant'").select("conv_id", "turn", "question", "answer")


def from_export(exported: DataFrame) -> DataFrame:
    """Turns of exported conversations: ``messages`` (array of role, content) as they are, or else ``mapping`` (map of nodes) by create_time."""
    listed = exported.where(F.size("messages") > 0).select("conv_id", F.posexplode("messages").alias("turn", "m")).select("conv_id", F.col("turn").cast("long").alias("turn"), "m.role", F.col("m.content").alias("text"))
    node = exported.where(F.coalesce(F.size("messages"), F.lit(0)) < 1).select("conv_id", F.posexplode(F.map_values("mapping")).alias("n", "x"))
    node = node.select("conv_id", "n", F.col("x.message.author.role").alias("role"), F.col("x.message.content").alias("text"), F.coalesce("x.message.create_time", F.lit(0.0)).alias("at"))
    node = node.where(F.col("role").isin("user", "assistant") & (F.coalesce("text", F.lit("")) != ""))
    w = Window.partitionBy("conv_id").orderBy("at", "n")
    return listed.unionByName(node.select("conv_id", (F.row_number().over(w) - 1).cast("long").alias("turn"), "role", "text"))


def classified(qa: DataFrame) -> DataFrame:
    """qa (question, answer) with decision (keep, reject, llm), tags and reason, by keywords alone."""
    text = F.lower(F.concat(F.col("question"), F.lit("\n"), F.col("answer")))
    rows = qa.withColumns({"found": X.qa_tags(text), "code": F.rlike(text, F.lit(V.CODE_SIGNAL)), "other": X.any_in(text, V.OTHER_SUBJECTS)})
    reason = (
        F.when((F.length("question") < 30) | (F.length("answer") < 60), "too_short")
        .when((F.size("found") > 0) & (F.col("code") | (F.size("found") >= 2)), "quick_technical_match")
        .when(F.col("other") & (F.size("found") == 0) & ~F.col("code"), "quick_non_technical_match")
        .when((F.size("found") == 0) & ~F.col("code"), "no_technical_signal")
        .otherwise("needs_llm")
    )
    rows = rows.withColumn("reason", reason)
    decision = F.when(F.col("reason") == "quick_technical_match", "keep").when(F.col("reason") == "needs_llm", "llm").otherwise("reject")
    tags = F.when(F.col("reason").isin("quick_technical_match", "needs_llm"), F.slice("found", 1, 10)).otherwise(F.array().cast("array<string>"))
    return rows.withColumns({"decision": decision, "tags": tags}).drop("found", "code", "other")


def cleaned(qa: DataFrame, least: int = 30) -> DataFrame:
    """qa with question and answer normalised; pairs of which either has under ``least`` characters are dropped."""
    rows = qa.withColumns({c: X.normalized(F.col(c)) for c in ("question", "answer")})
    return rows.where((F.length("question") >= least) & (F.length("answer") >= least))


def imported(qa: DataFrame, smart: bool = False, decisions: DataFrame | None = None) -> DataFrame:
    """(conv_id, turn, source, text, tags): the documents to ingest of question-answer pairs.

    ``smart``: keywords decide, and pairs they leave open go by ``decisions`` (conv_id, turn, keep, tags), a model's; without one such a pair is left out.
    """
    rows = cleaned(qa)
    if not smart:
        rows = rows.withColumn("tags", F.array(F.lit("chatgpt")))
    else:
        rows = classified(rows)
        said = decisions if decisions is not None else rows.select("conv_id", "turn", F.lit(False).alias("keep"), F.array().cast("array<string>").alias("told")).where("false")
        said = said if "told" in said.columns else said.withColumnRenamed("tags", "told")
        rows = rows.join(said, ["conv_id", "turn"], "left").where((F.col("decision") == "keep") | ((F.col("decision") == "llm") & F.coalesce("keep", F.lit(False))))
        rows = rows.withColumn("tags", F.concat("tags", F.coalesce(F.when(F.col("decision") == "llm", F.col("told")), F.array().cast("array<string>"))))
    return rendered(rows).select("conv_id", "turn", F.lit("chatgpt").alias("source"), "text", "tags")


def rendered(qa: DataFrame) -> DataFrame:
    """qa with text: the document that a kept pair is ingested as."""
    tags = F.array_distinct(F.concat(F.array(F.lit("chatgpt")), F.filter(F.coalesce("tags", F.array().cast("array<string>")), lambda t: t != "")))
    parts = [F.lit("# ChatGPT Q/A\n\n#"), F.array_join(tags, " #"), F.lit("\n\n## Pytanie\n"), F.col("question"), F.lit("\n\n## Odpowiedź\n"), F.col("answer"), F.lit("\n")]
    return qa.withColumn("text", F.concat(*parts))


def batches(qa: DataFrame, size: int = 12) -> DataFrame:
    """qa with batch: pairs that a model is asked about in one call, numbered within a conversation."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    return qa.withColumn("batch", F.floor((F.row_number().over(w) - 1) / size))


def last_turns(turns: DataFrame, n: int = 6) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy(F.col("turn").desc())
    return turns.withColumn("back", F.row_number().over(w)).where(F.col("back") <= n)


def history(turns: DataFrame, n: int = 6) -> DataFrame:
    """conv_id, history: the last n turns as lines ``User: ...`` and ``Assistant: ...``."""
    line = F.concat(F.when(F.col("role") == "user", "User: ").otherwise("Assistant: "), F.col("text"), F.lit("\n"))
    lines = F.array_sort(F.collect_list(F.struct("turn", line.alias("line"))))
    return last_turns(turns, n).groupBy("conv_id").agg(F.array_join(F.transform(lines, lambda x: x.line), "").alias("history"))
