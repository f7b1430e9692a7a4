"""Prompt tables: zero-shot, template, few-shot (with example selection), chat, SFT text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusql.functions import prompts as P
from corpusql.functions.text import hash_draw, hash_key
from corpusql.operators.positions import dense_positions


def prompt_zero_shot(examples: DataFrame, key: str = "pos") -> DataFrame:
    return examples.select(key, "db_id", P.zero_shot_prompt("schema", "question").alias("prompt"))


def prompt_template(examples: DataFrame, template: str | None = None, key: str = "pos") -> DataFrame:
    return examples.select(key, "db_id", P.template_prompt(template, "schema", "question").alias("prompt"))


def sft_text(examples: DataFrame, template: str | None = P.CONFIG_PROMPT_TEMPLATE,
             keep: tuple = ()) -> DataFrame:
    """Training text: prompt + one space + gold SQL; every other column dropped
    (``keep`` names key columns to carry along)."""
    return examples.select(
        *keep,
        F.concat(P.template_prompt(template, "schema", "question"), F.lit(" "), F.col("output")).alias("text"))


def chat_messages(prompts: DataFrame, key: str = "pos") -> DataFrame:
    return prompts.select(key, P.chat_messages("prompt").alias("messages"))


def select_few_shot(test: DataFrame, train: DataFrame, k: int, seed: int,
                    index_col: str = "index") -> DataFrame:
    """For every test row, ``k`` training examples from *other* databases.

    Candidates are training rows whose ``db_id`` differs from the test row's
    (an empty id excludes nothing), stably sorted by schema length; the pool is
    the shorter half, or all candidates when that half has fewer than ``k``
    rows; ``min(k, |pool|)`` distinct rows are drawn with seed ``seed + index``
    semantics replaced by md5 draws of ``(seed, index, j)``.

    Plan: training keys (no texts) get one dense position ``g`` in (schema_len,
    db_id, pos) order, so a database is one contiguous run [start, start + n) per schema
    length it has. Candidate position p of a test row maps to ``g`` by stepping over its own
    database's runs in order. Positions are drawn in-row with Floyd's algorithm and
    joined to the keys on ``g``: an O(T*k) equi-join, no test x train pairs; texts
    are fetched for the picked rows only.

    Returns ``(index, slot, g, pick_pos, pick_db_id, schema, question, output)``.
    """
    t_cols = [index_col, "db_id"]
    if k <= 0:
        return (test.select(*t_cols).where(F.lit(False))
                .select(index_col, F.lit(0).alias("slot"), F.lit(0).cast("bigint").alias("g"),
                        F.lit(0).cast("bigint").alias("pick_pos"), F.lit("").alias("pick_db_id"),
                        F.lit("").alias("schema"), F.lit("").alias("question"), F.lit("").alias("output")))
    ranked = dense_positions(
        train.select("db_id", "pos", F.length("schema").alias("_slen")),
        ["_slen", "db_id", "pos"], name="g")
    n_train = ranked.total_rows
    runs = ranked.groupBy("db_id", "_slen").agg(F.min("g").alias("start"), F.count("*").alias("n"))
    runs = runs.groupBy("db_id").agg(F.array_sort(F.collect_list(F.struct("start", "n"))).alias("_runs"))
    none = F.array().cast(runs.schema["_runs"].dataType)
    t = (test.select(*t_cols)
         .join(runs, "db_id", "left")
         .withColumn("_runs", F.when((F.col("db_id").isNull()) | (F.col("db_id") == ""), none).otherwise(F.coalesce("_runs", none)))
         .withColumn("_n", F.aggregate("_runs", F.lit(0).cast("bigint"), lambda s, r: s + r["n"])))
    cand = F.lit(n_train).cast("bigint") - F.col("_n")
    half = F.floor(cand / 2).cast("bigint")
    pool = F.when(half < k, cand).otherwise(half)
    m = F.least(F.lit(k).cast("bigint"), pool)
    idx = F.col(index_col)

    def floyd_step(acc, j):
        draw = F.pmod(hash_draw(F.lit(seed), idx, j), j + 1)
        return F.when(F.array_contains(acc, draw), F.array_append(acc, j)).otherwise(F.array_append(acc, draw))

    picks = F.when(m > 0, F.aggregate(F.sequence(pool - m, pool - 1), F.array().cast("array<bigint>"), floyd_step)) \
        .otherwise(F.array().cast("array<bigint>"))
    ordered = F.array_sort(F.transform(picks, lambda p: F.struct(
        hash_key(F.lit(seed), idx, p).alias("k"), p.alias("p"))))
    drawn = (t.select(index_col, "_runs", F.posexplode(ordered).alias("slot", "_pk"))
             .select(index_col, (F.col("slot") + 1).cast("bigint").alias("slot"),
                     F.aggregate("_runs", F.col("_pk.p"), lambda g, r: F.when(g >= r["start"], g + r["n"]).otherwise(g)).alias("g")))
    keys = drawn.join(ranked.select("g", F.col("pos").alias("pick_pos"), F.col("db_id").alias("pick_db_id")), "g")
    texts = train.select(F.col("db_id").alias("pick_db_id"), F.col("pos").alias("pick_pos"), "schema", "question", "output")
    return (keys.join(texts, ["pick_db_id", "pick_pos"])
            .select(index_col, "slot", "g", "pick_pos", "pick_db_id", "schema", "question", "output"))


def _picked_arrays(picks: DataFrame, index_col: str, sql_field: str) -> DataFrame:
    return picks.groupBy(index_col).agg(F.array_sort(F.collect_list(F.struct(
        "slot", "schema", "question", F.col("output").alias(sql_field)))).alias("_ex"))


def prompt_few_shot(test: DataFrame, picks: DataFrame, index_col: str = "index") -> DataFrame:
    """Evaluator wording; every group holds at most ``k`` picks."""
    ex = _picked_arrays(picks, index_col, "output")
    return (test.join(ex, index_col, "left")
            .select(index_col, "db_id", P.few_shot_prompt(
                "schema", "question",
                F.coalesce("_ex", F.array().cast(ex.schema["_ex"].dataType))).alias("prompt")))


def prompt_few_shot_shared(test: DataFrame, picks: DataFrame, index_col: str = "index") -> DataFrame:
    """Shared-formatter wording (examples keyed ``sql``)."""
    ex = _picked_arrays(picks, index_col, "sql")
    return (test.join(ex, index_col, "left")
            .select(index_col, "db_id", P.shared_few_shot_prompt(
                "schema", "question",
                F.coalesce("_ex", F.array().cast(ex.schema["_ex"].dataType))).alias("prompt")))
