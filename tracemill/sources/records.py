"""JSON sources and sinks, tolerant of the layouts that producers have written over time."""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracemill.functions import text as X
from tracemill.operators.once import numbered
from tracemill.schemas import FILTER_RECORD
from tracemill.workspace import delete, exists, move, read_text, write_text


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table of a folder.  One that comes in fewer pieces than there are cores is dealt out to them."""
    table = spark.read.parquet(f"{folder}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return table.repartition(cores) if name in LARGE and table.rdd.getNumPartitions() < cores else table


#: Tables whose rows are worth dealing out: a file of one row group would keep a single core busy.
LARGE = ("documents", "pages", "conversations")


def read_lines(spark: SparkSession, path: str, schema: str | T.StructType, tolerant: bool = False) -> DataFrame:
    """JSON lines; blank lines are skipped.  ``tolerant`` drops broken lines, otherwise they fail."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED" if tolerant else "FAILFAST").json(path)


def read_records(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """A JSON array, or a single object as one row, by suffix ``.json``; JSON lines otherwise."""
    if path.endswith(".json"):
        return spark.read.schema(schema).option("multiLine", True).json(path)
    return read_lines(spark, path, schema)


def write_records(df: DataFrame, path: str, single: bool = False, mode: str = "errorifexists") -> None:
    """JSON lines in a folder; ``single`` makes one file of a small result.  Parents are made."""
    (df.coalesce(1) if single else df).write.mode(mode).json(path)


def rescored_path(path: str) -> str:
    """Where a rescored copy goes: never over the path that is being read."""
    root, ext = os.path.splitext(path.rstrip("/"))
    return f"{root}.rescored{ext}"


def record_key(subset: Column, subject: Column | None, sample_idx: Column) -> Column:
    """(subset or subject, sample_idx as a number), or null without either."""
    name = F.coalesce(F.when(subset != "", subset), subject) if subject is not None else F.when(subset != "", subset)
    idx = sample_idx.cast("string").try_cast("long")
    return F.when(name.isNotNull() & idx.isNotNull(), F.struct(name.alias("subset"), idx.alias("sample_idx")))


def record_id(subset: Column, sample_idx: Column) -> Column:
    """``subset_0001`` from both parts; null without a number."""
    idx = sample_idx.cast("string").try_cast("long")
    return F.when(subset.isNotNull() & idx.isNotNull(), F.format_string("%s_%04d", subset, idx))


def _field(df: DataFrame, path: str, kind: str = "string") -> Column:
    """A field by dotted path, or null where the source has none."""
    schema: T.DataType = df.schema
    for name in path.split("."):
        if not isinstance(schema, T.StructType) or name not in schema.names:
            return F.lit(None).cast(kind)
        schema = schema[name].dataType
    return F.col(path).cast(kind)


def to_scored(df: DataFrame) -> DataFrame:
    """Records of any known layout as scored samples: the first field present wins, in a fixed order."""
    get = lambda p, k="string": _field(df, p, k)
    subset = F.coalesce(get("subset"), get("subject"))
    identity = F.coalesce(get("id"), record_id(subset, get("sample_idx")), get("global_idx"))
    answer = F.coalesce(*(X.answer_index(get(p)) for p in ("answer", "correct", "gold_letter", "gold")))
    final = F.coalesce(get("final"), get("final_response"))
    reasoned = F.coalesce(get("reasoning_content"), get("cf_reasoning_content"))
    content = F.coalesce(get("reasoning"), get("cf_content"))
    cot = F.coalesce(
        get("cot"),
        F.when(reasoned.isNotNull() & F.coalesce(content, final).isNotNull(), X.joined_cot(reasoned, F.coalesce(content, final))),
        final, content, reasoned, get("think"),
    )
    grade = lambda n: F.coalesce(get(f"judge_score.{n}", "double"), get(f"scores.{n}.mean", "double"))
    grades = F.struct(*(grade(n).alias(n) for n in ("step_coherence", "korean_fluency", "step_coverage")))
    history = get("filter_history", f"array<{FILTER_RECORD}>")
    return df.select(
        identity.alias("id"), subset.alias("subset"), get("question").alias("question"),
        get("choices", "array<string>").alias("choices"), answer.alias("answer"),
        F.coalesce(get("teacher_model"), get("model")).alias("teacher_model"), cot.alias("cot"),
        X.answer_index(F.coalesce(get("predicted_answer"), get("predicted"))).alias("predicted_answer"),
        F.coalesce(history, F.array().cast(f"array<{FILTER_RECORD}>")).alias("filter_history"),
        F.when(grades["step_coherence"].isNotNull(), grades).alias("judge_score"),
        F.struct(
            get("global_idx", "long").alias("global_idx"), get("sample_idx").try_cast("long").alias("sample_idx"),
            get("gold_letter").alias("gold_letter"), get("wrong_letter").alias("wrong_letter"),
        ).alias("metadata"),
    )


def with_positions(bank: DataFrame, *stable: str, subset: str = "subset", position: str = "sample_idx") -> DataFrame:
    """A question bank's position within each subset, where the source has none: by a stable order, from 0."""
    return bank if position in bank.columns else numbered(bank, [subset], list(stable), position)


def is_counterfactual(df: DataFrame) -> bool:
    """Whether records hold generated counterfactuals, by their fields."""
    return bool({"cf_content", "cf_reasoning_content"} & set(df.schema.fieldNames()))


def split_of(path: Column) -> Column:
    """train, dev, test or fewshot by the first of these that a file's name holds; train without any."""
    name = F.lower(F.substring_index(path, "/", -1))
    out = F.lit("train")
    for split in ("fewshot", "test", "dev", "train"):
        out = F.when(name.contains(split), split).otherwise(out)
    return out


def refuse_test_split(split: str) -> None:
    if split == "test":
        raise ValueError("counterfactuals are never generated from the test split")


def first_existing(spark: SparkSession, *paths: str | None) -> str | None:
    """The first path that is there, in whatever store it lies."""
    return next((p for p in paths if p and exists(spark, p)), None)


def parse_shard(text: str | None) -> tuple[int, int] | None:
    """``i/N`` with 0 <= i < N; None for none."""
    if text is None:
        return None
    try:
        i, n = map(int, text.split("/"))
    except ValueError as e:
        raise ValueError(f"a shard is i/N, not {text!r}") from e
    if not 0 <= i < n:
        raise ValueError(f"a shard needs 0 <= i < N, not {text!r}")
    return i, n


def shard_path(path: str, shard: tuple[int, int] | None) -> str:
    if shard is None:
        return path
    root, ext = os.path.splitext(path)
    return f"{root}.shard{shard[0]}-of-{shard[1]}{ext}"


def in_shard(df: DataFrame, shard: tuple[int, int] | None, key: str = "global_idx") -> DataFrame:
    return df if shard is None else df.where(F.pmod(F.col(key), F.lit(shard[1])) == shard[0])


def samples_per_subset(total: int, subsets: tuple[str, ...]) -> dict[str, int | None]:
    """Equal shares, the remainder to the first subsets; all rows for a negative total."""
    if total < 0:
        return dict.fromkeys(subsets)
    each, more = divmod(total, len(subsets))
    return {s: each + (i < more) for i, s in enumerate(subsets)}


def balanced_limit(df: DataFrame, total: int, subsets: tuple[str, ...], subset: str = "subset", position: str = "sample_idx") -> DataFrame:
    """The first rows of each subset, by position."""
    wanted = samples_per_subset(total, subsets)
    df = df.where(F.col(subset).isin(*subsets))
    if total < 0:
        return df
    limit = F.create_map(*(F.lit(x) for kv in wanted.items() for x in kv))
    return df.where(F.col(position) < limit[F.col(subset)])


def register_dataset(spark: SparkSession, path: str, name: str, entry: dict) -> dict:
    """Insert or replace an entry of a small JSON registry."""
    known = json.loads(read_text(spark, path)) if exists(spark, path) else {}
    known[name] = entry
    write_text(spark, path, json.dumps(known, ensure_ascii=False, indent=2))
    return known


def replace_records(df: DataFrame, path: str, mark: str = ".bak_strict") -> None:
    """JSON lines in the place of what ``df`` may have been read from; the first original stays as a backup.

    The new records are complete before anything is moved, so the path is never being read and written at once.
    """
    spark, path = df.sparkSession, path.rstrip("/")
    beside, backup = f"{path}.{uuid.uuid4().hex}.new", f"{path}{mark}"
    write_records(df, beside)
    if exists(spark, path):
        delete(spark, path) if exists(spark, backup) else move(spark, path, backup)
    move(spark, beside, path)
