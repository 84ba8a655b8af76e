"""Alignment: instruction rows and chat turns -> the fixed (prompt, response, system, tools) schema."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.operators.ordering import positions
from corpusflow.schema import ALIGNED, ASSISTANT, MESSAGES, NON_BLANK, USER
from corpusflow.session import broadcast_if_small, written
from corpusflow.sources.registry import DatasetSpec, map_tags


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.cast("string").alias("content"))


def _text(column: str | None, df: DataFrame) -> Column:
    """A declared column's text; NULL and '' both mean absent."""
    if not column or column not in df.columns:
        return F.lit(None).cast("string")
    return F.nullif(F.col(column), F.lit(""))


def responses_to_array(df: DataFrame, column: str | None) -> Column:
    """ALN-02: a list gives one assistant message each (ranking data), text one, anything else none."""
    none = F.array().cast(MESSAGES)
    if not column or column not in df.columns:
        return none
    kind = df.schema[column].dataType.typeName()
    if kind == "array":
        return F.coalesce(F.transform(column, lambda x: message(ASSISTANT, x)), none)
    if kind == "string":
        return F.when(F.col(column).isNull(), none).otherwise(F.array(message(ASSISTANT, F.col(column))))
    return none


def align_alpaca(df: DataFrame, spec: DatasetSpec, keep: Sequence[str] = ()) -> DataFrame:
    """ALN-01: earlier (prompt, response) pairs, then the non-empty prompt and query joined as the last user turn."""
    history = F.array().cast(MESSAGES)
    if spec.history and spec.history in df.columns:
        history = F.coalesce(
            F.flatten(
                F.transform(spec.history, lambda pair: F.array(message(USER, pair[0]), message(ASSISTANT, pair[1])))
            ),
            history,
        )
    question = F.concat_ws("\n", _text(spec.prompt, df), _text(spec.query, df))
    if spec.chosen and spec.rejected and not spec.response:
        response = F.array(message(ASSISTANT, F.col(spec.chosen)), message(ASSISTANT, F.col(spec.rejected)))
    else:
        response = responses_to_array(df, spec.response)
    return df.select(
        *keep,
        F.concat(history, F.array(message(USER, question))).cast(MESSAGES).alias("prompt"),
        response.cast(MESSAGES).alias("response"),
        (F.col(spec.system).cast("string") if spec.system else F.lit("")).alias("system"),
        F.lit("").alias("tools"),
    )


def extract_system(msgs: Column, role_tag: str, content_tag: str, system_tag: str | None, default: Column) -> tuple:
    """ALN-04: (system text, remaining messages); only a first message with the system tag counts."""
    if not system_tag:
        return default, msgs
    first = F.get(msgs, F.lit(0))
    has = F.coalesce(first[role_tag] == system_tag, F.lit(False))
    return (
        F.when(has, first[content_tag]).otherwise(default),
        F.when(has, F.slice(msgs, F.lit(2), F.greatest(F.size(msgs) - 1, F.lit(0)))).otherwise(msgs),
    )


def truncate_even(msgs: Column) -> Column:
    """ALN-05."""
    return F.slice(msgs, F.lit(1), F.size(msgs) - F.size(msgs) % 2)


def turns_valid(msgs: Column, role_tag: str, spec: DatasetSpec) -> Column:
    """ALN-06: even positions speak for the user or a tool, odd ones for the assistant or call a function."""
    odd = [t for t in (spec.user_tag, spec.observation_tag) if t is not None]
    even = [t for t in (spec.assistant_tag, spec.function_tag) if t is not None]
    checks = F.transform(
        msgs, lambda m, i: F.when(i % 2 == 0, m[role_tag].isin(odd)).otherwise(m[role_tag].isin(even))
    )
    return F.forall(checks, lambda ok: F.coalesce(ok, F.lit(False)))


def align_sharegpt(df: DataFrame, spec: DatasetSpec, keep: Sequence[str] = (), mode: str = "fail") -> DataFrame:
    """ALN-03: all but the last message are the prompt, the last one is the response.

    ``mode`` says what a wrong role order does: ``fail`` the job, ``drop`` the row, or ``quarantine`` it (kept with
    ``valid = false``).
    """
    if mode not in ("fail", "drop", "quarantine"):
        raise ValueError("mode must be fail, drop or quarantine")
    default = F.coalesce(F.col(spec.system).cast("string"), F.lit("")) if spec.system else F.lit("")
    system, rest = extract_system(F.col(spec.messages), spec.role_tag, spec.content_tag, spec.system_tag, default)
    tools = F.col(spec.tools).cast("string") if spec.tools and spec.tools in df.columns else F.lit("")
    stage = df.select(*keep, system.alias("system"), tools.alias("tools"), truncate_even(rest).alias("_m"))
    stage = stage.where(F.size("_m") > 0)
    ok = turns_valid(F.col("_m"), spec.role_tag, spec)
    if mode == "drop":
        stage = stage.where(ok)
    elif mode == "fail":
        stage = stage.where(
            F.when(ok, F.lit(True)).otherwise(
                F.raise_error(F.concat(F.lit("invalid role tag in "), F.to_json("_m"))).cast("boolean")
            )
        )
    aligned = F.transform(
        "_m", lambda m: F.struct(map_tags(m[spec.role_tag], spec).alias("role"), m[spec.content_tag].alias("content"))
    ).cast(MESSAGES)
    result = stage.withColumn("_a", aligned).select(
        *keep,
        F.slice("_a", F.lit(1), F.greatest(F.size("_a") - 1, F.lit(0))).alias("prompt"),
        F.slice("_a", -1, 1).alias("response"),
        "system",
        "tools",
        *([ok.alias("valid")] if mode == "quarantine" else []),
    )
    return result


def align(df: DataFrame, spec: DatasetSpec, keep: Sequence[str] = (), mode: str = "fail") -> DataFrame:
    """ALN-09: align by the source's format; all other source columns are dropped and the types are fixed."""
    aligned = align_alpaca(df, spec, keep) if spec.formatting == "alpaca" else align_sharegpt(df, spec, keep, mode)
    extra = ["valid"] if "valid" in aligned.columns else []
    return aligned.select(*keep, *[F.col(f.name).cast(f.dataType).alias(f.name) for f in ALIGNED], *extra)


def assemble_turns(
    turns: DataFrame, conv: str, turn: str, role: str, content: str, out: str = "conversations"
) -> DataFrame:
    """ALN-08: one row per conversation with its messages in order of turn.

    A conversation is one record here; :func:`align_conversations` never builds one.
    """
    items = F.array_sort(F.collect_list(F.struct(F.col(turn).alias("t"), F.col(role).alias("from"), F.col(content).alias("value"))))
    return (
        turns.groupBy(conv)
        .agg(items.alias("_items"))
        .select(conv, F.transform("_items", lambda x: F.struct(x["from"].alias("from"), x["value"].alias("value"))).alias(out))
    )


def explode_aligned(aligned: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Aligned rows as one row per message: (keys, idx, part, role, content, system)."""
    n = F.size("prompt")
    return aligned.select(
        *keep, "system", n.alias("_n"), F.posexplode(F.concat("prompt", "response")).alias("idx", "m")
    ).select(
        *keep,
        "idx",
        F.when(F.col("idx") < F.col("_n"), "prompt").otherwise("response").alias("part"),
        F.col("m.role").alias("role"),
        F.col("m.content").alias("content"),
        "system",
    )


def align_conversations(
    turns: DataFrame,
    conv: str,
    turn: str,
    role: str,
    content: str,
    spec: DatasetSpec,
    chunk: Column,
    mode: str = "fail",
) -> DataFrame:
    """ALN-03 on turn rows: message rows out, for conversations of any length; no conversation is ever one record.

    Positions come from chunk offsets, so one conversation may be spread over many tasks.  ``spec.system`` and
    ``spec.tools`` may name columns of the turns; a conversation has those of its first turn.  ``mode`` is that of
    :func:`align_sharegpt`; ``quarantine`` adds ``valid``.
    """
    if mode not in ("fail", "drop", "quarantine"):
        raise ValueError("mode must be fail, drop or quarantine")
    has = lambda name: bool(name) and name in turns.columns
    tools = F.coalesce(F.col(spec.tools).cast("string"), F.lit("")) if has(spec.tools) else F.lit("")
    default = F.coalesce(F.col(spec.system).cast("string"), F.lit("")) if has(spec.system) else F.lit("")
    speaks = F.coalesce(F.col(role) == F.lit(spec.system_tag), F.lit(False)) if spec.system_tag else F.lit(False)
    first = F.struct(speaks.alias("is_system"), F.when(speaks, F.col(content)).otherwise(default).alias("system"), tools.alias("tools"))
    heads = turns.groupBy(conv).agg(F.min_by(first, turn).alias("_first"))
    odd = [t for t in (spec.user_tag, spec.observation_tag) if t is not None]
    even = [t for t in (spec.assistant_tag, spec.function_tag) if t is not None]

    def placed(columns: Sequence[str], heads: DataFrame) -> DataFrame:
        rows = positions(turns.select(*dict.fromkeys([conv, turn, *columns])), [conv], [turn], chunk, out="_p", total="_n")
        rows = rows.join(heads, conv)
        shift = F.col("_first.is_system").cast("int")
        rows = rows.withColumn("idx", (F.col("_p") - shift).cast("int")).withColumn("_len", F.col("_n") - shift)
        rows = rows.withColumn("_len", F.col("_len") - F.col("_len") % 2)
        return rows.where((F.col("idx") >= 0) & (F.col("idx") < F.col("_len")))

    ok = F.coalesce(F.when(F.col("idx") % 2 == 0, F.col(role).isin(odd)).otherwise(F.col(role).isin(even)), F.lit(False))
    rows = placed([role, content], heads)
    extra = []
    if mode == "fail":
        rows = rows.where(F.when(ok, F.lit(True)).otherwise(F.raise_error(F.lit("invalid role tag")).cast("boolean")))
    else:
        short = heads.select(conv, F.struct(F.col("_first.is_system").alias("is_system")).alias("_first"))
        bad = written(placed([role], short).where(~ok).select(conv).distinct(), "bad-conversations")
        if mode == "drop":
            rows = rows.join(broadcast_if_small(bad), conv, "left_anti")
        else:
            rows = rows.join(broadcast_if_small(bad.withColumn("_bad", F.lit(True))), conv, "left")
            extra = [F.col("_bad").isNull().alias("valid")]
    return rows.select(
        conv,
        "idx",
        F.when(F.col("idx") < F.col("_len") - 1, "prompt").otherwise("response").alias("part"),
        map_tags(F.col(role), spec).alias("role"),
        F.col(content).cast("string").alias("content"),
        F.col("_first.system").alias("system"),
        *([F.col("_first.tools").alias("tools")] if has(spec.tools) else []),
        *extra,
    )


# Filters on aligned rows.


def valid_sft(df: DataFrame) -> DataFrame:
    """FLT-01: odd number of prompt messages and exactly one response."""
    return df.where((F.size("prompt") % 2 == 1) & (F.size("response") == 1))


def valid_prompt(df: DataFrame) -> DataFrame:
    """FLT-02."""
    return df.where(F.size("prompt") % 2 == 1)


def valid_pair(df: DataFrame) -> DataFrame:
    """FLT-03: odd number of prompt messages and at least two responses."""
    return df.where((F.size("prompt") % 2 == 1) & (F.size("response") >= 2))


def nonempty_text(df: DataFrame, text: str) -> DataFrame:
    """FLT-05: texts with at least one non-blank character."""
    return df.where(F.col(text).rlike(NON_BLANK))
