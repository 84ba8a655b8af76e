"""Dataset registry: a JSON map of dataset entries as a table, and the settings of the datasets a job names."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.schema import ASSISTANT, FUNCTION, OBSERVATION, SYSTEM, USER

ENTRY = (
    "struct<file_name:string,hf_hub_url:string,ms_hub_url:string,script_url:string,file_sha1:string,subset:string,"
    "folder:string,ranking:boolean,formatting:string,columns:map<string,string>,tags:map<string,string>>"
)


@dataclass(frozen=True)
class DatasetSpec:
    """How one source is read and which of its columns and tags play which role."""

    name: str
    load_from: str = "file"
    location: str | None = None
    file_sha1: str | None = None
    subset: str | None = None
    folder: str | None = None
    ranking: bool = False
    formatting: str = "alpaca"
    system: str | None = None
    prompt: str | None = "instruction"
    query: str | None = "input"
    response: str | None = "output"
    history: str | None = None
    messages: str | None = "conversations"
    tools: str | None = None
    chosen: str | None = None
    rejected: str | None = None
    role_tag: str | None = "from"
    content_tag: str | None = "value"
    user_tag: str | None = "human"
    assistant_tag: str | None = "gpt"
    observation_tag: str | None = "observation"
    function_tag: str | None = "function_call"
    system_tag: str | None = "system"


ALPACA_COLUMNS = ("system", "prompt", "query", "response", "history")
SHAREGPT_COLUMNS = ("system", "messages", "tools")
PAIR_COLUMNS = ("chosen", "rejected")
TAGS = ("role_tag", "content_tag", "user_tag", "assistant_tag", "observation_tag", "function_tag", "system_tag")


def registry_from_json(df: DataFrame, column: str = "value") -> DataFrame:
    """SRC-04: rows of JSON text, each a map name -> entry, as one row per dataset."""
    parsed = df.select(F.explode(F.from_json(column, f"map<string,{ENTRY}>")).alias("name", "entry"))
    return parsed.select("name", "entry.*").withColumn("load_from", source_kind()).withColumn("location", location())


def load_registry(spark: SparkSession, path: str) -> DataFrame:
    return registry_from_json(spark.read.text(path, wholetext=True))


def source_kind(prefer_ms: bool = False) -> Column:
    """Where an entry is loaded from: a hub, then script, then file; with both hubs the preferred one."""
    hubs = [("hf_hub_url", "hf_hub"), ("ms_hub_url", "ms_hub")]
    kind = F.when(F.lit(False), F.lit(None).cast("string"))
    for column, name in [*(reversed(hubs) if prefer_ms else hubs), ("script_url", "script")]:
        kind = kind.when(F.col(column).isNotNull(), name)
    return kind.otherwise("file")


def location() -> Column:
    return (
        F.when(F.col("load_from") == "hf_hub", F.col("hf_hub_url"))
        .when(F.col("load_from") == "ms_hub", F.col("ms_hub_url"))
        .when(F.col("load_from") == "script", F.col("script_url"))
        .otherwise(F.col("file_name"))
    )


def split_names(names: str | Sequence[str] | None) -> list[str]:
    if names is None:
        return []
    return [n.strip() for n in (names.split(",") if isinstance(names, str) else names)]


def resolve_rows(registry: DataFrame, names: str | Sequence[str]) -> DataFrame:
    """The named entries in the order given; a name without entry makes the job fail."""
    wanted = split_names(names)
    asked = registry.sparkSession.createDataFrame(list(enumerate(wanted)), "dataset_idx int, name string")
    joined = F.broadcast(asked).join(registry.withColumn("_known", F.lit(True)), "name", "left")
    undefined = F.raise_error(F.concat(F.lit("undefined dataset "), F.col("name"))).cast("boolean")
    return joined.where(F.coalesce(F.col("_known"), undefined)).drop("_known")


def resolve(registry: DataFrame, names: str | Sequence[str]) -> list[DatasetSpec]:
    """Settings of the named datasets (a handful of rows)."""
    wanted = split_names(names)
    rows = {r["name"]: r.asDict(recursive=True) for r in registry.where(F.col("name").isin(wanted)).collect()}
    missing = [n for n in wanted if n not in rows]
    if missing:
        raise ValueError(f"undefined dataset {', '.join(missing)}")
    return [spec_of(rows[n]) for n in wanted]


def spec_of(row: dict) -> DatasetSpec:
    spec = DatasetSpec(
        name=row["name"],
        load_from=row["load_from"],
        location=row["location"],
        file_sha1=row["file_sha1"],
        subset=row["subset"],
        folder=row["folder"],
        ranking=bool(row["ranking"]),
        formatting=row["formatting"] or "alpaca",
    )
    return with_tags(with_columns(spec, row["columns"]), row["tags"])


def with_columns(spec: DatasetSpec, columns: dict[str, str] | None) -> DatasetSpec:
    """SRC-05: once columns are declared, every role left out has no column (not its default one)."""
    if columns is None:
        return spec
    names = ALPACA_COLUMNS if spec.formatting == "alpaca" else SHAREGPT_COLUMNS
    return replace(spec, **{n: columns.get(n) for n in (*names, *PAIR_COLUMNS)})


def with_tags(spec: DatasetSpec, tags: dict[str, str] | None) -> DatasetSpec:
    """SRC-06: tag names, chat format only; undeclared ones are unset."""
    if tags is None or spec.formatting != "sharegpt":
        return spec
    return replace(spec, **{n: tags.get(n) for n in TAGS})


def map_columns(df: DataFrame, spec: DatasetSpec, keep: Sequence[str] = ()) -> DataFrame:
    """SRC-05: the declared source columns under their role names, NULL for the others."""
    names = ALPACA_COLUMNS if spec.formatting == "alpaca" else SHAREGPT_COLUMNS
    roles = []
    for role in names:
        source = getattr(spec, role)
        column = F.col(source) if source and source in df.columns else F.lit(None).cast("string")
        roles.append(column.alias(role))
    return df.select(*keep, *roles)


def tag_roles(spec: DatasetSpec) -> dict[str, str]:
    """SRC-06: source tag -> canonical role."""
    pairs = [
        (spec.user_tag, USER),
        (spec.assistant_tag, ASSISTANT),
        (spec.observation_tag, OBSERVATION),
        (spec.function_tag, FUNCTION),
        (spec.system_tag, SYSTEM),
    ]
    return {tag: role for tag, role in pairs if tag is not None}


def map_tags(role: Column, spec: DatasetSpec) -> Column:
    """SRC-06/ALN-07: canonical role of a tag, NULL for unknown ones."""
    mapping = F.create_map(*[F.lit(x) for pair in tag_roles(spec).items() for x in pair])
    return F.try_element_at(mapping, role)
