"""File sources: folders of notes, repositories, exported conversations, telemetry logs."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# What a repository scan takes and passes over.
TEXT_ENDINGS = ("txt", "md", "markdown", "csv", "json", "yaml", "yml", "log")
CODE_ENDINGS = (".adoc", ".py", ".yaml", ".yml", ".json", ".sql", ".sh", ".bash", ".ps1", ".bat", ".cmd", ".tf", ".md", ".toml", ".ini", ".conf", ".env", ".txt", ".j2", ".rsc")
CODE_NAMES = ("Containerfile", "Dockerfile", "Makefile")
IGNORED = (".git", ".idea", ".pytest_cache", ".ruff_cache", ".terraform", ".venv", "__pycache__", "build", "dist", "node_modules", "target", "venv")

# Which repository files go into the graph.
GRAPH_ENDINGS = (".adoc", ".conf", ".ini", ".json", ".md", ".rsc", ".rst", ".tf", ".toml", ".txt", ".yaml", ".yml")
GRAPH_NAMES = ("Containerfile", "Dockerfile", "Makefile", "README")
GRAPH_FOLDERS = ("charts", "config", "deploy", "deployments", "doc", "docs", "examples", "install", "manifests", "operator", "runbooks", "samples", "troubleshooting")
GRAPH_STEMS = ("readme", "architecture", "design", "runbook", "troubleshooting")
GRAPH_ALWAYS = (".md", ".adoc", ".rst", ".tf", ".yaml", ".yml", ".rsc")

TELEMETRY = (
    "ts long, endpoint string, query string, elapsed_ms long, rag_used boolean, relevance_score double, top_score double, lexical_overlap double, "
    "gate_reason string, results_before_gate int, results_after_gate int, result_count int, types map<string,int>, sources array<string>"
)
EXPORT = (
    "conv_id long, messages array<struct<role:string,content:string>>, "
    "mapping map<string,struct<message:struct<author:struct<role:string>,content:string,create_time:double>>>"
)


def decoded(content, charset: str = "utf-8"):
    """Bytes as stripped text, without what isn't valid UTF-8."""
    return F.regexp_replace(F.replace(F.decode(content, charset), F.lit("�"), F.lit("")), r"(?U)^\s+|\s+$", "")


def ending(name):
    """The last ending with its point in lower case, '' without one; a leading point begins a name, not an ending."""
    return F.lower(F.regexp_extract(name, r"[^/](\.[^./]+)$", 1))


def for_graph(rel):
    """Whether a repository file, by its path, goes into the graph."""
    name, kind = F.element_at(F.split(rel, "/"), -1), ending(rel)
    inside = F.arrays_overlap(F.slice(F.split(rel, "/"), 1, F.greatest(F.size(F.split(rel, "/")) - 1, F.lit(0))), F.array(*map(F.lit, GRAPH_FOLDERS)))
    stem = F.rlike(F.lower(name), F.lit(f"^({'|'.join(GRAPH_STEMS)})"))
    return name.isin(*GRAPH_NAMES) | (kind.isin(*GRAPH_ENDINGS) & (inside | stem | kind.isin(*GRAPH_ALWAYS)))


def graph_text(collection, rel, text):
    """What is read for relations: a title from the file's name, where it lies, its text."""
    name = F.element_at(F.split(rel, "/"), -1)
    plain = F.trim(F.translate(F.regexp_replace(name, r"(?<=.)\.[^.]*$", ""), "_-", "  "))
    title = F.when(F.startswith(F.lower(name), F.lit("readme")), F.concat(collection, F.lit(" README"))).when(plain == "", rel).otherwise(plain)
    return F.concat(F.lit("# "), title, F.lit("\n\nRepository: "), collection, F.lit("\nPath: "), rel, F.lit("\n\n"), text)


def files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path, name, size, content (bytes) of all files below path. The size filter of a query on top is checked before content is read."""
    return (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
        .select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"), "content")
    )


def folder(spark: SparkSession, path: str) -> DataFrame:
    """source (file name), text of the Markdown notes below path, but for those named index... and CONFIG..."""
    rows = files(spark, path, "*.md").where(~F.rlike("name", F.lit("^(index|CONFIG)")))
    return rows.select(F.col("name").alias("source"), decoded(F.col("content")).alias("text"))


def texts(spark: SparkSession, path: str) -> DataFrame:
    """source, text of files with a text ending; of others text is null."""
    ending = F.lower(F.regexp_extract("name", r"\.([^.]+)$", 1))
    return files(spark, path).select(F.col("name").alias("source"), F.when(ending.isin(*TEXT_ENDINGS), decoded(F.col("content"))).alias("text"))


def repository(spark: SparkSession, path: str, collection: str, endings: tuple[str, ...] = CODE_ENDINGS, include: tuple[str, ...] = (), most: int = 500, most_bytes: int = 250_000) -> DataFrame:
    """source (repo:collection:path), name, language, text: the first ``most`` files by path that pass the filters and aren't blank."""
    rows = files(spark, path).where(F.col("size") <= most_bytes)
    # What follows the folder in a file's path, however the path names the file system.
    below = re.sub(r"^\w+:/*", "/", path).rstrip("/") + "/"
    rows = rows.withColumn("rel", F.substring_index("path", below, -1) if "*" not in below else F.col("name"))
    named = F.col("name").isin(*CODE_NAMES)
    rows = rows.where(ending(F.col("name")).isin(*[e.lower() if e.startswith(".") else f".{e.lower()}" for e in endings]) | named)
    rows = rows.where(~F.arrays_overlap(F.split("rel", "/"), F.array(*[F.lit(x) for x in IGNORED])))
    if include:
        inside = F.lit(False)
        for p in include:
            inside = inside | (F.col("rel") == p.strip("/")) | F.startswith("rel", F.lit(p.strip("/") + "/"))
        rows = rows.where(inside)
    rows = rows.withColumn("text", decoded(F.col("content"))).where("text <> ''").orderBy("rel").limit(max(1, min(most, 5000)))
    return rows.select(F.concat(F.lit(f"repo:{collection}:"), F.col("rel")).alias("source"), F.col("rel").alias("name"), "text")


def conversations(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EXPORT).option("multiLine", "true").json(path)


def telemetry(spark: SparkSession, path: str) -> DataFrame:
    """Telemetry records from JSON lines; lines that can't be read are passed over."""
    return spark.read.schema(TELEMETRY).option("mode", "DROPMALFORMED").json(path)


def append_telemetry(records: DataFrame, path: str) -> None:
    records.write.mode("append").json(path)


def note(spark: SparkSession, title: str, body: str, tags: list[str]) -> DataFrame:
    """source, text of one note: title, tag line, body."""
    return spark.range(1).select(F.lit(title).alias("source"), F.concat_ws("\n\n", F.lit(f"# {title}"), F.lit(" ".join(f"#{t}" for t in tags)), F.lit(body)).alias("text"))
