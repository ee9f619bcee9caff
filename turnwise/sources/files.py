"""Scans of audio files, catalogs, mappings and artifacts, and the text sinks of a run."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Suffixes of recordings that are converted (fixed values).
AUDIO = ("webm", "mp4", "m4a", "ogg", "opus")
META = "audio string, device string, status string, created_at string, updated_at string"


def audio_files(spark: SparkSession, folder: str, suffixes: tuple[str, ...] = AUDIO, with_content: bool = False) -> DataFrame:
    """Audio files below a folder: path, bytes, modified, and their content only if it is asked for."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{%s}" % ",".join(suffixes)).option("recursiveFileLookup", "true").load(folder)
    return files.select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"), *(["content"] if with_content else []))


def artifacts(spark: SparkSession, folder: str) -> DataFrame:
    """A run's files but its manifest: path, name, category (the first part of the path below the folder), size, mtime.

    The files' content is not read; empty files are not listed (Spark's scan leaves them out).
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length", "modificationTime")
    below = F.regexp_replace("path", "^.*?" + folder.rstrip("/").replace(".", r"\.") + "/", "")
    rows = files.select(below.alias("path"), F.col("length").alias("size"), F.date_format("modificationTime", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("mtime"))
    category = F.when(F.col("path").contains("/"), F.substring_index("path", "/", 1)).otherwise("")
    return rows.select("path", F.substring_index("path", "/", -1).alias("name"), category.alias("category"), "size", "mtime").where(F.col("name") != "manifest.json")


def catalog(spark: SparkSession, path: str, default_label: str = "CAT") -> DataFrame:
    """Catalog entries (pattern, label): a JSON list of objects, a JSON object pattern -> label, or lines of text.

    A ``.jsonl`` file is one document too.  Blank lines and entries without pattern are left out.
    """
    whole = spark.read.text(path, wholetext=True)
    if not path.endswith((".json", ".jsonl")):
        lines = whole.select(F.explode(F.split("value", r"\r?\n")).alias("line"))
        return lines.select(F.trim("line").alias("pattern"), F.lit(default_label).alias("label")).where(F.length("pattern") > 0)
    items = F.from_json("value", "array<map<string,string>>", {"mode": "PERMISSIVE"})
    pairs = F.from_json("value", "map<string,string>", {"mode": "PERMISSIVE"})
    is_list = F.ltrim("value").startswith("[")
    row = lambda p, label: F.struct(p.alias("pattern"), F.upper(F.coalesce(label, F.lit(default_label))).alias("label"))
    get = lambda m, k: F.try_element_at(m, F.lit(k))
    name = lambda m: F.coalesce(*[F.when(F.length(get(m, k)) > 0, get(m, k)) for k in ("pattern", "text", "value", "label")])
    listed = F.transform(items, lambda m: row(name(m), get(m, "label")))
    mapped = F.transform(F.map_entries(pairs), lambda e: row(e["key"], e["value"]))
    rows = whole.select(F.inline(F.when(is_list, listed).otherwise(mapped)))
    return rows.where(F.length("pattern") > 0)


def catalog_types(entries: DataFrame, as_person: bool = False) -> DataFrame:
    """label, values: the catalog's distinct values of each normalised type, sorted."""
    from turnwise.operators.pii import entity_type

    label = F.lit("PERSON") if as_person else entity_type(F.coalesce("label", F.lit("")))
    own = entries.select(label.alias("label"), F.trim("pattern").alias("value")).where(F.length("value") > 0)
    return own.groupBy("label").agg(F.array_sort(F.collect_set("value")).alias("values"))


def lenient_json(text: Column, schema: str) -> Column:
    """A JSON object read by a schema; bad, missing and other JSON gives an object of nulls."""
    parsed = F.from_json(text, schema, {"mode": "PERMISSIVE"})
    fields = T._parse_datatype_string(schema).fields
    return F.struct(*[parsed[f.name].alias(f.name) for f in fields])


def reply_spans(reply: Column) -> Column:
    """A model's JSON reply as spans: integer places, start >= 0, end > start, persons, organisations and places; score 0.99."""
    kind = "array<struct<start:int,end:int,type:string>>"
    items = F.coalesce(F.from_json(reply, kind), F.array().cast(kind))
    good = F.filter(items, lambda x: (x["start"] >= 0) & (x["end"] > x["start"]) & F.upper(x["type"]).isin("PER", "ORG", "LOC"))
    return F.transform(good, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.upper(x["type"]).alias("entity_type"), F.lit(0.99).alias("score"), F.lit("llm").alias("source")))


def manifests(runs: DataFrame) -> DataFrame:
    """One manifest a recording from its runs (rec_id, audio, user_folder, device, lang, run_state, created_at, updated_at).

    The latest run stands, ``created_at`` is that of the first; a missing folder is the first part of the audio path;
    ready runs are ``ready``, others ``failed``.
    """
    tidy = lambda c: F.when(F.length(F.trim(c)) > 0, F.lower(F.trim(c)))
    folder = F.coalesce(tidy(F.col("user_folder")), F.when(F.col("audio").contains("/"), F.substring_index("audio", "/", 1)), F.lit(""))
    row = F.struct(
        F.coalesce("updated_at", "created_at").alias("updated_at"), F.col("audio"), folder.alias("user_folder"), tidy(F.col("device")).alias("device"), tidy(F.col("lang")).alias("lang"),
        F.when(tidy(F.col("run_state")) == "ready", "ready").otherwise("failed").alias("status"),
    )
    best = runs.where(F.col("rec_id").isNotNull()).groupBy("rec_id").agg(F.max(row).alias("m"), F.min("created_at").alias("created_at"), F.count(F.lit(1)).alias("n_runs"))
    return best.select("rec_id", F.lit(1).alias("schema_version"), "m.status", "m.audio", "m.user_folder", "m.device", "m.lang", "created_at", "m.updated_at", "n_runs")


def manifest_json(rows: DataFrame) -> DataFrame:
    """rec_id, manifest: each manifest as JSON with ISO times."""
    iso = lambda c: F.concat(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))
    meta = F.struct("user_folder", "device", "lang")
    return rows.select("rec_id", F.to_json(F.struct("schema_version", "status", "audio", meta.alias("meta"), iso(F.col("created_at")).alias("created_at"), iso(F.col("updated_at")).alias("updated_at"))).alias("manifest"))


def segments_json(segments: DataFrame, recordings: DataFrame) -> DataFrame:
    """rec_id, json: {audio, device, n_speakers, segments} of each recording, segments in order.

    ``n_speakers`` is the run's setting; ``start_s`` and ``end_s`` repeat the bounds where a segment has none of its own.
    """
    own = lambda c, of: (F.coalesce(c, of) if c in segments.columns else F.col(of)).alias(c)
    rows = F.array_sort(F.collect_list(F.struct("start", "end", "seg_idx", "speaker", "text", own("start_s", "start"), own("end_s", "end"))))
    tidy = F.transform(rows, lambda x: F.struct(*[x[c].alias(c) for c in ("start", "end", "start_s", "end_s", "speaker", "text")]))
    by = segments.groupBy("rec_id").agg(tidy.alias("segments"))
    return by.join(recordings.select("rec_id", "audio", "device", "n_speakers"), "rec_id", "left").select("rec_id", F.to_json(F.struct("audio", "device", "n_speakers", "segments")).alias("json"))


def strict_texts(spark: SparkSession, path: str) -> DataFrame:
    """path, text of whole text files with line feeds only; a missing path is Spark's error, not an empty table."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.regexp_replace(F.decode("content", "UTF-8"), r"\r\n?", "\n").alias("text"))


def write_texts(texts: DataFrame, folder: str) -> None:
    """One folder a recording with its text (rec_id, text)."""
    texts.select("rec_id", F.col("text").alias("value")).write.mode("overwrite").partitionBy("rec_id").text(folder)


def prompt(path: str, key: str) -> dict:
    """One report type's prompt from a JSON file; KeyError if it isn't there."""
    with open(path, encoding="utf-8") as f:
        return json.load(f)[key]
