"""Scores, top-k, merging and shapes of results."""

from __future__ import annotations

import json
import time

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def score(matches: Column) -> Column:
    """Sum of 1 / (1 + width) over the matches, 1 at least."""
    return F.greatest(F.lit(1.0), F.aggregate(matches, F.lit(0.0), lambda acc, m: acc + 1.0 / (1 + m["end"] - m["start"])))


def top(hits: DataFrame, limit: int | None = None) -> DataFrame:
    """By falling score, ties by document and sentence; Spark plans a limit as partial and final top-k."""
    ordered = hits.orderBy(F.desc("score"), "doc_id", "sentence_idx")
    return ordered if limit is None else ordered.limit(limit)


def dedup_max(hits: DataFrame) -> DataFrame:
    """One row a sentence, of the highest score. Hits of one query are unique already."""
    best = Window.partitionBy("doc_id", "sentence_id").orderBy(F.desc("score"), "sentence_idx")
    return hits.withColumn("_r", F.row_number().over(best)).where("_r = 1").drop("_r")


def merge(*parts: DataFrame, limit: int | None = None) -> DataFrame:
    """Several result sets as one, each sentence with its highest score."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return top(dedup_max(out), limit)


def summary(hits: DataFrame) -> DataFrame:
    """One row: total_hits, max_score."""
    return hits.agg(F.count("*").alias("total_hits"), F.max("score").alias("max_score"))


def match_rows(hits: DataFrame) -> DataFrame:
    """One row a match: keys, start, end, captures."""
    return hits.select("doc_id", "sentence_id", "sentence_idx", F.inline("matches"))


def capture_rows(hits: DataFrame) -> DataFrame:
    """One row a capture: keys, match start, name, start, end."""
    rows = match_rows(hits).select("doc_id", "sentence_id", "sentence_idx", F.col("start").alias("match_start"), F.explode("captures").alias("c"))
    return rows.select("doc_id", "sentence_id", "sentence_idx", "match_start", F.col("c.name").alias("name"), F.col("c.start").alias("start"), F.col("c.end").alias("end"))


def as_map(hits: DataFrame, fields: list[str]) -> DataFrame:
    """Output fields as one map column ``fields``."""
    pairs = F.map_from_arrays(F.array(*[F.lit(f) for f in fields]), F.array(*[F.col(f) for f in fields]))
    return hits.withColumn("fields", pairs).drop(*fields)


def to_json(hits: DataFrame) -> DataFrame:
    return hits.select(F.to_json(F.struct("*")).alias("json"))


def write_json(hits: DataFrame, path: str) -> None:
    hits.write.json(path)


def response(engine, query: str, limit: int = 10) -> dict:
    """Query, duration, result count, highest score and results; a blank query is an error. The driver gets ``limit`` rows."""
    if not query.strip():
        raise ValueError("the query must not be blank")
    began = time.time()
    found = []
    for r in engine.query(query, limit).collect():
        matches = [{"span": [m["start"], m["end"]], "captures": [{"name": c["name"], "span": [c["start"], c["end"]]} for c in m["captures"]]} for m in r["matches"]]
        found.append({"document_id": r["doc_id"], "sentence_id": r["sentence_id"], "sentence_index": r["sentence_idx"], "score": r["score"], "matches": matches, "fields": {f: list(r[f]) for f in engine.output_fields if r[f] is not None}})
    return {"query": query, "duration": time.time() - began, "result_count": len(found), "max_score": max((x["score"] for x in found), default=None), "results": found}


def as_json(answer: dict, indent: int | None = None) -> str:
    return json.dumps(answer, ensure_ascii=False, indent=indent)


def _words(result: dict) -> str:
    return " ".join(result["fields"].get("word", []))


def minimal(answer: dict) -> str:
    lines = [f"{answer['result_count']} hits, best score {answer['max_score']}"]
    return "\n".join(lines + [f"{k}. {_words(r)} ({r['score']:.3f})" for k, r in enumerate(answer["results"], 1)])


def formatted(answer: dict) -> str:
    out = [f"{answer['result_count']} hits, best score {answer['max_score']}"]
    for k, r in enumerate(answer["results"], 1):
        out.append(f"{k}. document {r['document_id']}, sentence {r['sentence_id']}, score {r['score']:.6f}")
        out += [f"   {name}: {' '.join(values)}" for name, values in r["fields"].items()]
    return "\n".join(out)
