"""The derived tables that all operators work on."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

SCHEMAS = {
    "files": "path string, mtime bigint, kind string",
    "entries": "id string, file string, date string, time string, ordinal int, mood string, intensity int, body string",
    "links": "entry_id string, pos int, target string, target_key string",
    "relations": "entry_id string, rel_type string, target string, target_key string",
    "tags": "entry_id string, pos int, tag string, tag_key string",
    "entities": "name string, name_key string, file string, type string, aliases array<string>",
    "daily_meta": "file string, date string, sleep_hours double, exercise string, mood_score double, extra map<string,string>",
    "superseded": "entry_id string, newer_id string",
}


@dataclass(frozen=True)
class Diary:
    entries: DataFrame
    links: DataFrame
    relations: DataFrame
    tags: DataFrame
    entities: DataFrame
    daily_meta: DataFrame
    superseded: DataFrame
    files: DataFrame | None = None


@dataclass(frozen=True)
class Index:
    """A stored inverted index: postings, and one row of corpus statistics."""

    postings: DataFrame
    stats: DataFrame
