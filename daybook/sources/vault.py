"""A folder of markdown notes as tables: scan, parse, rebuild, sync, snapshot diff, legacy import."""

from __future__ import annotations

import json
import os
import time
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import block_hash, fold, trim
from ..operators.tables import SCHEMAS, Diary
from . import notes, writers
from .storage import materialise

KINDS = {"journal": "journal", "entities": "entity", "insights": "insight"}
#: Version of the tables' layout; an index of another one is built anew.
INDEX_VERSION = 2
#: Tables of journal files lie in partitions by month, so that a changed note rewrites its month only.
MONTHLY = ["entries", "links", "relations", "tags", "daily_meta", "superseded"]
_SCANNED = "path string, mtime bigint, kind string, content binary"
_ENTRY = "time string, ordinal int, mood string, intensity int, superseded string, text string, links array<string>, tags array<string>, relations map<string,array<string>>"
PARSED = f"path string, kind string, name string, entries array<struct<{_ENTRY.replace(' ', ':').replace(',:', ',')}>>, type string, aliases array<string>, sleep_hours double, exercise string, mood_score double, extra map<string,string>, warning string"
_STRINGS, _S = pa.list_(pa.string()), pa.string()
_ARROW_ENTRY = pa.struct({"time": _S, "ordinal": pa.int32(), "mood": _S, "intensity": pa.int32(), "superseded": _S, "text": _S, "links": _STRINGS, "tags": _STRINGS, "relations": pa.map_(_S, _STRINGS)})
#: PARSED as Arrow's types: nested columns are made by Arrow, not value by value.
_ARROW = pa.schema({"path": _S, "kind": _S, "name": _S, "entries": pa.list_(_ARROW_ENTRY), "type": _S, "aliases": _STRINGS, "sleep_hours": pa.float64(), "exercise": _S, "mood_score": pa.float64(), "extra": pa.map_(_S, _S), "warning": _S})


def _local(vault: str) -> str:
    return vault.removeprefix("file://").rstrip("/")


def scan(spark: SparkSession, vault: str, only: str | None = None) -> DataFrame:
    """path (relative), mtime (ms), kind, content of the notes (or of the one at path only); files elsewhere
    and those in or with a dot-name are left out. Spark's listing passes over names with an underscore in
    front, so these are listed here, in a vault of local files, and read by tasks."""
    root = _local(vault)
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", only is None).option("pathGlobFilter", "*.md").load(vault if only is None else f"{vault.rstrip('/')}/{only}")
    rel = F.expr(f"substring(path, instr(path, {json.dumps(root.rsplit('/', 1)[-1] + '/')}) + {len(root.rsplit('/', 1)[-1]) + 1})") if "://" in root else F.substring("path", F.instr("path", root + "/") + len(root) + 1, F.lit(1 << 20))
    rows = raw.select(rel.alias("path"), F.unix_millis("modificationTime").alias("mtime"), "content")
    hidden = [] if "://" in root else [os.path.join(d, f) for d, _, fs in os.walk(root) for f in fs if f.endswith(".md") and "/_" in os.path.join(d, f)[len(root) :]]
    if only is not None:
        hidden = [p for p in hidden if p == os.path.join(root, only)]
    if hidden:

        def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                yield pd.DataFrame([(p[len(root) + 1 :], os.stat(p).st_mtime_ns // 1_000_000, open(p, "rb").read()) for p in pdf["p"]], columns=["path", "mtime", "content"])

        rows = rows.unionByName(spark.createDataFrame([(p,) for p in hidden], "p string").mapInPandas(read, "path string, mtime bigint, content binary"))
    kind = F.create_map(*(F.lit(x) for kv in KINDS.items() for x in kv))[F.substring_index("path", "/", 1)]
    rows = rows.withColumn("kind", kind).where(F.col("kind").isNotNull() & ~F.col("path").rlike(r"(^|/)\."))
    return rows.select("path", "mtime", "kind", "content")


def file_of(spark: SparkSession, vault: str, rel: str) -> DataFrame:
    """The one note at a relative path: its row of scan, or none if there is no such note."""
    rel = rel.replace("\\", "/")
    if rel.split("/", 1)[0] not in KINDS or not rel.endswith(".md") or not os.path.isfile(os.path.join(_local(vault), rel)):
        return spark.createDataFrame([], _SCANNED)
    return scan(spark, vault, rel)


#: Bytes of notes that a worker parses at a time; a longer note is parsed alone. Parsed, they take many times as much.
PARSE_BYTES = 1 << 20


def _portions(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows of batches in the same order, cut so that the content of each portion has PARSE_BYTES at most."""
    for pdf in batches:
        ahead, begin = 0, 0
        for i, content in enumerate(pdf["content"]):
            if ahead and ahead + len(content) > PARSE_BYTES:
                yield pdf.iloc[begin:i]
                ahead, begin = 0, i
            ahead += len(content)
        yield pdf.iloc[begin:]


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    known = {"sleep_hours", "exercise", "mood_score"}
    for pdf in _portions(batches):
        rows = []
        for path, kind, content in zip(pdf["path"], pdf["kind"], pdf["content"], strict=True):
            meta, body, warning = notes.split_frontmatter(bytes(content).decode("utf-8", "replace"))
            entries = notes.parse_entries(body) if kind == "journal" else []
            number = lambda k: float(meta[k]) if isinstance(meta.get(k), int | float) and not isinstance(meta.get(k), bool) else None  # noqa: B023, E731
            aliases = [notes.nfc(str(a)) for a in meta["aliases"]] if isinstance(meta.get("aliases"), list) else []
            extra = {str(k): str(v) for k, v in meta.items() if k not in known} if kind == "journal" else {}
            told = lambda k, otherwise: meta[k] if isinstance(meta.get(k), str) else otherwise  # noqa: B023, E731
            name = notes.nfc(path.rsplit("/", 1)[-1].removesuffix(".md"))
            rows.append((path, kind, name, entries, told("type", "unknown"), aliases, number("sleep_hours"), told("exercise", None), number("mood_score"), extra or None, warning))
        yield pd.DataFrame(rows, columns=["path", "kind", "name", "entries", "type", "aliases", "sleep_hours", "exercise", "mood_score", "extra", "warning"])


def _parse_arrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for pdf in _parse(batch.to_pandas() for batch in batches):
        for e in (e for entries in pdf["entries"] for e in entries):
            e["relations"] = list(e["relations"].items())
        pdf["extra"] = [x and list(x.items()) for x in pdf["extra"]]
        yield pa.RecordBatch.from_arrays([pa.array(pdf[f.name], f.type, from_pandas=True) for f in _ARROW], schema=_ARROW)


def tables(files: DataFrame) -> Diary:
    """The derived tables of scanned files; a pure function of their content.

    Of journal files with one date, the first by path is kept, of entity files with one name the last.
    Every journal file that is kept has its row of daily_meta. Files are parsed once: what they say is written, as all
    tables read it.
    """
    parsed = materialise(files.sparkSession, files.select("path", "kind", "content").mapInArrow(_parse_arrow, PARSED), "notes")
    journal = parsed.where("kind = 'journal'").withColumnRenamed("name", "date")
    first = F.row_number().over(Window.partitionBy("date").orderBy("path"))
    journal = journal.withColumn("nth", first).where("nth = 1")
    each = journal.select("path", "date", F.explode("entries").alias("e")).withColumn("id", F.format_string("%s#%d", "date", "e.ordinal"))
    entries = each.select("id", F.col("path").alias("file"), "date", "e.time", "e.ordinal", "e.mood", "e.intensity", F.col("e.text").alias("body"))
    links = each.select(F.col("id").alias("entry_id"), F.posexplode("e.links").alias("pos", "target")).withColumn("target_key", fold(F.col("target")))
    tags = each.select(F.col("id").alias("entry_id"), F.posexplode("e.tags").alias("pos", "tag")).withColumn("tag_key", fold(F.col("tag")))
    verbs = each.select(F.col("id").alias("entry_id"), F.explode("e.relations").alias("rel_type", "targets"))
    relations = verbs.select("entry_id", "rel_type", F.explode("targets").alias("target")).withColumn("target_key", fold(F.col("target")))
    superseded = each.where("e.superseded is not null").select(F.col("id").alias("entry_id"), F.col("e.superseded").alias("newer_id"))
    daily = journal.select(F.col("path").alias("file"), "date", "sleep_hours", "exercise", "mood_score", "extra")
    entity = parsed.where("kind = 'entity'").groupBy("name").agg(F.max_by(F.struct("path", "type", "aliases"), "path").alias("e"))
    entities = entity.select("name", fold(F.col("name")).alias("name_key"), F.col("e.path").alias("file"), "e.type", "e.aliases")
    return Diary(entries, links, relations, tags, entities, daily, superseded, files.select("path", "mtime", "kind"))


def read_vault(spark: SparkSession, vault: str) -> Diary:
    return tables(scan(spark, vault))


def skipped_files(files: DataFrame) -> DataFrame:
    """(path, date) of journal files whose date an earlier file has."""
    journal = files.where("kind = 'journal'").withColumn("date", F.regexp_extract("path", r"([^/]+)\.md$", 1))
    return journal.withColumn("nth", F.row_number().over(Window.partitionBy("date").orderBy("path"))).where("nth > 1").select("path", "date")


def _month(name: str):
    return F.substring("date" if name == "daily_meta" else "id" if name == "entries" else "entry_id", 1, 7)


def _write(diary: Diary, name: str, index: str, months_only: bool) -> None:
    rows = getattr(diary, name)
    if name in MONTHLY:
        mode = "dynamic" if months_only else "static"
        rows = rows.withColumn("month", _month(name)).repartition("month")
        rows.write.mode("overwrite").option("partitionOverwriteMode", mode).partitionBy("month").parquet(f"{index}/{name}")
    else:
        rows.write.mode("overwrite").parquet(f"{index}/{name}")


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def rebuild(spark: SparkSession, vault: str, index: str) -> dict:
    """Write all tables to index anew. Returns row counts, the files that were skipped, and milliseconds."""
    began, files = time.time(), scan(spark, vault)
    diary = tables(files)
    for name in SCHEMAS:
        _write(diary, name, index, months_only=False)
    spark.createDataFrame([(INDEX_VERSION,)], "version int").write.mode("overwrite").json(f"{index}/version")
    own = open_index(spark, index)
    counts = {name: getattr(own, name).count() for name in SCHEMAS}
    return {**counts, "skipped": [r.path for r in skipped_files(own.files).orderBy("path").collect()], "ms": round(1000 * (time.time() - began))}


def index_version(spark: SparkSession, index: str) -> int | None:
    """The version that an index was written with; none where there is no whole index."""
    from pyspark.errors import AnalysisException

    try:
        found = spark.read.schema("version int").json(f"{index}/version").first()
    except AnalysisException:
        return None
    return found and found.version


def open_index(spark: SparkSession, index: str) -> Diary:
    read = lambda name, schema: spark.read.schema(schema + (", month string" if name in MONTHLY else "")).parquet(f"{index}/{name}").drop("month")
    return Diary(**{name: read(name, schema) for name, schema in SCHEMAS.items()})


def current_index(spark: SparkSession, vault: str, index: str) -> Diary:
    """The tables of the vault as it is now: an index of another version is built anew, any other synced."""
    if index_version(spark, index) == INDEX_VERSION:
        sync(spark, vault, index)
    else:
        rebuild(spark, vault, index)
    return open_index(spark, index)


def snapshot_diff(stored: DataFrame, listed: DataFrame) -> DataFrame:
    """(path, change): 'added', 'changed' (another mtime, older ones too), 'removed' or 'same'."""
    a = stored.select("path", F.col("mtime").alias("was"))
    b = listed.select("path", F.col("mtime").alias("now"))
    change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("was") != F.col("now"), "changed").otherwise("same")
    return a.join(b, "path", "full_outer").select("path", change.alias("change"))


def sync(spark: SparkSession, vault: str, index: str) -> dict:
    """Bring the index up to date: added, changed, removed, scanned, skipped.

    Months with a touched journal file are derived anew from all of their files, so that of two files of
    one date the right one counts, before and after either comes or goes; other months are not read. The
    list of files is written last: what a crash leaves undone, the next sync does.
    """
    old, listed = open_index(spark, index), scan(spark, vault)
    diff = [(r.path, r.change) for r in snapshot_diff(old.files, listed).where("change <> 'same'").collect()]
    month = lambda path: path.rsplit("/", 1)[-1].removesuffix(".md")[:7]
    months = sorted({month(p) for p, _ in diff if p.startswith("journal/")})
    if months:
        own = F.substring(F.regexp_extract("path", r"([^/]+)\.md$", 1), 1, 7)
        fresh = tables(listed.where((F.col("kind") == "journal") & own.isin(months)))
        for name in MONTHLY:
            left = {r[0] for r in getattr(fresh, name).select(_month(name)).distinct().collect()}
            _write(fresh, name, index, months_only=True)
            for m in set(months) - left:
                _delete(spark, f"{index}/{name}/month={m}")
    if any(p.startswith("entities/") for p, _ in diff):
        _write(tables(listed.where("kind = 'entity'")), "entities", index, months_only=False)
    now = [tuple(r) for r in listed.select("path", "mtime", "kind").collect()] if diff else None
    if now is not None:
        spark.createDataFrame(now, SCHEMAS["files"]).write.mode("overwrite").parquet(f"{index}/files")
    changes = [c for _, c in diff]
    own = open_index(spark, index).files
    return {**{k: changes.count(k) for k in ("added", "changed", "removed")}, "scanned": own.count(), "skipped": [r.path for r in skipped_files(own).orderBy("path").collect()]}


def entries_of_entity(links: DataFrame, entity: str) -> DataFrame:
    """(id): entries that link the entity, each once; both names are folded."""
    return links.where(F.col("target_key") == fold(F.lit(entity))).select(F.col("entry_id").alias("id")).distinct()


def forget_entity(spark: SparkSession, vault: str, entity: str, redact: bool = False, dry_run: bool = False) -> int:
    """Forget all entries of the vault's files that link the entity; returns how many. A dry run only counts."""
    ids = [r.id for r in entries_of_entity(read_vault(spark, vault).links, entity).collect()]
    return writers.forget(vault, ids, redact, dry_run)


def legacy_blocks(files: DataFrame) -> DataFrame:
    """(path, pos, bad, date, time, mood, tags, text, hash) of the blocks of legacy exports (path, content).

    A block is a header of fields between lines of three dashes, and the text up to the next header. bad
    blocks have no text, or none of the fields that tell a time or mood; undated ones have a null date.
    """
    lines = F.regexp_replace(F.regexp_replace(F.make_valid_utf8(F.col("content").cast("string")), "\r\n", "\n"), r"^#[^\n]*\n", "")
    split = F.split(lines, r"(?:^|\n)---\n(?=(?:time|mood|event_time|tags):)")
    each = files.select("path", F.posexplode(F.slice(split, F.lit(2), F.greatest(F.size(split), F.lit(1)))).alias("pos", "block"))
    whole = each.withColumns({"head": F.substring_index("block", "\n---\n", 1), "closed": F.instr("block", "\n---\n") > 0})
    text = F.regexp_replace(F.expr("substring(block, length(head) + 6)"), r"(?U)\s+$", "")

    def field(name: str):
        value = F.regexp_extract("head", rf'(?m)^\s*{name}:\s*"?([^"\n]*?)"?\s*$', 1)
        return F.when(value != "", value)

    told = whole.select("path", "pos", "closed", text.alias("text"), field("time").alias("at"), field("mood").alias("mood"), field("event_time").alias("event"), F.regexp_extract("head", r"(?m)^\s*tags:\s*\[(.*)\]\s*$", 1).alias("listed"))
    day = lambda c: F.when(F.substring(c, 1, 10).rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.substring(c, 1, 10))
    when = F.coalesce(day(F.col("event")), day(F.col("at")))
    clock = F.regexp_extract(F.coalesce("at", F.lit("")), r"T([0-9]{2}:[0-9]{2})", 1)
    tags = F.filter(F.transform(F.split("listed", ","), lambda t: trim(F.regexp_replace(trim(t), r"^['\"]|['\"]$", ""))), lambda t: t != "")
    bad = ~F.col("closed") | (trim(F.col("text")) == "") | F.coalesce("at", "mood", "event").isNull()
    return told.select(
        "path", "pos", bad.alias("bad"), when.alias("date"), F.when(when.isNotNull(), F.when(clock != "", clock).otherwise("00:00")).alias("time"), "mood", tags.alias("tags"), "text", block_hash(F.col("text")).alias("hash"),
    )


def import_status(blocks: DataFrame, log: DataFrame) -> DataFrame:
    """Blocks with their status: 'undated', 'known' (hash in the log), 'duplicate' (not the first of its hash) or 'new'."""
    first = F.row_number().over(Window.partitionBy("hash", F.col("date").isNull()).orderBy("path", "pos"))
    seen = blocks.join(log.select("hash", F.lit(True).alias("logged")).distinct(), "hash", "left").withColumn("nth", first)
    status = F.when(F.col("date").isNull(), "undated").when(F.col("logged"), "known").when(F.col("nth") > 1, "duplicate").otherwise("new")
    return seen.withColumn("status", status).drop("nth", "logged")


def import_folder(spark: SparkSession, source: str, vault: str, dry_run: bool = False) -> dict:
    """Append the new blocks of a folder of legacy exports (all below it) to the vault's notes, in order of
    file and place, each with a line of its tags ahead of its text. What was imported is in the vault's log,
    by the hash of the text as it was; a dry run writes nothing."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").load(source).select("path", "content")
    blocks = legacy_blocks(files)
    known = writers.read_import_log(_local(vault))
    log = spark.createDataFrame([(h,) for h in sorted(known)], "hash string")
    # A bad block is no block of the count; an undated one is, and is bad too.
    marked = import_status(blocks.where("not bad"), log)
    counts = {r.status: r.n for r in marked.groupBy("status").agg(F.count("*").alias("n")).collect()}
    created, failed, file = 0, 0, None
    for r in marked.where("status = 'new'").orderBy("path", "pos").toLocalIterator():
        if file not in (None, r.path) and not dry_run:
            writers.write_import_log(_local(vault), known)  # after each file; within one, no section is added twice
        file = r.path
        try:
            if not dry_run:
                writers.append_once(_local(vault), r.date, r.time, writers.with_tags(r.text, r.tags), r.mood)
            known.add(r.hash)
            created += 1
        except (OSError, ValueError):
            failed += 1
    if not dry_run:
        writers.write_import_log(_local(vault), known)
    return {
        "dry_run": dry_run, "files": files.count(), "blocks": sum(counts.values()), "entries_created": created,
        "skipped_duplicate": counts.get("known", 0) + counts.get("duplicate", 0), "skipped_bad": blocks.where("bad").count() + counts.get("undated", 0) + failed,
    }
