"""Changes to the notes themselves, which are files: append, check-in, stubs, forget, merge, report, envelope."""

from __future__ import annotations

import json
import os
import re
from datetime import date
from pathlib import Path

import yaml

from ..functions.dates import infer_event_date, is_iso_date
from ..functions.text import fold_text
from . import notes

VERSION = 1


def safe_name(name: str) -> str:
    clean = re.sub(r"\s+", " ", re.sub(r'[\\/:*?"<>|\x00-\x1f#^\[\]]', " ", name)).strip()
    return "untitled" if not clean or re.fullmatch(r"\.+", clean) else clean


def note_path(vault: str, kind: str, name: str) -> Path:
    """journal by date, entities and insights by name; never outside the vault."""
    if kind == "journal":
        if not is_iso_date(name):
            raise ValueError(f"Invalid date (expected YYYY-MM-DD): {name}")
        path = Path(vault, "journal", name[:4], name[5:7], f"{name}.md")
    else:
        path = Path(vault, kind, f"{safe_name(name)}.md")
    if Path(vault).resolve() not in path.resolve().parents:
        raise ValueError(f"Path escapes vault: {path}")
    return path


def write_file(path: Path, text: str) -> None:
    path.parent.mkdir(parents=True, exist_ok=True)
    part = path.with_name(path.name + ".part")
    part.write_text(text, encoding="utf-8", newline="")
    os.replace(part, path)


def read_file(path: Path) -> str:
    return path.read_bytes().decode("utf-8") if path.exists() else ""


def init_vault(vault: str) -> None:
    for d in ("journal", "entities", "insights"):
        Path(vault, d).mkdir(parents=True, exist_ok=True)
    marker = Path(vault, "vault-version.json")
    if not marker.exists():
        write_file(marker, json.dumps({"version": VERSION}))


def vault_state(vault: str) -> str:
    try:
        version = json.loads(read_file(Path(vault, "vault-version.json")))["version"]
    except (ValueError, KeyError, TypeError):
        return "unversioned"
    return "current" if version == VERSION else "vault_older" if version < VERSION else "vault_newer"


def entry_section(time: str, text: str, mood: str | None = None, tags: list[str] | None = None, relations: dict[str, list[str]] | None = None) -> str:
    """A section as it is written: the text stays but for blank lines ahead of it and white space at its end."""
    fields = [f"mood:: {mood.strip()}"] if mood and mood.strip() else []
    fields += [f"tags:: {', '.join(tags)}"] if tags else []
    fields += [f"{verb}:: {', '.join(f'[[{t}]]' for t in targets)}" for verb, targets in (relations or {}).items()]
    body = re.sub(r"^(?:[ \t]*\r?\n)+", "", text).rstrip()
    return f"\n## {time}\n" + "".join(f"{x}\n" for x in fields) + f"{body}\n"


def append_entry(vault: str, day: str, time: str, text: str, mood: str | None = None, tags: list[str] | None = None, relations: dict[str, list[str]] | None = None) -> str:
    """Add a section to the end of the day's note; returns its id. What the note has stays as it is, byte by byte."""
    path = note_path(vault, "journal", day)
    if not path.exists():
        write_file(path, f"# {day}\n")
    ended = path.read_bytes()[-1:] in (b"\n", b"")
    with open(path, "a", encoding="utf-8", newline="") as f:
        f.write(("" if ended else "\n") + entry_section(time, text, mood, tags, relations))
    return f"{day}#{len(notes.parse_entries(notes.split_frontmatter(read_file(path))[1])) - 1}"


def append_once(vault: str, day: str, time: str, text: str, mood: str | None = None) -> bool:
    """Add a section unless the day's note has the very same one; the note is replaced whole, so that a crash
    leaves it as it was or as it will be. Returns whether it was added."""
    path, section = note_path(vault, "journal", day), entry_section(time, text, mood)
    raw = read_file(path) or f"# {day}\n"
    raw += "" if raw.endswith("\n") else "\n"
    if raw.endswith(section) or section + "\n## " in raw:
        return False
    write_file(path, raw + section)
    return True


def with_tags(text: str, tags: list[str] | None) -> str:
    return (f"tags:: {', '.join(tags)}\n" if tags else "") + text


def read_import_log(vault: str) -> set[str]:
    """Hashes of imported blocks; a log that is missing or not as it should be counts as empty."""
    try:
        held = json.loads(read_file(Path(vault, ".index", "import-log.json")))
    except ValueError:
        return set()
    return set(held) if isinstance(held, dict) else set()


def write_import_log(vault: str, hashes: set[str]) -> None:
    write_file(Path(vault, ".index", "import-log.json"), json.dumps(dict.fromkeys(sorted(hashes), True)))


def update_frontmatter(path: Path, fields: dict) -> None:
    meta, body, _ = notes.split_frontmatter(read_file(path))
    write_file(path, f"---\n{yaml.safe_dump({**meta, **fields}, allow_unicode=True, sort_keys=False)}---\n{body}")


def check_in(vault: str, day: str, line: str) -> list[str]:
    fields, warnings = notes.parse_checkin(line)
    if fields:
        update_frontmatter(note_path(vault, "journal", day), fields)
    return warnings


def known_keys(vault: str) -> set[str]:
    keys = set()
    for p in Path(vault, "entities").glob("*.md"):
        aliases = notes.split_frontmatter(read_file(p))[0].get("aliases")
        keys |= {fold_text(p.stem), *(fold_text(str(a)) for a in (aliases if isinstance(aliases, list) else []))}
    return keys


def ensure_stubs(vault: str, names: list[str], today: date) -> list[str]:
    """Entity notes for names that no entity or alias has, spelling aside."""
    keys, made = known_keys(vault), []
    for name in names:
        if fold_text(name) not in keys:
            keys.add(fold_text(name))
            write_file(note_path(vault, "entities", name), f"---\ntype: unknown\naliases: []\ncreated: {today.isoformat()}\n---\n# {name}\n\n## Facts\n")
            made.append(name)
    return made


def remember(vault: str, text: str, today: date, time: str = "00:00", day: str | None = None, mood: str | None = None, tags: list[str] | None = None, relations: dict[str, list[str]] | None = None, checkin: str | None = None) -> dict:
    """Append an entry (its date told, or read from the text, or today) and stubs for what it links."""
    if mood and not notes.mood_of(mood):
        raise ValueError(f"Invalid mood: {mood}")
    told = None if day else infer_event_date(text, today)
    day = day or (told[0] if told else today.isoformat())
    warnings = check_in(vault, day, checkin) if checkin else []
    entry = append_entry(vault, day, time, text, mood, tags, relations)
    targets = [*notes.links_in(text), *(t for ts in (relations or {}).values() for t in ts)]
    return {"id": entry, "date": day, "date_inferred_from": told and told[1], "stubs": ensure_stubs(vault, targets, today), "warnings": warnings}


def forget(vault: str, ids: list[str], redact: bool = False, dry_run: bool = False) -> int:
    """Delete sections, or put a line with the date in place of their text; returns how many. Later sections
    of a day move up. A dry run changes nothing."""
    count = 0
    for day in sorted({i.split("#")[0] for i in ids}):
        path = note_path(vault, "journal", day)
        raw = read_file(path)
        body = notes.split_frontmatter(raw)[1]
        head, lines = raw[: len(raw) - len(body)], body.split("\n")
        found = notes.sections([x.rstrip("\r") for x in lines])
        for ordinal in sorted({int(i.split("#")[1]) for i in ids if i.startswith(day + "#")}, reverse=True):
            if ordinal >= len(found):
                continue
            _, at, end = found[ordinal]
            own = lines[at + 1 : end]
            keep = []
            if redact:
                zone = notes.field_zone(own, repeated=True)[1]
                blank = next((k for k in range(len(own), 0, -1) if own[k - 1].strip()), 0)
                keep = [lines[at], *own[:zone], f"[redacted {day}]", *own[max(blank, zone) :]]
            lines[at:end] = keep
            count += 1
        if not dry_run:
            write_file(path, head + "\n".join(lines))
    return count


def merge_entities(vault: str, source: str, into: str) -> int:
    """Links to source point to into; aliases and facts move over; returns links rewritten."""
    count = 0
    for top in ("journal", "entities", "insights"):
        for p in sorted(Path(vault, top).rglob("*.md")):
            text, n = notes.rewrite_links(read_file(p), source, into)
            if n:
                write_file(p, text)
                count += n
    old, new = note_path(vault, "entities", source), note_path(vault, "entities", into)
    if old.exists():
        a, facts, _ = notes.split_frontmatter(read_file(old))
        b, body, _ = notes.split_frontmatter(read_file(new))
        aliases = dict.fromkeys([*(b.get("aliases") or []), *(a.get("aliases") or []), source])
        facts = notes.strip_heading(facts)
        write_file(new, body.rstrip("\n") + (f"\n\n{facts}\n" if facts else "\n"))
        update_frontmatter(new, {**b, "aliases": [x for x in aliases if x != into]})
        old.unlink()
    return count


def envelope(data=None, error: str | None = None, hint: str | None = None) -> str:
    if error is None:
        return json.dumps({"ok": True, "data": data}, ensure_ascii=False)
    return json.dumps({"ok": False, "error": error, **({"hint": hint} if hint else {})}, ensure_ascii=False)


def render_report(sections: dict, start: str, end: str) -> str:
    """Markdown of a report's sections (name -> DataFrame), every row of those it lists. Its headings and phrases."""
    lines = [f"# Reflect — {start} → {end}", ""]
    rows = lambda name: sections[name].toLocalIterator()
    one = lambda name: sections[name].first()
    shown = lambda v: "—" if v is None else f"{v:g}"

    def listed(title: str, found: list[str], otherwise: str | None = None) -> None:
        if found or otherwise:
            lines.extend([f"## {title}", *(found or [otherwise]), ""])

    listed("Suggested actions", [f"- [ ] {r.action}" for r in sections["suggested_actions"].orderBy("priority", "action").toLocalIterator()], "- _Nothing pending — vault is tidy._")
    mood, health = one("mood_stats"), one("health_stats")
    spread = ", ".join(f"{r.mood}×{r.n}" for r in rows("mood_distribution")) or "—"
    listed("Mood", [f"- distribution: {spread}", f"- avg intensity: {shown(mood.avg_intensity)} (trend: {mood.trend})"])
    listed("Health", [f"- avg sleep: {shown(health.avg_sleep)}h", f"- exercise days: {health.exercise_days}", f"- mood-score trend: {health.mood_score_trend}"])
    listed("Insight candidates", [f"- **{r.kind}** — {r.detail}" for r in sections["insight_candidates"].orderBy("part", "detail").toLocalIterator()], "- _None detected this period._")
    counts = [("unknown-type entities", "unknown_type_entities"), ("orphan entities", "orphan_entities"), ("broken wikilinks", "broken_wikilinks"), ("entries without links", "entries_without_links"), ("entries without mood", "entries_without_mood"), ("days missing check-in", "days_without_checkin")]
    listed("Lint", [f"- {title}: {sections[name].count()}" for title, name in counts])
    listed("Possible aliases", [f"- [[{r.a}]] ≈ [[{r.b}]] ({r.similarity:g})" for r in rows("alias_candidates")])
    told = {"joy": [], "trigger": []}
    for r in sections["relation_summary"].orderBy("rel_type", "nth").toLocalIterator():
        told[r.rel_type].append(f"[[{r.target}]]×{r.n}")
    listed("Emotional relations", [f"- brings joy: {', '.join(told['joy']) or '—'}", f"- triggers: {', '.join(told['trigger']) or '—'}", f"- strong-mood entries missing a relation: {sections['missing_emotional_relation'].count()}"])
    listed("Tags to convert", [f"- [ ] `{r.tag}` (×{r.n}) → link or relation" for r in rows("tags_to_convert")])
    listed("Concept bridges", [f"- [ ] add `[[{r.concept}]]` to {r.entry_count} entries ({', '.join(r.evidence)})" for r in rows("concept_bridges")])
    listed("Superseded-fact candidates", [f"- [ ] mark `{r.older_id}` superseded by `{r.newer_id}`? ({r.type}: {r.old_entity} → {r.new_entity})" for r in rows("superseded_candidates")])
    listed("Entity type suggestions", [f"- [ ] set `[[{r.name}]]` type → `{r.suggested}` ({r.reason})" for r in rows("entity_type_suggestions")])
    return "\n".join(lines)
