"""Shard lists: manifests and brace patterns.  Driver-side, as lists of paths always are."""

from __future__ import annotations

import json
import os
import re

from voxloom.sources.tar import open_shard


def expand_braces(pattern: str) -> list[str]:
    """``a-{000..002}.tar`` and ``{x,y}`` expanded, from left to right; numbers keep their width."""
    match = re.search(r"\{([^{}]*)\}", pattern)
    if not match:
        return [pattern]
    span = re.fullmatch(r"(\d+)\.\.(\d+)", match[1])
    if span:
        low, high = int(span[1]), int(span[2])
        step = 1 if high >= low else -1
        parts = [str(i).zfill(len(span[1])) for i in range(low, high + step, step)]
    elif "," in match[1]:
        parts = match[1].split(",")
    else:
        return [pattern[: match.end()] + rest for rest in expand_braces(pattern[match.end() :])]
    return [pattern[: match.start()] + part + rest for part in parts for rest in expand_braces(pattern[match.end() :])]


def expand_all(patterns: list[str]) -> list[str]:
    """All patterns expanded; a shard named twice is an error."""
    shards = [s for p in patterns for s in expand_braces(p)]
    twice = sorted({s for s in shards if shards.count(s) > 1}) if len(set(shards)) < len(shards) else []
    if twice:
        raise ValueError(f"shards named twice: {', '.join(twice[:3])}")
    return shards


def load_manifest(path: str) -> list[dict[str, str]]:
    """``[{url, path}]`` of the enabled shards of a .json list, ``{"shards": [...]}``, .jsonl or text manifest.

    Relative paths are taken from the manifest's folder; remote urls stay.  Empty manifests and repeated urls are errors.
    """
    with open_shard(path) as file:
        content = file.read().decode("utf-8")
    if path.endswith(".jsonl"):
        entries = [json.loads(line) for line in content.splitlines() if line.strip()]
    elif path.endswith(".json"):
        loaded = json.loads(content)
        entries = loaded["shards"] if isinstance(loaded, dict) else loaded
    else:
        entries = [line.split("#", 1)[0].strip() for line in content.splitlines()]
        entries = [line for line in entries if line]
    base, out = os.path.dirname(path) if ":" in path else os.path.dirname(os.path.abspath(path)), []
    for entry in entries:
        entry = {"url": entry} if isinstance(entry, str) else entry
        if entry.get("disabled"):
            continue
        url = entry.get("url") or entry.get("path")
        if not url:
            raise ValueError(f"{path}: an entry names no shard")
        place = entry.get("path") or url
        out.append({"url": url, "path": place if "://" in place or os.path.isabs(place) else os.path.join(base, place)})
    if not out:
        raise ValueError(f"{path}: no enabled shard")
    expand_all([o["url"] for o in out])
    return out
