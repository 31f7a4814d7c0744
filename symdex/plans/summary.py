"""The project summary: facts from files and tracked paths, as Markdown."""

from __future__ import annotations

import os
from datetime import datetime
from pathlib import Path

from pyspark.sql import DataFrame

from symdex.functions import detect
from symdex.functions import names as N
from symdex.operators.stats import languages

NOTICE = "_No description: this engine writes facts only._"


def reader(root: str):
    def read(path: str) -> str | None:
        try:
            return (Path(root) / path).read_text("utf-8", "replace")
        except OSError:
            return None

    return read


def top_level(root: str) -> list[str]:
    """Names at the root in order, folders with a slash, without hidden and generated ones."""
    try:
        entries = sorted(os.scandir(root), key=lambda e: e.name)
    except OSError:
        return []
    return [e.name + "/" * e.is_dir() for e in entries if e.name not in N.HIDDEN_TOP_LEVEL and not e.name.startswith(".")]


def theme_folders(root: str) -> list[str]:
    found = []
    for base in ("", *N.SITE_FOLDERS[:2]):
        try:
            found += [e.name for e in os.scandir(Path(root) / base / "wp-content" / "themes") if e.is_dir()]
        except OSError:
            continue
    return found


def project_summary(root: str, tracking: DataFrame, now: datetime | None = None, custom: tuple[str, str] = ("", "")) -> str:
    """Markdown of what is known; `tracking` is aggregated to a few names and never collected."""
    read, exists = reader(root), lambda p: (Path(root) / p).exists()
    facts = detect.path_facts(tracking).first()
    marks = [f"wp-content/plugins/{p}/" for p in facts["plugins"]] + [f"wp-content/themes/{t}" for t in facts["themes"]] + ["wp-content/"] * facts["is_content"]
    if custom[1] and tracking.where(tracking.file_path.contains(custom[1])).limit(1).count():
        marks.append(custom[1])
    langs = [f"{r['language']} ({r['n']})" for r in languages(tracking).collect()]
    head = {"Domain": detect.domain(read), "Platform": detect.platform(marks, exists, custom)}
    web, url, php, db = detect.web_root(exists), detect.local_url(read), detect.php_version(read), detect.database(read)
    layers, theme = detect.cache_layers(marks), detect.themes(marks, theme_folders(root))
    environment = {"Web root": f"`{web}/`" if web else "", "Local dev": url, "PHP": php, "Database": f"`{db}`" if db else "", "Cache layers": ", ".join(layers), "Theme": f"`{theme}`" if theme else ""}
    out = [f"# {Path(root).name}", "", f"> Generated {(now or datetime.now()):%Y-%m-%d %H:%M}", ""]
    for name, value in head.items():
        out += [f"**{name}:** {value}", ""] * bool(value)
    known = [f"- **{k}:** {v}" for k, v in environment.items() if v]
    out += ["## Environment", *known, ""] * bool(known)
    return "\n".join([*out, "## Languages", ", ".join(langs) or "_not detected_", "", "## Structure", "```", *top_level(root)[:20], "```", "", NOTICE])
