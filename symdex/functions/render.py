"""Results as text: Markdown for search hits, lists and status, and a progress line."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

SOURCE, DOC = 500, 80


def _place(r: Mapping) -> str:
    return f"(L{r['line_start']}-{r['line_end']})"


def _score(value: float | None) -> str:
    return f"{value:g}" if value is not None else "0"


def hits(rows: Sequence[Mapping]) -> str:
    if not rows:
        return "Nothing found. Try other words, or refresh the index first."
    return "\n---\n".join(f"**{r['symbol_type']}** `{r['symbol_name']}` in `{r['file_path']}` {_place(r)} [relevance={_score(r['score'])}]\n```python\n{r['source_code'][:SOURCE]}\n```\n" for r in rows)


def symbols(name: str, rows: Sequence[Mapping]) -> str:
    if not rows:
        return f"No symbol has '{name}' in its name."
    return "\n".join(f"**{r['symbol_type']}** `{r['symbol_name']}` in `{r['file_path']}` {_place(r)}" + (f" route={r['route_path']}" if r["route_path"] else "") + (f" class={r['parent_class']}" if r["parent_class"] else "") for r in rows)


def overview(path: str, rows: Sequence[Mapping]) -> str:
    if not rows:
        return f"'{path}' has no symbols. Its path must be relative to the project's root."
    out = [f"**File: {path}**\n"]
    for r in rows:
        line = f"{'  ' if r['parent_class'] else ''}- **{r['symbol_type']}** `{r['symbol_name']}` {_place(r)}"
        line += f" route={r['route_path']}" if r["route_path"] else ""
        out.append(line + (f" — {r['docstring'][:DOC]}".replace("\n", " ") if r["docstring"] else ""))
    return "\n".join(out)


def status(s: Mapping) -> str:
    if not s["indexed"]:
        return f"Project: {s['project_root']}\n{s['message']}"
    head = [
        f"Project: {s['project_root']}",
        f"Index is active: {s['total_chunks']} chunks across {s['total_files']} files",
        f"Tracked: {s['tracked_files']} files ({s['skipped_files']} skipped as non-indexable)",
        f"Build time: {s.get('build_time_seconds') or '?'}s",
        "Symbol types:",
    ]
    return "\n".join([*head, *(f"  - {k}: {n}" for k, n in sorted(s["by_type"].items()))])


def bar(current: int, total: int, width: int = 30) -> str:
    """A progress bar; question marks where the total isn't known."""
    if total <= 0:
        return f"[{'?' * width}]"
    part = min(current / total, 1.0)
    full = int(width * part)
    return f"[{'#' * full}{'-' * (width - full)}] {int(part * 100):3d}%"


def remaining(elapsed: float, current: int, total: int) -> str:
    """The time that is left at the pace so far."""
    if current <= 0 or total <= 0 or elapsed < 1:
        return ""
    left = elapsed / current * max(0, total - current)
    return "almost done" if left < 5 else f"about {round(left)} s left" if left < 60 else f"about {round(left / 60)} min left" if left < 3600 else f"about {left / 3600:.1f} h left"
