"""A map of a corpus as a text of bounded length."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillgraph.corpus import Corpus, checked_limit
from quillgraph.operators.graph import DIRS, HOTSPOTS, directories, hotspots, hubs


def map_card(corpus: Corpus, title: str, most_chars: int = 4_000, stale: int | None = 0, diagnostics: int = 0, most_dirs: int = DIRS) -> str:
    """Counts, the busiest folders each with its hubs, and the hotspots of all, in ``most_chars`` characters at most.

    Where that is too few, hotspots go first, the last one first, then their heading, hubs and folders; a last line
    says how many went. ``stale``: files that have changed since (None: unknown)."""
    checked_limit(most_chars, "most_chars")
    if not most_chars:
        return ""
    counts = [corpus.files.count(), corpus.unique_symbols().count(), corpus.edges.count()]
    places = directories(corpus, most_dirs).collect()
    inside: dict[str, list] = {}
    wanted = [p["dir"] for p in places]
    lines = corpus.unique_symbols().select("qualified_name", "file", F.col("start_line").alias("line"))
    for h in hubs(corpus).filter(F.col("dir").isin(*wanted)).join(lines, "qualified_name").orderBy("dir", "rank").collect() if wanted else []:
        inside.setdefault(h["dir"], []).append(h)
    hot = hotspots(corpus).collect()
    connected = corpus.degree().join(corpus.unique_symbols().select("qualified_name"), "qualified_name", "left_semi").filter("in_edges + out_edges > 0").count()

    state = "unavailable" if stale is None else "fresh" if stale == 0 else f"stale: {stale} file{'s' * (stale != 1)}"
    known = f" | partial, {diagnostics} diagnostics" if diagnostics else ""
    # (what goes at which turn, text)
    card: list[tuple[str, str]] = [("head", f"{title} | files {counts[0]} | symbols {counts[1]} | edges {counts[2]} | {state}{known}")]
    for p in places:
        card.append(("cluster", f"{p['dir']} ({p['file_count']} files, {p['symbol_count']} symbols, {p['internal_edges']} int / {p['external_edges']} ext edges)"))
        card += [("hub", f"  hub {h['qualified_name']} (in {h['in_edges']}, out {h['out_edges']}) {h['file']}:{h['line']}") for h in inside.get(p["dir"], [])]
    if hot:
        card.append(("heading", "hotspots:"))
        card += [("hotspot", f"  {h['qualified_name']} (in {h['in_edges']} from {h['in_files']} files, out {h['out_edges']}) {h['file']}:{h['line']}") for h in hot]
    gone = {"cluster": places[0]["dropped_dirs"] if places else 0, "hub": sum(h[0]["dropped_hubs"] for h in inside.values()), "hotspot": max(0, connected - HOTSPOTS)}
    turns = [k for kind in ("hotspot", "heading", "hub", "cluster") for k in reversed(range(len(card))) if card[k][0] == kind]

    def text(dropped: int) -> str:
        without = set(turns[:dropped])
        more = {kind: gone[kind] + sum(card[k][0] in ((kind, "heading") if kind == "hotspot" else (kind,)) for k in without) for kind in gone}
        told = ", ".join(f"{n} {kind} lines" for kind, n in more.items() if n)
        return "\n".join([t for k, (_, t) in enumerate(card) if k not in without] + ([f"dropped: {told}"] if told else []))

    fits = next((t for n in range(len(turns) + 1) if len(t := text(n)) <= most_chars), None)
    return fits if fits is not None else text(len(turns))[: most_chars - 1] + "…"
