"""Sets of transaction ids (``uuid:1-5:7,uuid:...``) and their repair."""

from __future__ import annotations


def parse(text: str) -> dict[str, list[tuple[int, int]]]:
    """UUID in lower case to its intervals, sorted and joined; ends are inclusive."""
    found: dict[str, list[tuple[int, int]]] = {}
    for part in filter(None, (p.strip() for p in (text or "").replace("\n", "").split(","))):
        uuid, *spans = part.split(":")
        for span in spans:
            lo, _, hi = span.partition("-")
            found.setdefault(uuid.strip().lower(), []).append((int(lo), int(hi or lo)))
    return {u: _joined(s) for u, s in found.items()}


def _joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def text(sets: dict[str, list[tuple[int, int]]]) -> str:
    return ",".join(f"{u}:" + ":".join(str(lo) if lo == hi else f"{lo}-{hi}" for lo, hi in spans) for u, spans in sorted(sets.items()))


def repaired(stored: str, server: str, server_uuid: str) -> str:
    """A stored position for a server whose log no longer reaches back to it:
    servers it doesn't know are dropped; if it knows further ones, theirs are
    taken as done, but for its own, whose log is read from the start."""
    mine, theirs = parse(stored), parse(server)
    kept = {u: s for u, s in mine.items() if u in theirs}
    if len(kept) != len(theirs):
        kept |= {u: s for u, s in theirs.items() if u not in kept and u != server_uuid.lower()}
    return text(kept)
