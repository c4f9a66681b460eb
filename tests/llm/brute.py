"""Plain versions of the operators on texts, without Spark and without names by hash."""

from __future__ import annotations

from collections import Counter, defaultdict


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().split()


def lower(text: str | None) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def shingles(text: str | None, width: int = 5) -> frozenset:
    w = words(lower(text))
    if not w:
        return frozenset()
    return frozenset([tuple(w)]) if len(w) < width else frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1))


def near_copies(rows: list[tuple]) -> list[tuple]:
    """(doc_id, n_shingles, component_id) of each row (doc_id, text)."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    posts = defaultdict(list)
    for i, s in enumerate(sets):
        for j, k in Counter(j for g in s for j in posts[g]).items():
            if 100 * k >= 80 * (len(s) + len(sets[j]) - k):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
        for g in s:
            posts[g].append(i)
    ids = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        ids[find(i)].append(d)
    least = {k: min((d for d in v if d is not None), default=None) for k, v in ids.items()}
    return [(d, len(sets[i]), least[find(i)] if sets[i] else d) for i, (d, _) in enumerate(rows)]


def without_repeats(rows: list[tuple], width: int = 20) -> dict[tuple, tuple]:
    """(words, removed words, kept text) of each (doc_id, text)."""
    seen, out = set(), {}
    for none, d, t in sorted({(d is not None, d or 0, t or "") for d, t in rows}):
        w = words(t)
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            window = tuple(w[i : i + width])
            if window in seen:
                gone[i : i + width] = [True] * width
            seen.add(window)
        out[d if none else None, t] = (len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode())
    return out


def measures(text: str | None) -> dict[str, int]:
    """The fixed measures of the quality rules."""
    text = text or ""
    w = words(text)
    windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    again = set()
    for i in range(len(w) - 4):
        if windows[tuple(w[i : i + 5])] > 1:
            again.update(range(i, i + 5))
    lines = [line for line in text.split("\n") if words(line)]
    return {
        "n_words": len(w),
        "word_chars": sum(len(x.decode()) for x in w),
        "n_symbols": sum(c in "#*$%&|<>" for c in text),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(again),
    }
