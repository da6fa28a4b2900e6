"""Plain Python versions of the operators, for small fixtures."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from fractions import Fraction

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BLANKS = " \t\n\x0b\x0c\r"
_LOWER = {ord("A") + i: ord("a") + i for i in range(26)}


def lower(text: str) -> str:
    return text.translate(_LOWER)


def word_shingles(text: str | None, width: int = 5) -> frozenset:
    w = WORD.findall(lower(text or ""))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1)))


def char_shingles(line: str, width: int = 5) -> frozenset:
    s = lower(line).strip(BLANKS)
    return frozenset(s[i : i + width] for i in range(max(1, len(s) - width + 1)))


def links(sets: list[frozenset], num: int = 3, den: int = 4) -> list[tuple[int, int]]:
    out = []
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and min(len(a), len(b)) * den >= max(len(a), len(b)) * num:
                both = len(a & b)
                if both * den >= num * (len(a) + len(b) - both):
                    out.append((j, i))
    return out


def roots(n: int, pairs: list[tuple[int, int]]) -> list[int]:
    parent = list(range(n))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def components(keys: list, sets: list[frozenset]) -> list:
    """The smallest key reachable from each element."""
    root = roots(len(keys), links(sets))
    least: dict[int, object] = {}
    for k, r in zip(keys, root):
        least[r] = min(least.get(r, k), k)
    return [least[r] for r in root]


def base_counts(text: str | None) -> dict[str, int]:
    text = text or ""
    w = WORD.findall(text)
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)), "n_dup_lines": dup, "n_repeat_words": len(covered)}


def normal_line(line: str) -> str:
    return re.sub("[0-9]", "0", " ".join(WORD.findall(lower(line))))


def quality(rows: list[tuple], min_docs: int, share: float, max_lost: float) -> list[dict]:
    """Verdict of each (doc_id, text, host)."""
    texts: dict[object, set] = defaultdict(set)
    held: dict[tuple, set] = defaultdict(set)
    for _, text, host in rows:
        texts[host].add(text or "")
        for line in (text or "").split("\n"):
            if WORD.search(line):
                held[host, normal_line(line)].add(text or "")
    out = []
    for key, text, host in rows:
        c = base_counts(text)
        lost_lines, lost = [], 0
        for i, line in enumerate((text or "").split("\n")):
            n = len(held.get((host, normal_line(line)), ()))
            if n > min_docs and n > share * len(texts[host]):
                lost_lines.append(i)
                lost += len(WORD.findall(line))
        failed = c["n_words"] < 50 or 100 * c["n_repeat_words"] > 50 * c["n_words"]
        out.append(c | {"doc_id": key, "base_failed": failed, "lost_words": lost, "lost_lines": lost_lines, "kept": not failed and lost <= max_lost * c["n_words"]})
    return out


def targets(sizes: dict, weights=(5, 2, 1), cap: int = 3) -> dict:
    """Target of each source by sharing the excess again and again, in exact arithmetic."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: Fraction(weights[i % len(weights)]) for i, s in enumerate(names)}
    total, out = Fraction(sum(sizes.values())), {}
    free = [s for s in names]
    while free:
        left = total - sum(out.values())
        level = left / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] > cap * sizes[s]]
        if not over:
            out |= {s: level * weight[s] for s in free}
            break
        out |= {s: Fraction(cap * sizes[s]) for s in over}
        free = [s for s in free if s not in over]
    return out


def sentences(text: str) -> list[tuple[int, int, str]]:
    """(start, end, words joined) of each sentence of at least 8 words."""
    out, at = [], 0
    cuts = [m.end() for m in re.finditer(r"\n|(?<=[.!?])[\x20\x09-\x0D]", text)] + [len(text) + 1]
    for cut in cuts:
        part = text[at : cut - 1]
        found = list(WORD.finditer(part))
        if len(found) >= 8:
            out.append((at + found[0].start(), at + found[-1].end(), " ".join(lower(m[0]) for m in found)))
        at = cut
    return out
