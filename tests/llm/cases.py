"""Small tables with every hard case, and plain versions of the operators to hold them against."""

from __future__ import annotations

import re
import zlib
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")

TEXTS = [
    "The quick brown fox jumps over the lazy dog and runs far away from here.",
    "The quick  brown fox jumps over the lazy dog\nand runs far away from here.",
    "the quick brown fox jumps over the lazy dog and runs far away from there.",
    None,
    "",
    " \t\r\n\x0b\x0c ",
    "Thequickbrownfox",
    "Licensed CC BY, General Public License; ALL RIGHTS RESERVED. cc by cc by",
    "// SPDX-License-Identifier: (MIT OR GPL-2.0-only WITH Classpath-exception-2.0) AND Apache-2.0\ncode",
    "Ünïcode ÄÖÜ ß İstanbul ΣΑΣ 中文字符 한국어 😀 <|endoftext|> x's I'LL",
    "a",
    "word " * 3000,
    "Repeated passage that is rather long, so that it holds more than two hundred bytes in all: " * 4,
    "Before. " + "Repeated passage that is rather long, so that it holds more than two hundred bytes in all: " * 4 + "After.",
]
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, row long, size int, score string, hits string, ids string, KEPT string"


def rows() -> list[tuple]:
    """Texts under several ids and sources, a repeated row, a null id, and columns with clashing names."""
    out = []
    for i, text in enumerate(TEXTS * 2):
        out.append((i, text, ["en", None, "de"][i % 3], ["b", "a", None, "c"][i % 4], None if text is None else len(text), 7, 1, "s", "h", "x", "k"))
    return [*out, out[0], (None, TEXTS[0], "en", None, None, None, None, None, None, None, None)]


def low(text: str | None) -> str:
    """A-Z in lower case."""
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def remainder(doc_id: int | None, n: int) -> int:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % n


def dedup(table: list[tuple[int | None, str | None]]) -> dict[str, tuple[int | None, int]]:
    """Normal text to (id that stays, size of its class)."""
    groups: dict[str, list] = {}
    for i, text in table:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", text or ""), []).append((-len(text or ""), i is None, i))
    return {k: (min(v)[2] if len(v) == 1 else sorted(v, key=lambda x: (x[0], x[1], x[2] or 0))[0][2], len(v)) for k, v in groups.items()}


def repeated(texts: list[bytes], length: int) -> list[list[tuple[int, int]]]:
    """Maximal runs covered by strings that start at two places or more."""
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        runs: list[tuple[int, int]] = []
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                if runs and i <= runs[-1][1]:
                    runs[-1] = (runs[-1][0], i + length)
                else:
                    runs.append((i, i + length))
        out.append(runs)
    return out


def components(prints: list[int], radius: int) -> list[int]:
    """Number of the first member that each one reaches."""
    root = list(range(len(prints)))
    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return root


def targets(sizes: list[int], weights=(1, 2, 3), most: int = 3) -> list[float]:
    """Shares by weight; what is above a limit is shared again until nothing is."""
    total, w = sum(sizes), [weights[i % len(weights)] for i in range(len(sizes))]
    fixed: dict[int, float] = {}
    while True:
        free = [i for i in range(len(sizes)) if i not in fixed]
        left, mass = total - sum(fixed.values()), sum(w[i] for i in free)
        over = [i for i in free if left * w[i] / mass > most * sizes[i] + 1e-9]
        if not over:
            return [fixed.get(i, left * w[i] / mass if mass else 0.0) for i in range(len(sizes))]
        fixed |= {i: float(most * sizes[i]) for i in over}


def similar_groups(texts: list[bytes], width: int, least: float) -> list[int]:
    """Number of the first member that each text reaches over pairs of that Jaccard similarity of word shingles."""
    sets = []
    for t in texts:
        words = t.lower().split()
        sets.append({tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set())
    root = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            both = len(a & b)
            if both >= least * (len(a) + len(b) - both) and root[i] != root[j]:
                x, y = root[i], root[j]
                root = [min(x, y) if r in (x, y) else r for r in root]
    return root
