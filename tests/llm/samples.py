"""Small document tables with every awkward row, and brute-force versions of what the operators promise."""

from __future__ import annotations

import hashlib
import random
import re

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, id string, block int, row string, n_words string"
WORDS = [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "né") for b in ("ra", "su", "ti", "vø") for c in ("n", "p", "r", "s")]


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", ",", "."]) + rng.choice([" ", " ", "\n"])[1:] for _ in range(n))


def rows(seed: int = 1, n: int = 60) -> list[tuple]:
    """Texts with copies, near copies and shared passages, one very long one, and NULL, empty and blank ones; repeated
    rows, NULL ids, and extra columns with names that operators use."""
    rng = random.Random(seed)
    passage = prose(rng, 70)
    texts: list[str | None] = [prose(rng, rng.choice([1, 3, 12, 40, 150])) for _ in range(n)]
    for i in range(0, n, 6):
        texts[i] = prose(rng, 30) + " " + passage + " " + prose(rng, 25)
    for i in range(3, n, 9):
        texts[i] = texts[i // 2]
    for i in range(5, n, 10):
        words = (texts[i - 5] or "").split(" ")
        if len(words) > 60:
            words[rng.randrange(len(words))] = "changed"
        texts[i] = " ".join(words)
    texts[7], texts[8], texts[9] = None, "", " \n\t "
    texts[10] = prose(rng, 6000)
    texts[11] = "One common line here\n" + prose(rng, 9) + "\n ONE COMMON LINE HERE \nshort\n\n"
    texts[12] = "one common line here\nshort\n"
    texts[13] = "ha " * 400
    order = list(range(n))
    rng.shuffle(order)
    table = [(i * 3, texts[i], "en", f"src{i % 2}", len(texts[i] or ""), "x", i, None, "y") for i in order]
    return table + [table[0], table[1], (None, texts[0], None, None, None, None, None, None, None), (None, "lone one", *[None] * 7)]


def key(row: tuple) -> int:
    return 2**63 - 1 if row[0] is None else row[0]


def split(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def sha(text: str | bytes) -> str:
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def ordered(found) -> list[tuple]:  # noqa: ANN001
    return sorted((tuple(r) for r in found), key=repr)
