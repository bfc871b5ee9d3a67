"""Plain versions of the text operators, for small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import xxhash

SPACE_WORDS = re.compile(r"[^\x20\x09-\x0D]+")
PLAIN_WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def sha(data) -> str:
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def ascii_lower(text: str) -> str:
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def base_rules(text):
    words = SPACE_WORDS.findall(text or "")
    n = len(words)
    counts = Counter(tuple(words[i:i + 8]) for i in range(n - 7))
    hit = {j for i in range(n - 7) if counts[tuple(words[i:i + 8])] > 1 for j in range(i, i + 8)}
    seen, again = set(), 0
    for line in (text or "").split("\n"):
        if SPACE_WORDS.search(line):
            again += line in seen
            seen.add(line)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), again, len(hit),
            n < 20 or 100 * len(hit) > 30 * n)


def fingerprint(text, size=3):
    words = SPACE_WORDS.findall(ascii_lower(text or ""))
    shingles = [" ".join(words[i:i + size]) for i in range(len(words) - size + 1)] or (
        [" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << bit for bit in range(64)
               if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def linked_groups(prints, radius=3):
    """The least position of each one's group."""
    group = list(range(len(prints)))

    def find(x):
        while group[x] != x:
            group[x] = group[group[x]]
            x = group[x]
        return x

    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= radius:
                x, y = find(i), find(j)
                group[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(prints))]


def runs(flags):
    return sum(flag and not (i and flags[i - 1]) for i, flag in enumerate(flags))


def word_repeats(texts, window):
    """texts in order; (words, removed, kept) of each."""
    first, out = {}, []
    for number, text in enumerate(texts):
        words = SPACE_WORDS.findall(text or "")
        gone = [False] * len(words)
        for i in range(len(words) - window + 1):
            key = tuple(words[i:i + window])
            if first.setdefault(key, number) < number:
                gone[i:i + window] = [True] * window
        out.append((len(words), sum(gone), " ".join(w for w, g in zip(words, gone, strict=True)
                                                    if not g)))
    return out


def byte_repeats(texts, window):
    """texts in order; (bytes, removed, runs removed, kept) of each."""
    seen, out = set(), []
    for text in texts:
        data = (text or "").encode()
        gone = [False] * len(data)
        for i in range(len(data) - window + 1):
            part = data[i:i + window]
            if part in seen:
                gone[i:i + window] = [True] * window
            seen.add(part)
        out.append((len(data), sum(gone), runs(gone),
                    bytes(b for b, g in zip(data, gone, strict=True) if not g)))
    return out


def benchmark_hits(text, items, size=10):
    """(words, words hit, ids of items found) for items (id, text)."""
    words = PLAIN_WORDS.findall(ascii_lower(text or ""))
    hit, found = set(), set()
    for item, own in items:
        own = PLAIN_WORDS.findall(ascii_lower(own or ""))
        for start in range(max(len(own) - size + 1, 1) if own else 0):
            window = own[start:start + size]
            for i in range(len(words) - len(window) + 1):
                if words[i:i + len(window)] == window:
                    hit.update(range(i, i + len(window)))
                    if item is not None:
                        found.add(str(item))
    return len(words), len(hit), sorted(found)


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    total = 0
    for place, digit in enumerate(reversed(digits)):
        n = int(digit) * (1 + place % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def personal(text):
    """Spans of emails, addresses, cards and phones, four lists."""
    text = text or ""

    def digits(match):
        return re.sub("[^0-9]", "", match.group())

    return [[m.span() for m in EMAIL.finditer(text)],
            [m.span() for m in IP.finditer(text)
             if all(int(part) <= 255 for part in m.group().split("."))],
            [m.span() for m in CARD.finditer(text)
             if 16 <= len(digits(m)) <= 19 and luhn(digits(m))],
            [m.span() for m in PHONE.finditer(text) if 8 <= len(digits(m)) <= 15]]


def masked(text, spans):
    names = ["<EMAIL>", "<IP>", "<CARD>", "<PHONE>"]
    out, done = "", 0
    for start, end, kind in sorted((s, e, k) for k, own in enumerate(spans) for s, e in own):
        if start >= done:
            out += text[done:start] + names[kind]
        done = max(done, end)
    return out + text[done:]
