"""Plain restatements of the operators' contracts."""

import base64
import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")

#: Texts that try every edge: null, empty, white space only, repeats, marks, odd white space, other scripts, long words.
ODD = [
    None, "", " ", "\n\t\r\x0b\x0c", "a", "a b", "a b c", "One two, three.", "One two, three.", "x" * 5000, " ".join(["la"] * 400),
    " ".join(f"w{i}" for i in range(60)), "w0 " + " ".join(f"w{i}" for i in range(60)), "line one\nline one\nline two\n\nline one", "#*$%&|<> 100%",
    "ÉTÉ été mot mot　mot ́ é", "日本語のテキスト 日本語", "<|endoftext|> <|startoftext|>", r"\b \l \\ < > </turn>", "don't we'll I'D",
    "a\x01b \x01 c", "🙂🙂 ​ z", " ".join(["ab"] * 19), " ".join(["ab"] * 20), " ".join(["ab"] * 21), "b " + " ".join(["ab"] * 30) + " c",
]


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def op1(docs):
    words = {i: WORD.findall(t or "") for i, t in docs}
    seen, gone = set(), defaultdict(set)
    for i in sorted(words):
        w = words[i]
        for s in range(len(w) - 19):
            key = tuple(w[s : s + 20])
            if key in seen:
                gone[i].update(range(s, s + 20))
            seen.add(key)
    return sorted((i, len(w), len(gone[i]), sha(" ".join(x for k, x in enumerate(w) if k not in gone[i]))) for i, w in words.items())


def op2(docs, tok):
    out, start = [], 0
    for i, t in sorted(docs):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [1]
        out.append((i, start, len(ids), crc(ids)))
        start += len(ids)
    return out


def op3(pages):
    best = {}
    for i, html in pages:
        best[html or ""] = max(best.get(html or "", i), i)
    out = []
    for i, html in pages:
        raw = (html or "").encode()
        to = best[html or ""]
        out.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if to == i else "revisit", None if to == i else to))
    return sorted(out)


def op5(docs, words=3, radius=2):
    import xxhash

    prints = {}
    for i, t in docs:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        g = [" ".join(w[k : k + words]) for k in range(len(w) - words + 1)] or ([" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(x.encode(), seed=42) for x in g]
        prints[i] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    root = {i: i for i in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(prints)
    for a in ids:
        for b in ids:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= radius:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return sorted((i, f"{prints[i]:016x}", find(i)) for i in ids)


def op6_pieces(docs, tok):
    out = []
    for i, t in docs:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [0]
        cuts = [0, *range(len(ids) % 2048 or 2048, len(ids), 2048), len(ids)]
        out += [(i, k, a, b - a, crc(ids[a:b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    return sorted(out)


def op7(docs, enc):
    out = []
    for i, t in docs:
        ids = enc.encode_ordinary(t or "")
        out.append((i, len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), sha(t or "")))
    return sorted(out)


def op8(docs):
    by = defaultdict(list)
    for i, t in docs:
        by[t or ""].append(i)
    return sorted((i, max(by[t or ""]), len(by[t or ""]), i == max(by[t or ""]), sha(t or "")) for i, t in docs)


def op9(docs):
    """Without the verdict on hosts."""
    out = []
    for i, t in docs:
        t = t or ""
        w = WORD.findall(t)
        grams = Counter(zip(w, w[1:], w[2:]))
        hit = {k + j for k in range(len(w) - 2) if grams[w[k], w[k + 1], w[k + 2]] > 1 for j in range(3)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        out.append((i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit), len(w) < 50 or 100 * len(hit) > 50 * len(w)))
    return sorted(out)


def jump(key, n):
    key &= (1 << 64) - 1
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) & ((1 << 64) - 1)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def op10(docs):
    slots, out = Counter(), []
    for i, t in sorted(docs):
        s = jump(i, 16)
        raw = (t or "").encode()
        out.append((i, len(raw) + 1, zlib.crc32(raw), "key", s, slots[s], jump(i, 17)))
        slots[s] += 1
    return out
