"""Plain versions of the operators' results, for small tables."""

import hashlib
import re
import zlib

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode("utf-8")).hexdigest()


# op1 ---------------------------------------------------------------------------------


def spans(text, kinds, base_kinds, scope):
    """All parts by the patterns; weak ones by comparing every pair of parts."""
    found = []
    for order, (kind, role, pattern, _) in enumerate(kinds):
        for m in re.finditer(pattern, text or ""):
            if kind != "assign" or len(m.group(2)) >= 8:
                found.append((m.start(), order, m.end(), kind, role, kind in base_kinds))
    out = []
    for p in found:
        if not p[5]:
            # the scope is measured from the end of one part to the start of the next
            near = [q for q in found if max(q[0] - p[2], p[0] - q[2]) <= scope and q[4] != p[4]]
            strong = any(q[5] for q in near)
            both = len({q[4] for q in near}) == 2
            overlaps = any(q[5] and q[0] < p[2] and q[2] > p[0] for q in found)
            if overlaps or not (strong or both):
                continue
        out.append(p)
    return sorted((s, o, e, k, b) for s, o, e, k, _, b in out)


def span_text(found):
    return ",".join(f"{k}:{s}:{e}" for s, _, e, k, _ in found)


def redact(text, found, mark="[secret]"):
    out, at = [], 0
    merged = []
    for s, _, e, _, _ in found:
        if merged and s <= merged[-1][1]:
            merged[-1][1] = max(e, merged[-1][1])
        else:
            merged.append([s, e])
    for s, e in merged:
        out += [text[at:s], mark]
        at = e
    return "".join([*out, text[at:]])


# op3 ---------------------------------------------------------------------------------


def vector(text, hash_lanes, sign_words):
    lanes = [0] * (hash_lanes + 64 * sign_words)

    def h(p, i):
        first = xxhash.xxh64_intdigest(p.encode("utf-8"), seed=42)
        return xxhash.xxh64_intdigest(i.to_bytes(4, "little"), seed=first)

    for p in filter(None, (text or "").split("\n")):
        w = int(len(p) ** 0.5)
        own = []
        for i in range(hash_lanes // 2):
            v = h(p, i)
            own += [v & 0xFFFFFFFF, v >> 32]
        for i in range(sign_words):
            v = h(p, 100 + i)
            own += [w if v >> b & 1 else -w for b in range(64)]
        lanes = [(a + b) % (1 << 32) for a, b in zip(lanes, own)]
    return lanes


# op4 ---------------------------------------------------------------------------------


def viterbi(text, vocabulary):
    """Best ids over the whole text at once."""
    if not text:
        return []
    text = "▁" + text.replace(" ", "▁")
    best, back = [0.0], [0]
    for end in range(1, len(text) + 1):
        options = []
        for size in range(min(vocabulary.longest, end), 0, -1):
            piece = text[end - size : end]
            if piece in vocabulary.entry:
                options.append((best[end - size] + vocabulary.entry[piece][0], size))
        if not any(s == 1 for _, s in options):
            options.append((best[end - 1] + vocabulary.unknown, 1))
        top = max(s for s, _ in options)
        size = max(n for s, n in options if s == top)
        best.append(top)
        back.append(size)
    out, end = [], len(text)
    while end:
        piece = text[end - back[end] : end]
        known = vocabulary.entry.get(piece)
        out[:0] = [known[1]] if known else [vocabulary.byte_ids[b] for b in piece.encode("utf-8")]
        end -= back[end]
    return out


# op5 ---------------------------------------------------------------------------------


def shingle_set(text, k):
    words = WORD.findall((text or "").translate(ASCII_LOWER))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1)))


def near_classes(texts, k, similarity=80):
    """For every index of `texts`, the least index it is linked with."""
    sets = [shingle_set(t, k) for t in texts]
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            common = len(a & sets[j])
            if common and 100 * common >= similarity * (len(a) + len(sets[j]) - common):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return [root(i) for i in range(len(texts))], [len(s) for s in sets]


# op6, op7 ----------------------------------------------------------------------------


def repeats(units_by_doc, length=50):
    """(doc, units) pairs -> flags per unit; a smaller document's windows remove."""
    first = {}
    for doc, units in units_by_doc:
        for s in range(len(units) - length + 1):
            w = tuple(units[s : s + length])
            if doc is not None and first.get(w, doc) >= doc:
                first[w] = doc
    out = []
    for doc, units in units_by_doc:
        gone = [False] * len(units)
        if doc is not None:
            for s in range(len(units) - length + 1):
                if first[tuple(units[s : s + length])] < doc:
                    gone[s : s + length] = [True] * length
        out.append(gone)
    return out


def n_runs(flags):
    return sum(1 for i, f in enumerate(flags) if f and (i == 0 or not flags[i - 1]))


def crc(data):
    return zlib.crc32(data)
