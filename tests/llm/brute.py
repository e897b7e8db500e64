"""Plain statements of the contracts, slow and short, and a small table of awkward documents."""

from __future__ import annotations

import hashlib
import random
import re

SPACE = r"[\x20\x09-\x0D]+"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _hash string, _id string, key string, g string, n int, _row string, size string"


def lower(text):
    return re.sub("[A-Z]+", lambda m: m.group().lower(), text or "")


def words(text):
    return [w for w in re.split(SPACE, text or "") if w]


def item_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def sha(value):
    return hashlib.sha256(value if isinstance(value, bytes) else value.encode()).hexdigest()


def documents(seed=5):
    """Exact and near copies, nulls, blanks, short and long texts, shared passages, repeated rows."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghijklmnoprstuvé") for _ in range(rng.randint(2, 9))) for _ in range(400)]

    def fresh(n):
        return " ".join(rng.choice(vocabulary) for _ in range(n))

    def edited(text, n):
        out = text.split(" ")
        for i in rng.sample(range(len(out)), n):
            out[i] = rng.choice(vocabulary)
        return " ".join(out)

    base, passage = fresh(200), fresh(90)
    texts = [None, "", " \t\n ", "one", "One", "two words", "three short words", "ß", "\U0001f600 word \U0001f600", base, base, base.upper()]
    texts += [edited(base, n) for n in (1, 1, 2, 3, 4, 5, 6, 8, 12, 20)]
    texts += [edited(edited(base, 3), 3) for _ in range(4)]
    texts += [fresh(40) + " " + passage + " " + fresh(30) for _ in range(4)] + [fresh(20) + " " + edited(passage, 4) + "\n" + fresh(50)]
    texts += [fresh(3000), "same line\nsame line\n" * 40, "x" * 5000, fresh(25) + " # $ %"] + [fresh(rng.randint(5, 80)) for _ in range(20)]
    rows = [(i + 1, t) for i, t in enumerate(texts)] + [(3, " \t\n "), (10, base), (None, fresh(60)), (None, base)]
    sources = ["web", "web", "web", "books", "code", None, ""]
    return [(i, t, [None, "en", "fr"][k % 3], sources[k % 7], len(t or ""), "a", "b", "c", "d", 1, "e", "f") for k, (i, t) in enumerate(rows)]


def near_duplicates(rows, shingle=4, percent=80):
    sets = []
    for row in rows:
        w = words(lower(row[1]))
        sets.append({tuple(w[i:i + shingle]) for i in range(max(len(w) - shingle, 0) + 1)} if w else set())
    top = list(range(len(rows)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                top[find(i)] = find(j)
    lowest = {}
    for i, row in enumerate(rows):
        if row[0] is not None:
            lowest[find(i)] = min(lowest.get(find(i), row[0]), row[0])
    return sorted(((r[0], len(s), lowest.get(find(i)), lowest.get(find(i)) == r[0]) for i, (r, s) in enumerate(zip(rows, sets))), key=repr)


def luhn(digits):
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def base_spans(text):
    text, out = text or "", []
    for k, pattern in enumerate((r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
                                 r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            good = (True, k != 1 or all(int(p) <= 255 for p in m.group().split(".")), 14 <= len(digits) <= 19 and luhn(digits), 10 <= len(digits) <= 15)[k]
            if good:
                out.append((m.start(), k, m.end()))
    return [(("email", "ip", "card", "phone")[k], a, b) for a, k, b in sorted(out)]


def quality(text):
    w, seen, repeated = words(text), {}, set()
    for i in range(len(w) - 7):
        seen.setdefault(tuple(w[i:i + 8]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            repeated |= {j for i in at for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    failed = len(w) < 20 or 100 * len(repeated) > 30 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(repeated), failed


def targets(rows):
    sizes = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + len(words(r[1]))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, open_, out = 1.5 * sum(sizes.values()), set(order), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if weight[s] * level > 2 * sizes[s]]
        for s in full or open_:
            out[s] = 2.0 * sizes[s] if full else weight[s] * level
        if not full:
            break
        left -= sum(out[s] for s in full)
        open_ -= set(full)
    return sizes, out


def repeated_strings(rows, length=400):
    where, data = {}, [(r[1] or "").encode() for r in rows]
    for d, text in enumerate(data):
        for i in range(len(text) - length + 1):
            where.setdefault(text[i:i + length], []).append((d, i))
    hit = [bytearray(len(t)) for t in data]
    for at in where.values():
        for d, i in at if len(at) > 1 else ():
            hit[d][i:i + length] = b"\1" * length
    out = []
    for row, text, cover in zip(rows, data, hit):
        kept = bytes(b for b, c in zip(text, cover) if not c)
        out.append((row[0], len(text), sum(cover), len(re.findall(b"\1+", bytes(cover))), sha(kept)))
    return sorted(out, key=repr)


def contamination(rows, items, window=13):
    index = {}
    for item, text in items:
        w = item_words(text)
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if n and item is not None else 0):
            index.setdefault(tuple(w[i:i + n]), set()).add(str(item))
    out = []
    for row in rows:
        w, hit, found = item_words(row[1]), set(), set()
        for n in {len(k) for k in index}:
            for i in range(len(w) - n + 1):
                for item in index.get(tuple(w[i:i + n]), ()):
                    hit |= set(range(i, i + n))
                    found.add(item)
        out.append((row[0], len(w), len(hit), len(found), sha(",".join(sorted(found))), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)
