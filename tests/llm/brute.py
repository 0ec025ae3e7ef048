"""What the contracts say, in plain Python over plain rows."""

import base64
import hashlib
import math
import re
import struct
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def quality(text):
    text = text or ""
    w = words(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = defaultdict(list)
    for i in range(len(w) - 7):
        windows[tuple(w[i : i + 8])].append(i)
    covered = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(8)}
    failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(covered), failed


def divergence(p, q):
    """Jensen-Shannon distance, base 2."""
    total = sum(x * math.log2(x / ((x + y) / 2)) for a, b in ((p, q), (q, p)) for x, y in zip(a, b, strict=True) if x > 0)
    return math.sqrt(max(total / 2, 0))


def char_classes(text):
    def kind(c):
        if "a" <= c <= "z":
            return 0
        if "A" <= c <= "Z":
            return 1
        if "0" <= c <= "9":
            return 2
        if c == " " or "\x09" <= c <= "\x0d":
            return 3
        return 4 if c in "#*$%&|<>" else 5 if c > "\x7f" else 6

    n = Counter(map(kind, text or ""))
    return [n[k] for k in range(7)]


def language_distances(docs, rules):
    """(class distance, word distance) of each (text, language)."""
    words_of, classes_of = defaultdict(Counter), defaultdict(lambda: [0] * 7)
    for text, lang in docs:
        words_of[lang].update(words(text))
        classes_of[lang] = [a + b for a, b in zip(classes_of[lang], char_classes(text), strict=True)]
    out = []
    for text, lang in docs:
        total = sum(words_of[lang].values())
        top = sorted(words_of[lang].items(), key=lambda x: (-x[1], x[0].encode()))[: rules.common]
        own, n = Counter(words(text)), len(words(text))
        known = total >= rules.min_reference
        class_distance = word_distance = None
        if known and len(text or "") >= rules.min_chars:
            class_distance = divergence([x / len(text) for x in char_classes(text)], [x / sum(classes_of[lang]) for x in classes_of[lang]])
        if known and n >= rules.min_words:
            p, q = [own[w] / n for w, _ in top], [x / total for _, x in top]
            word_distance = divergence([*p, 1 - sum(p)], [*q, max(0.0, 1 - sum(q))])
        out.append((class_distance, word_distance))
    return out


def shingles(text, k):
    w = [bytes(x, "utf-8").lower() for x in words(text)]
    if not w:
        return set()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)}


def near(docs, k, percent):
    """doc_id to (set size, component), from all pairs that share a shingle."""
    sets = {d: shingles(t, k) for d, t in docs}
    by = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            by[x].append(d)
    common = Counter()
    for ids in by.values():
        for i, a in enumerate(ids):
            for b in ids[i + 1 :]:
                common[a, b] += 1
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, b), n in common.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {d: (len(s), root(d)) for d, s in sets.items()}


def targets(sizes):
    """Shares by weight with a cap, the excess reshared until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, out, free = sum(sizes.values()), {}, set(order)
    left = float(total)
    while free:
        w = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / w >= 3 * sizes[s]]
        if not over:
            out.update({s: left * weight[s] / w for s in free})
            break
        for s in over:
            out[s] = 3.0 * sizes[s]
            free.discard(s)
        left = total - sum(out.values())
    return out


def secrets(text):
    text = text or ""
    out = [("assign", *m.span()) for m in re.finditer(r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text) if len(m[2]) >= 6]
    out += [("access", *m.span()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [("hex", *m.span()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    kinds = ["assign", "access", "hex"]
    return sorted(out, key=lambda s: (s[1], kinds.index(s[0])))


def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def personal(text):
    text = text or ""
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 13 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m[0])) <= 15]
    return out


def joined(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def sha256(text):
    return hashlib.sha256(text.encode()).hexdigest()


def digest32(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def crc(ids):
    return zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))


def best_window(text, size=20):
    """Entropy and start of the first window with the highest."""
    best, at = -1.0, 0
    for i in range(max(1, len(text) - size + 1)):
        w = text[i : i + size]
        h = -sum(n / len(w) * math.log2(n / len(w)) for n in Counter(w).values())
        if h > best + 1e-9:
            best, at = h, i
    return best, at


def entropy_spans(text, classes, limits, allowed, placeholder):
    """Runs of each class whose best window is above its limit and that no allow rule knows; none within another."""
    out = []
    for kind, pattern in classes.items():
        for m in re.finditer(pattern, text or ""):
            h, at = best_window(m[0])
            if h > limits[kind] and not any(re.search(p, m[0]) for p in allowed) and not re.search(placeholder, m[0][at : at + 20]) and not any(a <= m.start() and m.end() <= b for _, a, b in out):
                out.append(("entropy", *m.span()))
    return out
