"""Plain versions of the operators, for small tables."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import regex

BLANK = " \t\n\v\f\r"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def words(text):
    return WORD.findall(text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def lines_kept(data, min_chars=40, min_docs=5):
    """(doc_id, text, n_lines, n_dropped) of each row."""
    key = lambda line: lower(line.strip(BLANK))
    holders, last = Counter(), {}
    low = lambda i: -(2**63) if i is None else i
    for i, text in data:
        for k in {key(x) for x in (text or "").split("\n")}:
            holders[k] += 1
            last[k] = max(last.get(k, -(2**63)), low(i))
    out = []
    for i, text in data:
        lines = (text or "").split("\n")
        stay = [x for x in lines if len(key(x)) < min_chars or holders[key(x)] < min_docs or last[key(x)] == low(i)]
        out.append((i, "\n".join(stay), len(lines), len(lines) - len(stay)))
    return out


def repeats_removed(data, window=13):
    """(doc_id, n_words, n_removed, kept words)."""
    first = {}
    for i, text in data:
        w = words(text)
        for k in range(len(w) - window + 1):
            if i is not None:
                first[tuple(w[k : k + window])] = min(first.get(tuple(w[k : k + window]), i), i)
    out = []
    for i, text in data:
        w = words(text)
        gone = set()
        for k in range(len(w) - window + 1):
            if i is not None and first[tuple(w[k : k + window])] < i:
                gone.update(range(k, k + window))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


def shingles(text, size):
    w = [lower(x) for x in words(text)]
    if not w:
        return frozenset()
    return frozenset(tuple(w[k : k + size]) for k in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)])


def components(data, size, percent=80):
    """(n_shingles, component_id) of each row, in order."""
    sets = [shingles(t, size) for _, t in data]
    up = list(range(len(data)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(data)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                up[root(a)] = root(b)
    least = defaultdict(list)
    for k, (i, _) in enumerate(data):
        if i is not None:
            least[root(k)].append(i)
    return [(len(sets[k]), min(least[root(k)], default=None) if sets[k] else data[k][0]) for k in range(len(data))]


def rule_counts(text):
    text = text or ""
    w = words(text)
    grams = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {k + j for k, g in enumerate(zip(w, w[1:], w[2:], strict=False)) if grams[g] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def held_out(i):
    return i is not None and zlib.crc32(str(i).encode()) % 5 == 1


def ngrams(text):
    """Words without outer punctuation, and pairs of word shapes with a mark for a repeated word."""
    w = words(text)
    core = [regex.sub(r"^[^\pL\pN]+|[^\pL\pN]+$", "", x).lower() for x in w]
    shape = []
    for x in w:
        for pattern, mark in ((r"\p{Lu}+", "X"), (r"\p{Ll}+", "x"), (r"\p{Lo}+", "o"), (r"[0-9]+", "9")):
            x = regex.sub(pattern, mark, x)
        shape.append(x[:6])
    return {("w", x) for x in core} | {("s", a, b, x == y) for a, b, x, y in zip(shape, shape[1:], core, core[1:], strict=False)}


def log_weights(data, good, labelled, smoothing=2.0, shrink=5.0):
    """log p_target / p_raw of each text, its own counts left out."""
    sets = [ngrams(t) for _, t in data]
    target, known, raw = Counter(), Counter(), Counter()
    for (i, _), s in zip(data, sets, strict=True):
        raw.update(s)
        target.update(s if i in good else ())
        known.update(s if i in labelled else ())
    scale, share = sum(target.values()) / sum(raw.values()), len(good) / len(labelled)
    out = []
    for (i, _), s in zip(data, sets, strict=True):
        total = 0.0
        for g in s:
            t, k, r = target[g] - (i in good), known[g] - (i in labelled), raw[g] - 1
            z2 = (t - k * share) ** 2 / (k * share * (1 - share) + 1e-9)
            total += math.log((t + smoothing) / (r * scale + smoothing)) * z2 / (z2 + shrink**2)
        out.append(total)
    return out


NUMBER_WORDS = "two three four five six seven eight nine ten eleven twelve twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion half twice double triple dozen".split()


def template(text, units):
    """(kind, lower-case word) of each token: W, NUM, NAME or UNIT."""
    out, begins = [], True
    for raw in words(text):
        core = regex.sub(r"^[^\pL\pN]+|[^\pL\pN]+$", "", raw)
        ends = bool(regex.search(r"[.!?:][^\pL\pN]*$", raw))
        if core:
            low = core.lower()
            if regex.fullmatch(r"[0-9][0-9.,:/%-]*", core) or low in NUMBER_WORDS:
                kind = "NUM"
            elif low in units or regex.fullmatch(r"[0-9][0-9.,]*\pL{1,3}", core):
                kind = "UNIT"
            elif regex.fullmatch(r"\p{Lu}\p{Ll}+", core) and not begins:
                kind = "NAME"
            else:
                kind = "W"
            out.append((kind, low))
        begins = ends
    return out


def leaked(text, items, units, window=8, min_cover=0.5, min_tokens=13):
    """Ids of the items that a text has, by comparing all windows with all windows."""
    doc, found = template(text, units), set()
    for key, item_text in items:
        item = template(item_text, units)
        if key is None or not item:
            continue
        size, shifts = min(window, len(item)), defaultdict(set)
        for a in range(len(doc) - size + 1):
            for b in range(len(item) - size + 1):
                x, y = doc[a : a + size], item[b : b + size]
                typed, plain = ([[k if k != "W" and (k != "NAME" or names) else w for k, w in z] for z in (x, y)] for names in (True, False))
                exact = [[w for _, w in z] for z in (x, y)]

                def slots(z, names):
                    return sum(k in ("NUM", "UNIT") or (names and k == "NAME") for k, _ in z)

                named = [any(k == "NAME" for k, _ in z) for z in (x, y)]
                ok = all(named) and all(2 * slots(z, True) <= size for z in (x, y)) and typed[0] == typed[1]
                ok = ok or (all(2 * slots(z, False) <= size for z in (x, y)) and plain[0] == plain[1])
                ok = ok or (all(2 * slots(z, False) > size for z in (x, y)) and exact[0] == exact[1])
                if ok:
                    shifts[a - b].add(b)
        for shift, at in shifts.items():
            places = {b + k for b in at for k in range(size)}
            if len(places) < min_cover * len(item) and len(places) < min_tokens:
                continue
            pairs = Counter((item[p][1], doc[p + shift][1]) for p in sorted(places) if item[p][0] != "W")
            if len({a for a, _ in pairs}) < len(pairs):
                main = {}
                for (a, b), n in sorted(pairs.items(), key=lambda x: (-x[1], x[0][0] != x[0][1])):
                    main.setdefault(a, b)
                unequal = {p for p in places if item[p][0] != "W" and item[p][1] != doc[p + shift][1]}
                minor = {p for p in places if item[p][0] != "W" and main[item[p][1]] != doc[p + shift][1]}
                rest = [{b + k for b in at if not odd & set(range(b, b + size)) for k in range(size)} for odd in (unequal, minor)]
                if max(map(len, rest)) < min_tokens:
                    continue
            found.add(key)
    return sorted(found)


def exact_components(sets, percent=80):
    """The least position of each set's component, by an exact join on the rarest members of every set; and the number
    of links between different sets. Empty sets are alone."""
    up = list(range(len(sets)))

    def root(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    first = {}
    for i, s in enumerate(sets):
        if s:
            up[i] = first.setdefault(s, i)
    held = Counter(x for s in first for x in s)
    index, links = defaultdict(list), 0
    for s in sorted(first, key=len):
        rarest = sorted(s, key=lambda x: (held[x], x))[: len(s) + percent * len(s) // -100 + 1]
        for o in {o for x in rarest for o in index[x]}:
            both = len(s & o)
            if 100 * both >= percent * (len(s) + len(o) - both):
                links += 1
                a, b = sorted((root(first[s]), root(first[o])))
                up[b] = a
        for x in rarest:
            index[x].append(s)
    return [root(i) for i in range(len(sets))], links
