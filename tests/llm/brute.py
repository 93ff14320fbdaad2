"""Plain versions of the operators' contracts, over lists of (doc_id, text)."""

import hashlib
import re
import unicodedata
import zlib
from collections import Counter
from itertools import combinations

PLAIN_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BLANK_WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def plain_words(text):
    return PLAIN_WORD.findall((text or "").translate(LOWER))


def blank_words(text, lower=False):
    text = text or ""
    return BLANK_WORD.findall(text.translate(LOWER) if lower else text)


def fold(doc_id, mod):
    return None if doc_id is None else zlib.crc32(str(doc_id).encode()) % mod


def decontaminated(docs, items, width=13):
    """[(doc_id, n_words, n_hit, n_items, items_sha256, contaminated)]"""
    windows = {}
    for item, text in items:
        w = plain_words(text)
        if w:
            for i in range(max(1, len(w) - width + 1)):
                windows.setdefault(tuple(w[i : i + width]), set()).add("" if item is None else str(item))
    sizes = {len(w) for w in windows}
    out = []
    for doc_id, text in docs:
        w = plain_words(text)
        hit, found = set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if own := windows.get(tuple(w[i : i + n])):
                    hit.update(range(i, i + n))
                    found |= own
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc_id, len(w), len(hit), len(found), digest, len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out


def shingles(text, width=5):
    w = blank_words(text, lower=True)
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()


def roots(docs, percent=80):
    """The number of the first row that each row is linked to, through others too."""
    sets = [shingles(t) for _, t in docs]
    up = list(range(len(docs)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in combinations(range(len(docs)), 2):
        if (
            sets[a]
            and sets[b]
            and 100 * min(len(sets[a]), len(sets[b])) >= percent * max(len(sets[a]), len(sets[b]))
            and 100 * (both := len(sets[a] & sets[b])) >= percent * (len(sets[a]) + len(sets[b]) - both)
        ):
            x, y = sorted((find(a), find(b)))
            up[y] = x
    return [find(k) for k in range(len(docs))]


def linked(docs, percent=80):
    """[(doc_id, n_shingles, component_id)], rows told apart by position."""
    low, of = {}, roots(docs, percent)
    for r, (doc_id, _) in zip(of, docs, strict=True):
        if doc_id is not None:
            low[r] = min(doc_id, low.get(r, doc_id))
    return [(doc_id, len(shingles(t)), low.get(r)) for r, (doc_id, t) in zip(of, docs, strict=True)]


def quality_counts(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)"""
    text = text or ""
    w = blank_words(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if BLANK_WORD.search(line):
            dup += line in seen
            seen.add(line)
    at = {}
    for i in range(len(w) - 4):
        at.setdefault(tuple(w[i : i + 5]), []).append(i)
    covered = {i + j for places in at.values() if len(places) > 1 for i in places for j in range(5)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


BASE = {("cc", "by"): "cc-by", ("general", "public", "license"): "gpl", ("all", "rights", "reserved"): "reserved"}


def license_base(text):
    """(n_words, n_base, first_word, last_word, base_labels)"""
    w = plain_words(text)
    hits = [(i, label) for phrase, label in BASE.items() for i in range(len(w)) if tuple(w[i : i + len(phrase)]) == phrase]
    at = [i for i, _ in hits]
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({label for _, label in hits}))


def edits(needle, text):
    """The fewest edits with which the needle occurs somewhere in the text."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(needle, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def ngrams(text):
    """{code: count} of the n-grams of one to three characters; words are runs of letters and marks with a letter."""
    out, word = Counter(), ""
    for c in (text or "").lower() + " ":
        if c.isalpha() or unicodedata.category(c)[0] == "M":
            word += c
            continue
        if any(x.isalpha() for x in word):
            padded = f"_{word}_"
            out.update(g for n in (1, 2, 3) for i in range(len(padded) - n + 1) if (g := padded[i : i + n]) != "_")
        word = ""
    codes = {}
    for g, n in out.items():
        code = 0
        for x in g:
            code = code << 21 | ord(x)
        codes[code] = n
    return codes


def rank_order(counts, most):
    return [c for c, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:most]]


def one_edit(a, b):
    """Exactly one inserted, deleted or replaced code point."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    i = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[i + (len(a) >= len(b)) :] == b[i + (len(b) >= len(a)) :]


def spelling_counts(docs):
    """{word: n} of the words of at least 7 code points that occur twice."""
    n = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}


def spelling_groups(docs):
    """[(word, form, root, n, n_near, form_n)]"""
    n = spelling_counts(docs)
    near, short = {}, {}
    for w in n:
        for i in range(len(w)):
            short.setdefault(w[:i] + w[i + 1 :], set()).add(w)
    for w in n:
        near[w] = {v for i in range(len(w)) for v in short[w[:i] + w[i + 1 :]]} | short.get(w, set()) | {w[:i] + w[i + 1 :] for i in range(len(w))} & n.keys()
        near[w] = {v for v in near[w] if one_edit(w, v)}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return [(w, form[w], root(w), n[w], len(near[w]), None if form[w] is None else n[form[w]]) for w in n]


def filled(docs, seed=1):
    """[(doc_id, n, form, prefix_chars, middle_chars, output)]"""
    out = []
    for doc_id, text in docs:
        text = text or ""
        units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
        digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
        h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
        a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
        x, y, z = ("".join(part) for part in (units[:a], units[a:b], units[b:]))
        if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
            out.append((doc_id, len(units), "plain", None, None, text))
        elif h[3] % 100 < 20:
            out.append((doc_id, len(units), "spm", len(x), len(y), f"<S>{z}<P>{x}<M>{y}"))
        else:
            out.append((doc_id, len(units), "psm", len(x), len(y), f"<P>{x}<S>{z}<M>{y}"))
    return out


def mix_targets(sizes):
    """{source: target}, by sharing the excess again until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    full, rest = set(), sum(sizes.values())
    while True:
        open_ = [s for s in order if s not in full]
        left = rest - sum(3 * sizes[s] for s in full)
        share = {s: weight[s] * left / sum(weight[x] for x in open_) for s in open_}
        above = {s for s in open_ if share[s] > 3 * sizes[s]}
        if not above:
            return share | {s: 3.0 * sizes[s] for s in full}
        full |= above


def distance(a, b):
    """Inserted, deleted and replaced bytes from a to b."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def notices(text, all_notices):
    """[(begin, end, label, edits)]: the best of overlapping runs of whole words that are a notice but for some edits."""
    begins = [k for k in range(len(text)) if k == 0 or text[k - 1] == 32]
    ends = [k for k in range(1, len(text) + 1) if k == len(text) or text[k] == 32]
    spans = set()
    for label, notice, most in all_notices:
        for a in begins:
            for b in ends:
                if abs(b - a - len(notice)) <= most and (e := distance(notice, text[a:b])) <= most:
                    spans.add((a, b, label, e))
    kept = []
    for s in sorted(spans, key=lambda s: (s[3], s[0], s[1], s[2])):
        if not any(s[2] == o[2] and s[0] < o[1] and o[0] < s[1] for o in kept) and not any(s[3] and not o[3] and s[0] < o[1] and o[0] < s[1] for o in spans):
            kept.append(s)
    return sorted(kept)


def near_items(docs, items, width=13, slop=3):
    """[(doc_id, n_near_items)]: items with a window whose two rarest terms stand in their distance, give or take ``slop`` words."""
    windows = {}
    for item, text in items:
        w = plain_words(text)
        for i in range(max(1, len(w) - width + 1) if w else 0):
            windows.setdefault(tuple(w[i : i + width]), set()).add("" if item is None else str(item))
    count = Counter(w for _, text in docs for w in plain_words(text))
    out = []
    for doc_id, text in docs:
        at = {}
        for k, w in enumerate(plain_words(text)):
            at.setdefault(w, []).append(k)
        found = set()
        for terms, own in windows.items():
            if all(count[t] for t in terms):
                (_, o1, t1), *rest = sorted((count[t], o, t) for o, t in enumerate(terms))
                if not rest:
                    found |= own if t1 in at else set()
                elif any(abs(b - a - (rest[0][1] - o1)) <= slop for a in at.get(t1, ()) for b in at.get(rest[0][2], ())):
                    found |= own
        out.append((doc_id, len(found)))
    return out


def log_likelihood(features, grade, weight, thresholds):
    """Of graded documents ({slot: value}), one after another."""
    from math import exp, log

    tail = lambda z, k: 1.0 if k == 0 else 0.0 if k > len(thresholds) else 1 / (1 + exp(thresholds[k - 1] - z))
    total = 0.0
    for own, g in zip(features, grade, strict=True):
        z = sum(weight[s] * v for s, v in own.items())
        total += log(tail(z, g) - tail(z, g + 1))
    return total / len(grade)
