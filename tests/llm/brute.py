"""Plain versions of the operators, for small tables."""

import hashlib
import re
import zlib
from collections import Counter

import xxhash

from poolsift.llm import line_dedup

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def lower(text):
    return (text or "").translate(LOWER)


def words(text):
    return WORD.findall(lower(text))


def remainder(doc_id, modulus):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % modulus


def fingerprint(text):
    ws = TOKEN.findall(lower(text))
    if not ws:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(ws[i : i + 3]).encode(), 42) for i in range(max(1, len(ws) - 2))]
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64))


def near_groups(prints):
    """Group number of each fingerprint by comparing all of them."""
    root = list(range(len(prints)))
    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return root


def contamination(text, items, width=10):
    """(n_words, n_hit, hit item ids) against (item_id, text) items."""
    ws, hit, found = words(text), set(), set()
    for item_id, item in items:
        own = words(item)
        n = min(width, len(own))
        for s in range(len(own) - n + 1 if n else 0):
            for i in range(len(ws) - n + 1):
                if ws[i : i + n] == own[s : s + n]:
                    hit.update(range(i, i + n))
                    found.add(item_id)
    return len(ws), len(hit), found


def digest(ids):
    return hashlib.sha256(",".join(sorted(str(i) for i in ids if i is not None)).encode()).hexdigest()


def base_quality(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    ws = TOKEN.findall(text)
    grams = list(zip(ws, ws[1:], ws[2:]))
    counts = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if counts[g] > 1 for k in range(3)}
    seen, repeated = set(), 0
    for line in text.split("\n"):
        if TOKEN.search(line):
            repeated += line in seen
            seen.add(line)
    return len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text)), repeated, len(covered)


# --- lines and windows of a text, word by word ------------------------------------------

STOP_SIGNS = "。！？｡।۔؟።"
M64 = (1 << 64) - 1


def spaced_words(text):
    """(first character, character behind) of each word: between ASCII white space, or one of a script without spaces."""
    found, k = [], 0
    while k < len(text):
        if text[k] in " \t\n\v\f\r":
            k += 1
        elif unspaced(text[k]):
            found.append((k, k + 1))
            k += 1
        else:
            end = k
            while end < len(text) and text[end] not in " \t\n\v\f\r" and not unspaced(text[end]):
                end += 1
            found.append((k, end))
            k = end
    return found


def unspaced(c):
    return any(low <= ord(c) <= high for low, high in line_dedup.UNSPACED)


def word_key(word):
    data = word.encode("utf-8", "surrogatepass")
    total = sum(int(line_dedup._VALUES[b]) * pow(line_dedup.BYTE_FACTOR, k, 1 << 64) for k, b in enumerate(data))
    x = (total + len(data)) & M64
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & M64
    x = (x ^ x >> 27) * 0x94D049BB133111EB & M64
    return (x ^ x >> 31) >> 32


def cut_lines(text):
    """Words of each line, and for each line whether a sentence begins with it."""
    places = spaced_words(text)
    ws = [text[a:b] for a, b in places]
    begins = []
    for i, (a, _) in enumerate(places):
        between = text[places[i - 1][1] : a] if i else ""
        ended = i and (ws[i - 1][-1] in STOP_SIGNS and not (unspaced(ws[i][0]) and ws[i] in STOP_SIGNS) or ws[i - 1][-1] in ".!?" and between)
        if not i or "\n" in between or ended:
            begins.append(i)
    lines, fresh = [], []
    for a, b in zip(begins, [*begins[1:], len(ws)]):
        keys, n = [word_key(w) for w in ws[a:b]], line_dedup.LONGEST
        cuts = {k + min(range(n), key=lambda m: keys[k + m]) for k in range(1, b - a - n + 1)}
        bounds = [0, *sorted(cuts), b - a]
        lines += [ws[a + x : a + y] for x, y in zip(bounds, bounds[1:])]
        fresh += [True, *[False] * len(cuts)]
    return lines, fresh


def line_windows(text, needed=False):
    """(first word, word behind, words) of every window; if ``needed``, without those that windows of lines cover."""
    lines, fresh = cut_lines(text)
    starts = [sum(map(len, lines[:k])) for k in range(len(lines) + 1)]
    sentences = [s for s, f in zip(starts, fresh) if f] + starts[-1:]
    ws, found = [w for line in lines for w in line], set()
    for bounds, least in ((starts, line_dedup.LINE_WORDS), (sentences, line_dedup.MIN_WORDS)):
        for i in range(len(bounds)):
            ahead = [b for b in bounds[i + line_dedup.WINDOW :] if b - bounds[i] >= least]
            if needed and bounds is sentences:
                ahead = [b for b in ahead[:1] if b - bounds[i] < line_dedup.LINE_WORDS]
            back = [a for a in bounds[: max(0, i - line_dedup.WINDOW + 1)] if bounds[i] - a >= least]
            if needed and bounds is sentences:
                back = [a for a in back[-1:] if bounds[i] - a < line_dedup.LINE_WORDS]
            found |= {(bounds[i], ahead[0])} if ahead else set()
            found |= {(back[-1], bounds[i])} if back else set()
    if not found and len(ws) >= line_dedup.MIN_WORDS:
        found = {(0, len(ws))}
    return [(a, b, tuple(ws[a:b])) for a, b in sorted(found)]


def kept_texts(rows, needed=True):
    """Text that stays of each (key, text), rows in the order of occurrences."""
    seen, out = set(), {}
    for key, text in rows:
        text = text or ""
        places, gone = spaced_words(text), set()
        for a, b, words_ in line_windows(text, needed):
            if words_ in seen:
                gone.update(range(a, b))
            seen.add(words_)
        bounds = [0, *(a for a, _ in places[1:]), len(text)] if places else [0, len(text)]
        out[key] = "".join(text[a:b] for i, (a, b) in enumerate(zip(bounds, bounds[1:])) if i not in gone)
    return out


def repeated_fifty(originals, kept, n=50):
    """Keys of kept texts that still hold ``n`` words in a row of an earlier original; texts in order."""
    earlier, found = set(), []
    for key, text in originals:
        own = [kept[key][a:b] for a, b in spaced_words(kept[key])]
        if any(hash(tuple(own[k : k + n])) in earlier for k in range(len(own) - n + 1)):
            found.append(key)
        own = [text[a:b] for a, b in spaced_words(text)]
        earlier.update(hash(tuple(own[k : k + n])) for k in range(len(own) - n + 1))
    return found
