"""Plain Python versions of the operators, for comparison on small tables."""

import hashlib
import itertools
import math
import re
import unicodedata
import zlib
from collections import Counter

import numpy as np
import xxhash

BLANK = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def line_verdicts(text, rules):
    """Per line with a word: the line and whether it fails."""
    lines = [x for x in text.split("\n") if re.search(WORD, x)]

    def fails(line):
        w, bars, chars = len(re.findall(WORD, line)), len(re.findall(r"[|»•·]", line)), len(re.sub(BLANK, "", line))
        lowered = "".join(c.lower() if c.isascii() else c for c in line)
        said = sum(len(re.sub(BLANK, "", m)) for m in re.findall("|".join(rules.phrases), lowered))
        return (
            said * 100 >= rules.phrase_percent * chars
            or sum(unicodedata.category(c)[0] == "L" for c in line) * 100 < rules.letter_percent * chars
            or len(re.findall(SYMBOL, line)) * 100 >= rules.symbol_percent * chars
            or len(re.findall("!!+", line)) * 100 >= rules.shout_percent * w
            or (bars >= rules.bar_count and bars * 100 >= rules.bar_percent * w)
        )

    def short(line):
        end = line.strip(" \t\n\v\f\r").rstrip("\"'”’»)]")
        return len(re.findall(WORD, line)) <= rules.menu_words and not end.endswith(tuple(".!?:;,…。！？"))

    verdicts = []
    for is_short, run in itertools.groupby(lines, short):
        run = list(run)
        menu = is_short and len(run) >= rules.menu_lines
        verdicts += [(x, menu or fails(x)) for x in run]
    return verdicts


def cleaned(text, rules):
    verdicts = line_verdicts(text or "", rules)
    return "\n".join(x for x, bad in verdicts if not bad) if any(bad for _, bad in verdicts) else text


def quality(text, rules):
    text = text or ""
    words = re.findall(WORD, text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(5)}
    verdicts = line_verdicts(text, rules)
    lines = [x for x, _ in verdicts]

    chars = len("".join(words))
    left = sum(len(re.sub(BLANK, "", x)) for x, bad in verdicts if not bad)
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return {
        "n_words": len(words),
        "word_chars": chars,
        "n_symbols": len(re.findall(SYMBOL, text)),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(covered),
        "base_failed": failed,
        "kept": not failed and (chars - left) * 100 <= rules.lost_percent * chars,
    }


def exact_groups(rows):
    """{id: (keep_id, size)} for rows (id, text)."""
    groups = {}
    for id_, text in rows:
        groups.setdefault(re.sub(BLANK, "", text or ""), []).append((-len(text or ""), id_))
    return {id_: (min(g)[1], len(g)) for g in groups.values() for _, id_ in g}


def water_fill(sizes, weights=(5, 2, 1), most=3):
    """{source: target}: clamp and share out anew until none is above its cap."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in fixed]
        rest = total - sum(fixed.values())
        target = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        above = [s for s in free if target[s] > most * sizes[s]]
        if not above:
            return fixed | target
        fixed |= {s: most * sizes[s] for s in above}


def fingerprint(text):
    words = [w.encode().lower() for w in re.findall(WORD, text or "")]
    if not words:
        return 0
    n = min(4, len(words))
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + n]), 42) for i in range(len(words) - n + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(values, limit=4):
    """{value: smallest value reachable over steps of at most ``limit`` differing bits}."""
    values = sorted(set(values))
    array = np.array(values, np.uint64)
    top = {v: v for v in values}

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for i, v in enumerate(values):
        for j in np.flatnonzero(np.bitwise_count(array[i + 1 :] ^ array[i]) <= limit) + i + 1:
            a, b = root(v), root(values[j])
            top[max(a, b)] = min(a, b)
    return {v: root(v) for v in values}


def components(rows, limit=4):
    """{id: component id} for rows (id, text)."""
    prints = {id_: fingerprint(text) for id_, text in rows}
    of = classes(prints.values(), limit)
    first = {}
    for id_ in sorted(prints):
        first.setdefault(of[prints[id_]], id_)
    return {id_: first[of[f]] for id_, f in prints.items()}


def unigram_scores(rows, held_out):
    """(N, {id: (n_tokens, n_known, base score)}) for rows (id, text)."""
    tokens = {id_: [*(w.encode().lower() for w in re.findall(WORD, text or "")), b" "] for id_, text in rows}
    counts = Counter(w for id_, t in tokens.items() if not held_out(id_) for w in t)
    n, v = sum(counts.values()), len(counts)
    return n, {
        id_: (len(t), sum(counts[w] > 0 for w in t), sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t))
        for id_, t in tokens.items()
    }


def secret_spans(text):
    keyword = r"(?ai:(password|passwd|secret|token|api_?key))"
    assign = keyword + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    found = [(m.start(), 0, "assign", m.end()) for m in re.finditer(assign, text) if len(m[2]) >= 6]
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [f"{kind}:{a}:{b}" for a, _, kind, b in sorted(found)]


def _luhn(digits):
    doubled = [int(d) * (1 + k % 2) for k, d in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def personal_spans(text):
    def spans(kind, pattern, good=lambda digits, match: True):
        for m in re.finditer(pattern, text):
            if good(re.sub("[^0-9]", "", m[0]), m[0]):
                yield f"{kind}:{m.start()}:{m.end()}"

    return [
        *spans("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
        *spans("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda d, m: all(int(p) <= 255 for p in m.split("."))),
        *spans("card", r"[0-9]([\x20-]?[0-9])+", lambda d, m: 16 <= len(d) <= 19 and _luhn(d)),
        *spans("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda d, m: 8 <= len(d) <= 15),
    ]


def merkle(rows, fields, changed, order=("doc_id", "source", "lang", "n_chars", "text"), key=None):
    """{doc_id or row number: (leaf, subroot, root, proof, folded root, verified)}."""

    def part(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    def leaf(row):
        return sha("".join(part(row[f]) for f in order))

    rows = [dict(zip(fields, r)) for r in rows]
    lower = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
    by = {}
    for n, row in enumerate(rows):
        other = dict(row, text=row["text"].translate(lower)) if changed(row) and row["text"] is not None else row
        by.setdefault(row["lang"], []).append((row["doc_id"], leaf(row), n, leaf(other)))

    def levels(hashes):
        result = [hashes]
        while len(hashes) > 1:
            hashes = [sha("".join(hashes[i : i + 8])) for i in range(0, len(hashes), 8)]
            result.append(hashes)
        return result

    def up(tree, place, digest, siblings):
        for hashes in tree[:-1]:
            first = place // 8 * 8
            run = hashes[first : first + 8]
            siblings += run[: place - first] + run[place - first + 1 :]
            digest = sha("".join(run[: place - first] + [digest] + run[place - first + 1 :]))
            place //= 8
        return digest, siblings

    trees = {}
    for lang, members in by.items():
        members.sort(key=lambda m: (m[0] is not None, m[0] or 0, m[1]))
        trees[lang] = levels([m[1] for m in members])
    langs = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    top = levels([trees[x][-1][0] for x in langs])
    result, root = {}, top[-1][0]
    for at, lang in enumerate(langs):
        for place, (doc_id, own, n, other) in enumerate(by[lang]):
            digest, siblings = up(trees[lang], place, other, [])
            digest, siblings = up(top, at, digest, siblings)
            key = n if doc_id is None else doc_id
            result[key] = (own, trees[lang][-1][0], root, sha("".join(siblings)), digest, digest == root)
    return result


def trie(rows):
    """All nodes of the conversation trie for rows (conv, turn, role, text), in the order of the query's columns."""
    own = {}
    for conv, turn, role, text in rows:
        if conv is None:
            continue
        role, text = role or "", text or ""
        content = sha(f"{len(role.encode())}:{role}{text}")[:32]
        own.setdefault(conv, []).append((turn is not None, turn or 0, content, role, text))
    for turns in own.values():
        turns.sort()
    nodes, ends = {}, {}
    for conv, turns in own.items():
        h = zlib.crc32(str(conv).encode()) % 6
        base = conv - int(math.fmod(conv, 100))
        path = [t[3:] for t in own.get(base, [])[:h] + turns[h:]]
        for d in range(len(path) + 1):
            nodes.setdefault(tuple(path[:d]), []).append(conv)
        ends.setdefault(tuple(path), []).append(conv)
    children, leaves, saved = Counter(), Counter(), Counter()
    for path in nodes:
        if path:
            children[path[:-1]] += 1
    for path, members in nodes.items():
        for d in range(len(path) + 1):
            saved[path[:d]] += (len(members) - 1) * (len(path[-1][1]) if path else 0)
            leaves[path[:d]] += not children[path]
    return [
        (min(m), len(p), min(nodes[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p],
         sha(",".join(map(str, sorted(ends.get(p, []))))))
        for p, m in nodes.items()
    ]
