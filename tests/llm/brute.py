"""Plain versions of the operators for small inputs, each from its definition."""

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def groups(n, links):
    """The least member of each one's component."""
    root = list(range(n))
    for a, b in links:
        if root[a] != root[b]:
            low, high = sorted((root[a], root[b]))
            root = [low if r == high else r for r in root]
    return root


def levenshtein(a, b):
    same = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    a, b = a[same:], b[same:]
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def common(a, b):
    same = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    a, b = a[same:], b[same:]
    tail = next((i for i, (x, y) in enumerate(zip(reversed(a), reversed(b))) if x != y), min(len(a), len(b)))
    return same + tail + _common(a[: len(a) - tail], b[: len(b) - tail])


def _common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b, 1):
            new.append(row[j - 1] + 1 if x == y else max(row[j], new[-1]))
        row = new
    return row[-1]


def shingles(text):
    words = WORD.findall(text or "")
    return [tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))] if words else []


def near_classes(docs, similarity=0.8):
    """{doc_id: class_id} of (doc_id, text) rows with distinct ids."""
    docs = sorted(docs)
    rows = [shingles(t) for _, t in docs]
    counts = [Counter(x) for x in rows]
    enough = lambda c, n: c >= similarity * (n - c) - 1e-9
    links = []
    for i, a in enumerate(rows):
        for j in range(i):
            b, n = rows[j], len(a) + len(rows[j])
            # no common subsequence is longer than what both hold in any order
            if a and b and enough((counts[i] & counts[j]).total(), n) and enough(common(a, b), n):
                links.append((j, i))
    return {docs[i][0]: docs[r][0] for i, r in enumerate(groups(len(docs), links))}


def lines_kept(docs, edits=2, min_chars=20):
    """{doc_id: (positions that stay among lines with a word, equal copies, near copies)}"""
    out, seen = {}, {}
    for doc, text in sorted(docs):
        keep, equal, near = [], 0, 0
        for pos, line in enumerate((text or "").split("\n")):
            if not WORD.search(line):
                continue
            if line in seen:
                equal += 1
                continue
            # an edit takes one character away and brings one at most
            letters = Counter(line)
            close = lambda s: len(s) >= min_chars and abs(len(s) - len(line)) <= edits and (seen[s] - letters).total() <= edits and levenshtein(s, line) <= edits
            if len(line) >= min_chars and any(map(close, seen)):
                near += 1
            else:
                keep.append(pos)
            seen[line] = letters
        out[doc] = (keep, equal, near)
    return out


def without_lines(doc, text, kept):
    if text is None:
        return None
    return "\n".join(line for pos, line in enumerate(text.split("\n")) if pos in kept[doc][0] or not WORD.search(line))


def without_repeats(texts, length=400):
    """(n_bytes, n_removed, n_spans, kept_sha256) of each text."""
    data = [(t or "").encode() for t in texts]
    count = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if count[d[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(d), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(d, gone) if not g)).hexdigest()))
    return out


def mix_targets(sizes, epochs=3):
    """{source: target}: shares by weight, and again for as long as a source lies above its bound."""
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    total, fixed = sum(sizes.values()), {}
    while True:
        open_ = [s for s in order if s not in fixed]
        level = (total - sum(fixed.values())) / max(1, sum(weight[s] for s in open_))
        over = [s for s in open_ if level * weight[s] > epochs * sizes[s]]
        if not over:
            return {s: float(fixed.get(s, level * weight[s])) for s in order}
        fixed |= {s: epochs * sizes[s] for s in over}


def mixed(docs, epochs=3):
    """[(doc_id, size, source_size, target, taken)] of (doc_id, source, text) rows with distinct ids."""
    size = {d: len(WORD.findall(t or "")) for d, _, t in docs}
    source = {d: s for d, s, _ in docs}
    sizes = defaultdict(int)
    for d, s in source.items():
        sizes[s] += size[d]
    target = mix_targets(sizes, epochs)
    rank = {s: k for k, s in enumerate(target)}
    key = {d: hashlib.md5(f"{d}:mix".encode()).hexdigest() for d in size}
    queue, upto = [], defaultdict(int)
    for e in range(epochs):
        for d in sorted(size, key=key.get):
            if size[d]:
                upto[source[d]] += size[d]
                queue.append((upto[source[d]] / target[source[d]], rank[source[d]], key[d], d))
    taken, total, budget = Counter(), 0, sum(size.values())
    for *_, d in sorted(queue):
        total += size[d]
        if total > budget:
            break
        taken[d] += size[d]
    return [(d, size[d], sizes[source[d]], target[source[d]], taken[d]) for d in size]


def quality_counts(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)"""
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    fives = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    count = Counter(fives)
    covered = {i + k for i, f in enumerate(fives) if count[f] > 1 for k in range(5)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)
