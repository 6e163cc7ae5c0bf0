"""Plain versions of the operators' contracts, for small inputs."""

import hashlib


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def substring(docs, k=20):
    """docs: (doc_id, text) in order; doc_id, n_words, n_removed, kept_sha256."""
    seen, out = set(), []
    for doc_id, text in sorted(docs):
        words = (text or "").encode().split()
        gone = [False] * len(words)
        for i in range(len(words) - k + 1):
            w = tuple(words[i : i + k])
            if w in seen:
                gone[i : i + k] = [True] * k
            seen.add(w)
        out.append((doc_id, len(words), sum(gone), sha(b" ".join(w for w, g in zip(words, gone) if not g))))
    return out


def suffix(docs, k=200):
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    count = {}
    raws = [(d, (t or "").encode()) for d, t in docs]
    for _, raw in raws:
        for i in range(len(raw) - k + 1):
            w = hash(raw[i : i + k])
            count[w] = count.get(w, 0) + 1
    out = []
    for doc_id, raw in raws:
        last, gone = -1, bytearray(len(raw))
        for i in range(len(raw) - k + 1):
            if count[hash(raw[i : i + k])] > 1:
                a = max(i, last)
                gone[a : i + k] = b"\1" * (i + k - a)
                last = i + k
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((doc_id, len(raw), sum(gone), spans, sha(bytes(b for b, g in zip(raw, gone) if not g))))
    return out


def ngram_join(docs, k=3, percent=90):
    """doc_id, n_shingles, component_id, by all pairs."""
    sets = {}
    for doc_id, text in docs:
        words = (text or "").encode().lower().split()
        sets[doc_id] = {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)} if words else set()
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    where = {}
    for d, s in sets.items():
        for x in s:
            where.setdefault(x, []).append(d)
    for d, s in sets.items():
        shared = {}
        for x in s:
            for o in where[x]:
                if o < d:
                    shared[o] = shared.get(o, 0) + 1
        for o, both in shared.items():
            if 100 * both >= percent * (len(s) + len(sets[o]) - both):
                a, b = find(o), find(d)
                root[max(a, b)] = min(a, b)
    return [(d, len(s), find(d)) for d, s in sets.items()]
