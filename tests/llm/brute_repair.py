"""A plain version of conversation repair: damage row by row, then the cheapest and least of all audits by search over prefixes."""

import hashlib
import heapq
import itertools
import zlib

WHITE = " \t\n\x0b\x0c\r"


def damaged(rows):
    """rows: (conv_id, turn, role, text) of one conversation; in order after damage."""
    out = []
    said = lambda x: " " if x is None else str(x)
    for conv, turn, role, text in rows:
        draw = zlib.crc32(f"{said(conv)}:{said(turn)}".encode()) % 20
        role, text = said(role), said(text)
        text = "" if draw == 1 else "".join(c for c in text if c not in ".!?") if draw == 2 else text
        role = "user" if draw == 4 else role
        out += [(turn, role, text)] * (0 if draw == 0 else 2 if draw == 3 else 1)
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))


def repaired(rows):
    """gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of one conversation after damage."""
    seen, faults = set(), []
    for _, role, text in rows:
        faults.append("blank" if not text.strip(WHITE) else "duplicate" if (role, text) in seen else "truncated" if text.rstrip(WHITE)[-1] not in ".!?" else "")
        seen.add((role, text))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    bad = sum(a[:1] + b[:1] not in ("su", "ua", "au") for (_, a, _), (_, b, _) in itertools.pairwise(rows))
    # Cheapest first, then the least audit: a state is settled once for each turn and last roles.
    legal = lambda said, i: said == "" and i in ("s", "u") or said == "s" and i == "u" or said == "a" and i == "u" or said == "u" and i == "a"
    heap, settled = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, at, last, done = heapq.heappop(heap)
        if at == len(rows) and last in ("", "a"):
            break
        if (at, last) in settled:
            continue
        settled.add((at, last))
        for role in ("user", "assistant"):
            if legal(last, role[0]):
                heapq.heappush(heap, (cost + 5, audit + "I", at, role[0], (*done, (role, ""))))
        if at < len(rows):
            _, role, text = rows[at]
            heapq.heappush(heap, (cost + 2, audit + "D", at + 1, last, done))
            if faults[at] not in ("blank", "duplicate"):
                more = 5 * (faults[at] == "truncated")
                if legal(last, role[:1]):
                    heapq.heappush(heap, (cost + more, audit + "K", at + 1, role[:1], (*done, (role, text))))
                for new in ("user", "assistant"):
                    if legal(last, new[0]):
                        heapq.heappush(heap, (cost + more + 1, audit + "R", at + 1, new[0], (*done, (new, text))))
    text = "\n".join(f"{r}:{t}" for r, t in done)
    return gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), bad, cost, audit, hashlib.sha256(text.encode()).hexdigest()
