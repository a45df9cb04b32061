"""Plain Python versions of the operators, for small inputs."""

import collections
import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def repeats(rows, length=50):
    """(doc_id, n_bytes, n_removed, n_spans, sha256) of each (doc_id, text); a null id is larger than all."""
    big = 1 << 62
    first = {}
    key = lambda d: big if d is None else d
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - length + 1):
            s = b[i : i + length]
            first[s] = min(first.get(s, big), key(d))
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if first[b[i : i + length]] < key(d):
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return out


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    if not w:
        return set()
    return {tuple(w)} if len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def near(rows):
    """doc_id to (number of shingles, component), over rows with distinct doc_ids."""
    sets = {d: shingles(t) for d, t in rows}
    of = {d: d for d in sets}

    def root(d):
        while of[d] != d:
            of[d] = of[of[d]]
            d = of[d]
        return d

    where = collections.defaultdict(list)
    for d, s in sets.items():
        for x in s:
            where[x].append(d)
    both = collections.Counter()
    for ds in where.values():
        for i, a in enumerate(ds):
            for b in ds[i + 1 :]:
                both[min(a, b), max(a, b)] += 1
    for (a, b), n in both.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            a, b = root(a), root(b)
            of[max(a, b)] = min(a, b)
    return {d: (len(s), root(d)) for d, s in sets.items()}


def lines(rows, least):
    """Rows (doc_id, text, source, ...) without lines that stand on ``least`` sources, save in the smallest doc_id."""
    sites, first = collections.defaultdict(set), {}
    for d, t, s, *_ in rows:
        for x in (t or "").split("\n"):
            if k := x.strip(" \t\n\v\f\r"):
                sites[k].add(s)
                first[k] = min(first.get(k, float("inf")), float("inf") if d is None else d)
    out = []
    for d, t, s, *more in rows:
        keep = [x for x in (t or "").split("\n") if not ((k := x.strip(" \t\n\v\f\r")) and len(sites[k]) >= least and d != first[k])]
        out.append((d, None if t is None else "\n".join(keep), s, *more))
    return out


def targets(sizes, share=1.5, most=2):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, free, left = dict.fromkeys(names, 0.0), set(names), share * sum(sizes.values())
    while free and left > 1e-9:
        total = sum(w[s] for s in free)
        over = [s for s in free if left * w[s] / total >= most * sizes[s]]
        if not over:
            for s in free:
                target[s] = left * w[s] / total
            break
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
            free.discard(s)
    return target


def mixed(rows):
    """A Counter of the rows (doc_id, text, source, ...) that the mix emits."""
    sizes = collections.Counter()
    for _, t, s, *_ in rows:
        sizes[s] += len(WORD.findall(t or ""))
    want, out = targets(sizes), collections.Counter()
    for row in rows:
        rate = want[row[2]] / sizes[row[2]] if sizes[row[2]] else 0
        dice = int(hashlib.md5(f"mix-1|{'' if row[0] is None else row[0]}".encode()).hexdigest()[:8], 16) / 2**32
        out[row] += int(rate) + (dice < rate - int(rate))
    return +out
