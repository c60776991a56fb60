"""Plain Python versions of the contracts, one text at a time."""

import hashlib
import re
from collections import Counter


def luhn(s):
    d = [int(c) for c in s if c.isdigit()][::-1]
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(d)) % 10 == 0


def digits(s):
    return sum(c in "0123456789" for c in s)


KINDS = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda s: 14 <= digits(s) <= 19 and luhn(s)),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 10 <= digits(s) <= 15),
}


def base_spans(text):
    text = text or ""
    out = []
    for rank, (kind, (pattern, ok)) in enumerate(KINDS.items()):
        out += [(m.start(), rank, kind, m.end()) for m in re.finditer(pattern, text) if ok(m[0])]
    out.sort()
    counts = Counter(x[2] for x in out)
    joined = ",".join(f"{k}:{s}:{e}" for s, _, k, e in out)
    return [counts[k] for k in KINDS], joined, hashlib.sha256(joined.encode()).hexdigest()


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def word_statistics(text):
    text = text or ""
    w = words(text)
    tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(tri)
    hit = set()
    for i, x in enumerate(tri):
        if n[x] > 1:
            hit |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if words(x)]
    return {
        "n_words": len(w),
        "word_chars": sum(map(len, w)),
        "n_symbols": sum(c in "#*$%&|<>" for c in text),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(hit),
    }
