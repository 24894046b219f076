"""Plain Python forms of the metrics, for comparison on small inputs."""

import math
import re
from collections import Counter

from folioscore.functions.normalize import STRIP_GROUPS, WS, WS_IN_LINE


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b, 1):
            new.append(row[j - 1] + 1 if x == y else max(row[j], new[-1]))
        row = new
    return row[-1]


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def overlap(a, b):
    x, y = set(a.lower().split()), set(b.lower().split())
    return len(x & y) / len(x | y) if x | y else 0.0


def cosine(a, b):
    x = Counter(re.findall(r"\b\w\w+\b", a.lower()))
    y = Counter(re.findall(r"\b\w\w+\b", b.lower()))

    def weight(t):
        return math.log(3 / (1 + (t in x) + (t in y))) + 1

    dot = sum(x[t] * y[t] * weight(t) ** 2 for t in x.keys() & y.keys())
    norms = [math.sqrt(sum((n * weight(t)) ** 2 for t, n in c.items())) for c in (x, y)]
    return dot / (norms[0] * norms[1]) if all(norms) else 0.0


def rouge_words(t):
    return [w for s in t.split(".") for w in s.split()]


def f_score(both, n1, n2):
    if not n1 or not n2:
        return 0.0
    p, r = both / n1, both / n2
    return 2 * p * r / (p + r + 1e-8)


def rouge_n(a, b, n):
    x, y = rouge_words(a), rouge_words(b)
    g, h = ({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} for w in (x, y))
    return f_score(len(g & h), len(g), len(h))


def rouge_l(a, b):
    x, y = rouge_words(a), rouge_words(b)
    return f_score(lcs(x, y), len(x), len(y))


def traced(x, y):
    table = {(i, j): 0 for i in range(len(x) + 1) for j in range(len(y) + 1)}
    for i in range(1, len(x) + 1):
        for j in range(1, len(y) + 1):
            table[i, j] = (
                table[i - 1, j - 1] + 1
                if x[i - 1] == y[j - 1]
                else max(table[i - 1, j], table[i, j - 1])
            )
    out, i, j = set(), len(x), len(y)
    while i and j:
        if x[i - 1] == y[j - 1]:
            out.add(x[i - 1])
            i, j = i - 1, j - 1
        elif table[i - 1, j] > table[i, j - 1]:
            i -= 1
        else:
            j -= 1
    return out


def rouge_l_union(a, b):
    x, y = ([s.split() for s in t.split(".") if s.split()] for t in (a, b))
    union = set().union(*(traced(r, e) for r in y for e in x))
    return f_score(len(union), len(set(rouge_words(a))), len(set(rouge_words(b))))


def ratio(a, b):
    return 2 * lcs(a, b) / (len(a) + len(b)) if a or b else 1.0


def scores(a, b):
    return {
        "word_overlap": overlap(a, b),
        "levenshtein": ratio(a, b),
        "cosine": cosine(a, b),
        "rouge_1": rouge_n(a, b, 1),
        "rouge_2": rouge_n(a, b, 2),
        "rouge_l": rouge_l(a, b),
        "rouge_l_union": rouge_l_union(a, b),
    }


def strip(text):
    """The rules by Python's own engine, whose classes are Unicode already."""
    for _, rules in STRIP_GROUPS:
        for pattern, replacement in rules:
            flags = 0
            for head in ("(?dUm)", "(?U)", "(?d)", "(?s)"):
                if pattern.startswith(head):
                    pattern = pattern[len(head) :]
                    flags = {"(?dUm)": re.M, "(?s)": re.S}.get(head, 0)
            pattern = pattern.replace(WS_IN_LINE, r"[^\S\n]").replace(WS, r"\s")
            pattern = pattern.replace(r"[-:|\s\x1c-\x1f]", r"[-:|\s]")
            pattern = pattern.replace(r"[^\p{L}\p{N}_\s\x1c-\x1f]", r"[^\w\s]")
            text = re.sub(pattern, replacement.replace("$1", r"\1"), text, flags=flags)
    return text.strip()
