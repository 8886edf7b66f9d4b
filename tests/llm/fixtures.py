"""Small tables of hard cases, and brute-force versions."""

import random
import re

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, data string, name int, _dropped_id string"


def rows(seed=3, n=60):
    """Texts with nulls, empty and blank ones, copies, near copies, a long one, repeated passages, ties and repeated rows."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeéüß漢") for _ in range(r.randint(1, 6)))
    base = [" ".join(word() for _ in range(r.randint(30, 200))) for _ in range(12)]
    passage = " ".join(word() for _ in range(120))
    texts = [None, "", " \n\t ", "one", "One", "one two", "a " * 700, "x" * 900, None, ""]
    for _ in range(n):
        t = r.choice(base).split(" ")
        for _ in range(r.choice([0, 0, 1, 3, 8])):
            t[r.randrange(len(t))] = word()
        if r.random() < 0.2:
            t[5:5] = passage.split(" ")
        texts.append(" ".join(t) + r.choice(["", "", ".", " "]))
    texts.append(" ".join(word() for _ in range(20_000)))
    out = [(i, t, "en", f"s{i % 3}", len(t or ""), "x", i, None) for i, t in enumerate(texts)]
    out.append((3, "another text with id three", "en", "s", None, None, None, None))
    out.append(out[20])
    out.append((None, base[0], None, None, None, None, None, None))
    out.append((None, None, None, None, None, None, None, None))
    r.shuffle(out)
    return out


def words(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lowered)


def shingles(text, k):
    w = words(text)
    if not w:
        return frozenset()
    return frozenset([tuple(w)] if len(w) < k else (tuple(w[i : i + k]) for i in range(len(w) - k + 1)))


def near(table, k, percent=80):
    """{row number: smallest doc_id that can be reached}, by comparing all pairs."""
    sets = [shingles(t, k) for _, t in table]
    root = list(range(len(table)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(table)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i]) * 100 >= percent * len(sets[j]) and len(sets[j]) * 100 >= percent * len(sets[i]):
                same = len(sets[i] & sets[j])
                if 100 * same >= percent * (len(sets[i]) + len(sets[j]) - same):
                    root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(table):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return {i: least.get(find(i)) for i in range(len(table))}, [len(s) for s in sets]
