"""Small documents with every awkward case, and brute-force versions to compare with."""

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BLANKS = " \t\n\x0b\x0c\r"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def shingles(text, size):
    words = WORD.findall(lower(text or ""))
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def line_dedup(docs):
    """(doc_id, n_lines, n_dropped, kept text) of (doc_id, text) with distinct ids."""
    first = {}
    for doc_id, text in sorted(docs):
        for line in (text or "").split("\n"):
            key = lower(line.strip(BLANKS))
            if len(key) >= 10:
                first.setdefault(key, doc_id)
    out = set()
    for doc_id, text in docs:
        lines = (text or "").split("\n")
        kept = [x for x in lines if first.get(lower(x.strip(BLANKS)), doc_id) == doc_id]
        out.add((doc_id, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def near_groups(docs, size):
    """doc_id -> smallest doc_id reachable over links of Jaccard similarity 0.8 or more."""
    sets = {i: shingles(t, size) for i, t in docs}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            common = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * common >= 80 * (len(sets[i]) + len(sets[j]) - common):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in ids}


def frame(spark, docs):
    """docs with columns whose names the operators use themselves."""
    rows = [(i, t, "en", "s", None if t is None else len(t), "x", 1) for i, t in docs]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key string, n long")


AWKWARD = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "Ünïcödé 日本語 🙂 ok"), (6, "a" * 5000), (7, "word " * 3000), (8, "same line of text\nsame line of text\nx"), (9, "SAME line of text \nother line here"), (10, "{}[]()!?")]
