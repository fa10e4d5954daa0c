"""Small tables with every case that an operator must define."""

import re

DOCS = "doc_id long, text string, lang string, source string, n_chars long, Text string, class string, n long, key string, component string"
WORDS = "the quick brown fox jumps over a lazy dog while seven wizards quietly box with jugs of liquor near twelve pale zebras and nine cold owls".split()


def prose(seed: int, n: int) -> str:
    """Deterministic words that hardly repeat in another seed's order."""
    x, out = seed * 7919 + 13, []
    for _ in range(n):
        x = (x * 1103515245 + 12345) % (1 << 31)
        out.append(WORDS[(x >> 8) % len(WORDS)] + str((x >> 16) % 97))
    return " ".join(out)


def base_rows() -> list[tuple]:
    long = prose(1, 20000)
    near = prose(2, 300).split(" ")
    texts = [
        (1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, "one two three four"), (6, "One  TWO three four"), (7, long), (8, long + " tail"),
        (9, " ".join(near)), (10, " ".join([*near[:100], "CHANGED", *near[101:]])), (11, " ".join(near[:150])), (12, prose(3, 60)), (13, prose(3, 60)),
        (None, prose(4, 50)), (None, None), (14, "é ü 你好 \U0001f600 mixed <|endoftext|> text's end."), (14, "same id other text here now"), (12, prose(3, 60)), (15, "12345 67890 !!! ---"),
    ]
    return [(i, t, "en" if (i or 0) % 2 else None, f"s{(i or 0) % 3}" if i != 5 else None, len(t or ""), "clash", "c", 1, "k", "x") for i, t in texts]


def frame(spark, rows=None):
    return spark.createDataFrame(base_rows() if rows is None else rows, DOCS)


def lower(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def shingle_set(text) -> set:
    w = re.findall("[^\x20\x09-\x0d]+", lower(text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def jaccard_components(rows: list[tuple]) -> list[tuple]:
    """(doc_id, size, component) by comparing all pairs."""
    sets = [(i, shingle_set(t)) for i, t in rows]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                root[find(a)] = find(b)
    out = []
    for k, (i, s) in enumerate(sets):
        ids = [sets[j][0] for j in range(len(sets)) if find(j) == find(k) and sets[j][0] is not None] if s else [i]
        out.append((i, len(s), min(ids) if ids and ids[0] is not None else None))
    return out


def line_keys(text) -> list[tuple]:
    """(line number, masked line, the line's own key) of each line that isn't blank, the key of the tree's way."""
    out = []
    for i, line in enumerate((text or "").split("\n")):
        tokens = ["<*>" if re.search("[0-9]", t) else t for t in re.findall("[^ \t\r]+", line)]
        if tokens:
            constant = len(tokens) - " ".join(tokens).count("<*>")
            out.append((i, tuple(tokens), constant >= 4, ("masked", *tokens) if constant >= 4 else ("verbatim", line)))
    return out


def deduped(rows: list[tuple]) -> list[tuple]:
    """(doc_id, text) with the recurring lines gone, line by line from the definition; doc_ids are unique but for equal rows."""
    every = [(d, t, i, tokens, enough, own) for d, t in rows for i, tokens, enough, own in line_keys(t)]
    leaves: dict = {}
    for d, t, _, tokens, enough, own in every:
        if enough:
            leaves.setdefault((len(tokens), tokens[:3]), []).append((tokens, (d, t)))
    template: dict = {}
    for leaf, members in leaves.items():
        n: dict = {}
        for tokens, _ in members:
            n[tokens] = n.get(tokens, 0) + 1
        if len(n) < 2 or len({doc for _, doc in members}) < 2:
            continue
        size, shape = leaf[0], []
        for at in range(size):
            votes: dict = {}
            for tokens, m in n.items():
                votes[tokens[at]] = votes.get(tokens[at], 0) + m
            top = max(votes, key=lambda x: (votes[x], x.encode()))
            shape.append(top if 2 * votes[top] > len(members) else "<*>")
        constant = sum(x != "<*>" for x in shape)
        left = []
        for tokens in n:
            if constant >= 4 and 4 * constant >= 3 * size and 4 * sum(b == "<*>" or a == b for a, b in zip(tokens, shape)) >= 3 * size:
                template[tokens] = ("leaf", leaf)
            else:
                left.append(tokens)
        seen: dict = {}
        for tokens in left:
            for place in enumerate(tokens):
                seen[place] = seen.get(place, 0) + n[tokens]
        groups: dict = {}
        for tokens in left:
            v = [seen[p] if p[1] != "<*>" and seen[p] > 1 else 0 for p in enumerate(tokens)]
            q = sorted(v, reverse=True)[-(-3 * size // 4) - 1]
            kept = tuple(x if 2 * c > q else "<*>" for x, c in zip(tokens, v))
            if q > 1 and sum(x != "<*>" for x in kept) >= 4:
                groups.setdefault(kept, []).append(tokens)
        for kept, members in groups.items():
            if len(members) > 1:
                template.update({tokens: ("group", leaf, kept) for tokens in members})
    order = lambda d: (d is not None, d or 0)
    where: dict = {}
    for d, t, i, tokens, enough, own in every:
        where.setdefault(template.get(tokens, own) if enough else own, []).append((order(d), t, i))
    gone = set()
    for places in where.values():
        if len({p[:2] for p in places}) > 1:
            first = min(places)
            gone.update(p for p in places if p != first)
    return [(d, t if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if (order(d), t, i) not in gone)) for d, t in rows]
