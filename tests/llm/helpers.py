"""Documents with everything that may go wrong, and brute-force versions."""

import random
import re

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, size string, shard string, label long, copies string, n int, key string"


def prose(rng: random.Random, words: int, vocabulary: int = 400) -> str:
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(2 + w % 7)) for w in (rng.randrange(vocabulary) for _ in range(words)))


def documents(spark, rows):
    """rows: (doc_id, text, lang, source); the other columns clash with names inside operators."""
    return spark.createDataFrame([(i, t, lang, s, len(t or ""), "x", "y", "z", 7, "c", 3, "k") for i, t, lang, s in rows], DOC_SCHEMA)


def awkward_rows(seed: int = 1, n: int = 60):
    """Prose with nulls, empty and blank texts, ties, repeated rows, near copies and one long text."""
    rng = random.Random(seed)
    rows = [(i, prose(rng, rng.randrange(3, 120)), rng.choice(["en", "fr", None]), rng.choice(["a", "b", "b", "b", None])) for i in range(n)]
    base = prose(rng, 150)
    for i in range(n, n + 20):  # a hot group of copies and near copies
        words = base.split(" ")
        for _ in range(i % 4):
            words[rng.randrange(len(words))] = "changed"
        rows.append((i, " ".join(words), "en", "b"))
    rows += [(200, None, None, None), (201, "", "en", "a"), (202, " \t\n ", "en", "a"), (203, "one", "en", "a"), (204, "one", "fr", "c"), (205, "12 34 !!", None, "a"), (None, "no id here", "en", "a")]
    rows += [rows[0], rows[61], (206, prose(rng, 40_000), "en", "b"), (207, "É" * 3000 + " ß 漢字 🎈", "de", "a")]
    return rows


def shingle_set(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) >= k:
        return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}
    return {tuple(words)} if words else set()


def brute_components(rows, k, percent=80):
    sets = {i: shingle_set(t, k) for i, t, *_ in rows if i is not None}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i), root(i) == i) for i in ids}
