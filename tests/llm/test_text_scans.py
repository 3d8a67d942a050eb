import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from stackloom.llm import language as L
from stackloom.llm import secrets as X
from stackloom.llm import decontaminate as D
from stackloom.llm import licenses as W
from stackloom.llm import shingles as S
from stackloom.llm.decontaminate import find_leaks
from stackloom.llm.licenses import TEMPLATES, scan_licenses
from tests.llm.helpers import awkward_rows, documents, prose


def test_incremental_entropy_is_entropy():
    text = "aZ09aZ09bcdefghijklmnopqrstuvwxyz0123"
    for i, bits in enumerate(X.windows_entropy(text)):
        counts = Counter(text[i : i + X.WINDOW]).values()
        assert abs(bits + sum(c / X.WINDOW * math.log2(c / X.WINDOW) for c in counts)) < 1e-9


def test_secrets_on_whole_texts(spark):
    rng = random.Random(3)
    noise = prose(rng, 30_000)
    planted = [
        (300, noise + " password: hunter2hunter2 " + noise, "assign"),
        (301, "é漢🎈 Api_Key = 'abcdEFGH0123' tail", "assign"),
        (302, noise + "AKIAABCDEFGHIJKLMN", "access"),
        (303, "x0123456789abcdefz", "hex"),
        (304, "blob Zx9Qw3Er7Ty1Ui5Op8As2Df6Gh4Jk0 end", "entropy"),
    ]
    planted += [(305, "in config/prod/wJalrXUtnF3MI/K7MD3NG/bPxRfiCY9X4MPL3KQY1 now", "entropy"), (306, "see https://h.example/q/Zx9Qw3Er7Ty1Ui5Op8As2Df6Gh4Jk0", "entropy")]
    clean = [(320, "src/main/java/org/apache/commons/lang3/StringUtils"), (321, "user_account_settings_2024_final_version_v2"), (322, "id 123e4567-e89b-12d3-a456-426614174000."), (323, "Rindfleischetikettierungsgesetz getElementsByClassNameAndTag"), (310, "token: short"), (311, "AKIASHORT"), (312, "0123456789abcde"), (313, "https://a.sub.net/path/2024/articles/about-us-and-our-friends-of-old"), (314, "ſecret=abcdefghijklmnop"), (315, "password=secret: abcdefghijklmnop")]
    rows = awkward_rows() + [(i, t, "en", "a") for i, t, _ in planted] + [(i, t, "en", "a") for i, t in clean]
    texts = {i: t or "" for i, t, *_ in rows}
    out = X.scan_secrets(documents(spark, rows)).collect()
    assert len(out) == len(rows)
    got = {r.doc_id: r.spans for r in out}
    for i, text in texts.items():
        want = sorted(X.base_spans(text), key=lambda s: (s[0], X.KINDS.index(s[2])))
        assert [(s.start, s.end, s.kind) for s in got[i] if s.kind != "entropy"] == want
    for i, text, kind in planted:
        assert any(s.kind == kind for s in got[i]), (i, got[i])
    for i, _ in clean:
        assert got[i] == [], (i, got[i])
    a = next(s for s in got[301] if s.kind == "assign")
    assert texts[301][a.start : a.end] == "Api_Key = 'abcdEFGH0123"
    assert X.joined_spans([("hex", 1, 17)]) == "hex:1:17"


def test_secrets_of_adjacent_texts(spark):
    rng = random.Random(4)
    draw = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    token = "ABCDEFGHJKLMNPQRSTUVWXYZabcdefghjkmnpqrstuvwxyz23456789"
    texts = ["0123456789abcdef" * 2] * 5 + [draw("0123456789abcdef", 40) for _ in range(20)] + [draw(token, 48) for _ in range(20)]
    texts += ["ends in abc", draw("0123456789abcdef", 16), "", None, draw("0123456789abcdef", 16), "plain word", draw(token, 60), "AK", "IAABCDEFGHIJKLMNOP"]
    rng.shuffle(texts)
    rows = [(i, t, "en", "a") for i, t in enumerate(texts)]
    together = {r.doc_id: r.spans for r in X.scan_secrets(documents(spark, rows).coalesce(1)).collect()}
    allowed = re.compile("|".join(X.ALLOWED).replace("(?i)", ""), re.IGNORECASE)
    for i, text in enumerate(texts):
        alone = X.base_spans(text or "") + [(a, b, "entropy") for a, b in X.entropy_spans(text or "", allowed)]
        assert [(s.start, s.end, s.kind) for s in together[i]] == sorted(alone, key=lambda s: (s[0], X.KINDS.index(s[2]), s[1])), text


def test_random_keys_are_found():
    """Keys drawn at random, of several lengths and alphabets, alone and behind a path."""
    rng, allowed = random.Random(14), re.compile("|".join(X.ALLOWED).replace("(?i)", ""), re.IGNORECASE)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
    for alphabet, least in ((letters + "0123456789", 0.95), (letters + "0123456789+/", 0.9), (letters, 0.9)):
        for n in (20, 32, 40, 64):
            keys = ["".join(rng.choice(alphabet) for _ in range(n)) for _ in range(300)]
            assert sum(bool(X.entropy_spans(f"a {k} b", allowed)) for k in keys) >= least * 300, (alphabet, n)
            assert sum(bool(X.entropy_spans(f"config/prod/{k}", allowed)) for k in keys) >= least * 300, (alphabet, n)


def test_language_accuracy_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = L.held_out(docs["doc_id"])
    model = L.train(docs.filter(~out))
    held = L.predict(docs.filter(out), model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert held and sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in held)


def test_language_of_awkward_rows(spark):
    rows = awkward_rows()
    model = L.train(documents(spark, rows))
    out = L.predict(documents(spark, rows), model).collect()
    assert len(out) == len(rows)
    for r in out:
        text = next(t for i, t, *_ in rows if i == r.doc_id)
        if not re.search(r"[^\W\d_]", text or ""):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        else:
            assert r.lang_pred in model.langs
    nothing = L.train(documents(spark, [(1, "some text", None, "a")]))
    assert [r.lang_pred for r in L.predict(documents(spark, rows[:3]), nothing).collect()] == ["und"] * 3
    assert L.predict(documents(spark, []), model).collect() == []


def test_filter_with_more_than_64_languages():
    rng = np.random.default_rng(1)
    grams = {f"l{i:03}": rng.integers(0, 2**32, 50) for i in range(70)}
    model = L.Filter(sorted(grams), grams)
    shares = model.shares(grams["l069"].astype(np.uint32), np.array([50, 0]))
    assert shares[0].argmax() == 69 and shares[0, 69] > 0.99 and shares[1].max() == 0


def brute_leaks(text, item, k=5, least=0.8):
    words = lambda t: re.findall(r"[a-z0-9\x80-\U0010ffff]+", t.lower())

    def bag(ws):
        parts = [tuple(ws[i : i + k]) for i in range(max(1, len(ws) - k + 1))]
        out = Counter()
        for p in parts:
            out[p] += sum(len(w.encode()) for w in p)
        return out

    own, want = words(text or ""), words(item)
    best = 0.0
    if own and want:
        if len(want) < k:  # exactly these words in a row
            return float(any(own[i : i + len(want)] == want for i in range(len(own))))
        if len(own) < k:
            return 0.0
        target = bag(want)
        span = min(len(want), len(own))
        for at in range(len(own) - span + 1):
            b = bag(own[at : at + span])
            both = sum(min(b[s], target[s]) for s in b if s in target)
            best = max(best, both / (sum(b.values()) + sum(target.values()) - both))
    return best if best >= least else 0.0


def test_leaks_match_brute_force(spark):
    rng = random.Random(12)
    items = [(i, prose(rng, rng.randrange(12, 50), 3000)) for i in range(12)] + [(50, "tiny item"), (53, "Item"), (54, "a tiny item, HERE"), (51, ""), (52, None), (None, "no id but words")]
    rows = [r for r in awkward_rows() if r[0] != 206]
    for i, text in items[:12]:
        words = text.split(" ")
        rows.append((400 + i, prose(rng, 40) + "\n" + text.upper().replace(" ", ",  ") + "! " + prose(rng, 30), "en", "a"))
        rows.append((450 + i, prose(rng, 20) + " " + " ".join(words[:-1] + ["other"]) + " " + prose(rng, 9), "en", "a"))
        rows.append((500 + i, prose(rng, 20) + " " + " ".join(words[: len(words) // 2]) + " " + prose(rng, 20), "en", "a"))
    rows += [(600, "a tiny item here", "en", "a"), (601, "Tiny, ITEM!", "en", "a")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in find_leaks(documents(spark, rows), bench).collect()}
    want = {(d, i): s for d, t, *_ in rows for i, item in items if i is not None and item and (s := brute_leaks(t, item))}
    assert {k: round(v, 9) for k, v in got.items()} == {k: round(v, 9) for k, v in want.items()}
    assert sum(d in range(400, 412) for d, _ in got) == 12 and not any(d in range(500, 512) for d, _ in got)


def test_leaks_come_from_the_multi_index(monkeypatch):
    """Without candidates from the fingerprints nothing is found, and the blocks lose no pair."""
    rng = random.Random(3)
    texts = [prose(rng, rng.randrange(10, 60), 3000) for _ in range(150)]
    items = D.Items(list(range(150)), texts, 5, 0.8)
    own, weights, counts, words, *_ = D._weigh(*S.texts_of(pa.array([" ".join(texts[:40])])), 5)
    found = items.find(own, weights, items.known(own), int(words[0]))
    assert set(range(40)) <= set(found)
    prints = np.random.default_rng(4).integers(0, 256, (300, D.BITS // 8), dtype=np.uint8)
    for length, (index, _) in items.of_length.items():
        near = items.prints[index][:, None] ^ np.packbits(np.random.default_rng(length).random((len(index), 50, D.BITS)) < 0.25, axis=2)
        for probes in (prints, near.reshape(-1, D.BITS // 8)):
            window, item = items.within(length, probes)
            away = np.bitwise_count(probes[:, None] ^ items.prints[index]).sum(axis=2)
            assert sorted(zip(window.tolist(), item.tolist(), strict=True)) == sorted((int(w), int(index[i])) for w, i in zip(*np.nonzero(away <= D.RADIUS), strict=True))
    monkeypatch.setattr(D.Items, "within", lambda self, length, prints: (np.zeros(0, int), np.zeros(0, int)))
    assert items.find(own, weights, items.known(own), int(words[0])) == {}


def test_similar_windows_lie_within_the_radius():
    """Bags at similarity 0.8 to 0.85: the share beyond the radius is far below a thousandth."""
    rng = np.random.default_rng(8)
    beyond = trials = 0
    for _ in range(6000):
        n = int(rng.integers(10, 120))
        other = max(1, int(n * 0.1))
        hashes, weights = rng.integers(0, 2**63, n + other, dtype=np.uint64), rng.integers(15, 45, n + other)
        a, b = slice(0, n), slice(other, n + other)
        score = D.similarity(D._bag(hashes[a], weights[a]), D._bag(hashes[b], weights[b]))
        if 0.8 <= score < 0.85:
            trials += 1
            beyond += int(np.bitwise_count(D.simhash(hashes[a], weights[a]) ^ D.simhash(hashes[b], weights[b])).sum() > D.RADIUS)
    assert trials > 2000 and beyond <= 1, (beyond, trials)


def test_window_fingerprints_are_those_of_the_windows(monkeypatch):
    rng = np.random.default_rng(2)
    hashes, weights = rng.integers(0, 2**63, 400, dtype=np.uint64), rng.integers(1, 60, 400)
    monkeypatch.setattr(D, "PIECE", 37)
    starts = np.flatnonzero(rng.random(380) < 0.4)
    for at, prints in D.window_simhashes(hashes, weights, starts, 20):
        for i, p in zip(at.tolist(), prints, strict=True):
            assert (p == D.simhash(hashes[i : i + 20], weights[i : i + 20])).all()


def test_leak_spans_are_code_points(spark):
    item = "where does the quick brown fox sleep at night"
    text = "漢字 É🎈. Where does the quick brown fox sleep at night? Nowhere."
    r = find_leaks(documents(spark, [(1, text, "en", "a")]), spark.createDataFrame([(7, item)], "item_id long, text string")).first()
    assert text[r.start : r.end].lower() == item and r.similarity == 1.0
    assert find_leaks(documents(spark, []), spark.createDataFrame([(7, item)], "item_id long, text string")).collect() == []
    assert find_leaks(documents(spark, [(1, text, "en", "a")]), spark.createDataFrame([], "item_id long, text string")).collect() == []


def test_licenses_are_told_apart(spark):
    rng = random.Random(5)
    rows = awkward_rows()
    for i, t in enumerate(TEMPLATES):
        rows.append((700 + i, prose(rng, 300) + "\n" + t.text + "\n" + prose(rng, 300), "en", "a"))
        rows.append((800 + i, prose(rng, 600) + " " + t.text.upper().replace(" ", "  ") + " " + prose(rng, 600), "en", "a"))
    rows += [(900, "You need a driving license to drive. A license plate is not enough.", "en", "a"), (901, "Licensed under the Apache License, Version 1.0.", "en", "a")]
    got = {}
    for r in scan_licenses(documents(spark, rows)).collect():
        got.setdefault(r.doc_id, set()).add(r.license)
    for i, t in enumerate(TEMPLATES):
        assert got.get(700 + i) == {t.license}, (t, got.get(700 + i))
        assert got.get(800 + i) == {t.license}, (t, got.get(800 + i))
    assert 900 not in got and 901 not in got and not any(i is None or i < 300 for i in got)
    assert scan_licenses(documents(spark, [])).collect() == []


MIT = """The software

Copyright (c) 2020 Somebody

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY.
"""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
{}
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED.
"""
NAMES = """
3. Neither the name of the copyright holder nor the names of its contributors
   may be used to endorse or promote products derived from this software
   without specific prior written permission.
"""


def test_licenses_as_they_are_laid_out(spark):
    rng = random.Random(6)
    commented = lambda t: "\n".join(" * " + line for line in t.split("\n"))
    notices = [
        (MIT, ["MIT"]),
        (commented(MIT), ["MIT"]),
        (MIT.replace("free of charge", "at no cost").replace("\n", "\r\n"), ["MIT"]),
        (MIT + "\n" + MIT, ["MIT", "MIT"]),
        (BSD.format(""), ["BSD-2-Clause"]),
        (BSD.format(NAMES), ["BSD-3-Clause"]),
        (commented(BSD.format(NAMES)), ["BSD-3-Clause"]),
        ("Licensed under the MIT License.", ["MIT"]),
        ("Distributed under the\nMIT License", ["MIT"]),
        ("Available under the Apache License, Version 2.0, see below.", ["Apache-2.0"]),
        ("// SPDX-License-Identifier: GPL-2.0-or-later", ["GPL-2.0"]),
        (TEMPLATES[4].text.replace("License. You", "License.\n\nYou").replace("http", "\n\n    http").replace("Unless", "\n\nUnless"), ["Apache-2.0"]),
        (MIT[:600], []),
        ("Licensed under the NIT License.", []),
    ]
    rows = [(i, prose(rng, 200) + "\n\n" + text + "\n\n" + prose(rng, 200), "en", "a") for i, (text, _) in enumerate(notices)]
    got = {i: [] for i in range(len(notices))}
    for r in sorted(scan_licenses(documents(spark, rows)).collect(), key=lambda r: r.start):
        got[r.doc_id].append(r.license)
    assert got == {i: want for i, (_, want) in enumerate(notices)}


def brute_licenses(text, templates):
    """Every run of words up to the reach of a copy, aligned with every template: the licenses of
    the runs that confirm one, of overlapping runs the one with the longest template."""
    own, found = W.words_of(text), []
    for i, t in enumerate(templates):
        want, needs = W.words_of(t.text), set(t.needs)
        reach = math.ceil(len(want) / (1 - W.OTHER))
        for at in range(len(own)):
            block = own[at : at + reach]
            if len(set(block) & set(want)) >= W.FOUND * len(set(want)):
                share, other, first, last = W.wording(want, block)
                if share >= W.FOUND and other <= W.OTHER and needs <= set(block[first:last]):
                    found.append((-share * len(want), other, at + first, at + last, t.license))
    kept = []
    for row in sorted(found):
        if all(row[3] <= k[2] or row[2] >= k[3] for k in kept):
            kept.append(row)
    return sorted(k[4] for k in kept)


def test_licenses_match_brute_force():
    rng = random.Random(11)
    scanner = W.Scanner(TEMPLATES)
    for n in range(120):
        parts = []
        for t in rng.sample(TEMPLATES, rng.randrange(0, 3)):
            words = t.text.split(" ")
            for _ in range(rng.choice((0, 0, 1, 2, len(words) // 4))):
                at = rng.randrange(len(words))
                words[at : at + rng.randrange(0, 2)] = rng.choice((["or"], ["the", "said"], []))
            parts.append(" ".join(words))
        text = f" {prose(rng, 40)}\n".join(["", *parts, ""])
        got = scanner.scan(text)
        assert sorted(r["license"] for r in got) == brute_licenses(text, TEMPLATES), (n, text, got)


def test_licenses_come_from_compression(monkeypatch):
    """Without what compression saves nothing is found; and a text of no listed wording is reached."""
    text = "x y z " + BSD.format("").replace("Redistribution and use", "Redistribution or use") + " tail"
    assert [r["license"] for r in W.Scanner(TEMPLATES).scan(text)] == ["BSD-2-Clause"]
    assert re.search(W.trigger_pattern(TEMPLATES), text)
    scanner = W.Scanner(TEMPLATES)
    monkeypatch.setattr(scanner, "saved", lambda words, i: 0)
    assert scanner.scan(text) == []
    backwards = W.Scanner(TEMPLATES)  # the ranking decides: turned round, the shorter template wins
    monkeypatch.setattr(backwards, "saved", lambda words, i, own=backwards.saved: 10_000 - own(words, i))
    full = TEMPLATES[4].text
    assert W.Scanner(TEMPLATES).scan(full)[0]["end"] > backwards.scan(full)[0]["end"]


def test_whole_license_texts_from_a_folder(spark, tmp_path):
    rng = random.Random(2)
    for name in ("One", "Two"):
        (tmp_path / name).write_text("\n\n".join(prose(rng, 200, 900) for _ in range(6)))
    templates = W.templates_in(str(tmp_path))
    copied = templates[0].text.split(" ")
    for at in rng.sample(range(len(copied)), 60):
        copied[at] = "changed"
    rows = [(1, prose(rng, 300) + "\n" + " ".join(copied) + "\n" + prose(rng, 300), "en", "a"), (2, templates[1].text[:2000], "en", "a"), (3, prose(rng, 2000, 900), "en", "a"), (4, templates[1].text.upper(), "en", "a")]
    assert sorted((r.doc_id, r.license) for r in scan_licenses(documents(spark, rows), templates=templates).collect()) == [(1, "One"), (4, "Two")]
