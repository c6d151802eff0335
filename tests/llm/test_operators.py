"""Operators against brute force, and what they make of nulls, empty texts, ties, repeats, empty tables and extra columns."""

import base64
import hashlib
import random
import re
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import tiktoken
import xxhash

from lodestone.llm import bpe, chat, common, contamination, exact, license_scan, lines, quality, queries, secret_scan, simhash, token_counts

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "long words repeat and " * 6000
ROWS = [
    (1, "One two three four five six seven.", "en", "a", 34),
    (2, None, None, None, None),
    (3, "", "en", "", 0),
    (4, " \t\n", "en", "a", 3),
    (5, "one TWO three four five six seven.", "de", "b", 34),
    (6, LONG, "en", "a", len(LONG)),
    (7, "É É é <s> [INST] <|endoftext|> \\ 漢字 🙂🙂", "fr", "a", 40),
    (7, "É É é <s> [INST] <|endoftext|> \\ 漢字 🙂🙂", "fr", "a", 40),
    (None, "One two three four five six seven.", "en", "a", 34),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ROWS, SCHEMA).selectExpr("*", "1 AS fp", "2 AS component_id", "3 AS digest", "4 AS host", "'x' AS kept", "0 AS line_no", "'w' AS w", "5 AS n")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


def roots(fps):
    """Component of each row by comparing all pairs."""
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


def plain_fingerprint(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    hs = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_simhash(docs):
    rows = docs.select("doc_id", "text").collect()
    fps = [plain_fingerprint(r[1]) for r in rows]
    least = defaultdict(lambda: 10**9)
    group = roots(fps)
    for r, g in zip(rows, group, strict=True):
        least[g] = min(least[g], r[0])
    want = {(r[0], f"{f:016x}", least[g]) for r, f, g in zip(rows, fps, group, strict=True)}
    assert {tuple(r) for r in simhash.near_duplicates(docs).collect()} == want


def test_simhash_odd(odd, none):
    got = [tuple(r) for r in simhash.near_duplicates(odd).collect()]
    assert len(got) == len(ROWS)
    by = {r[0]: r for r in got}
    assert by[2][1:] == by[3][1:] == by[4][1:] == ("0" * 16, 2)
    assert by[1][2] == by[5][2] == by[None][2] == 1 and sum(r[0] == 7 for r in got) == 2
    assert simhash.near_duplicates(none).count() == 0 and simhash.dedup(none).columns == none.columns
    assert sorted(str(r.doc_id) for r in simhash.dedup(odd).collect()) == ["1", "2", "6", "7", "7"] and simhash.dedup(odd).columns == odd.columns


def test_links_with_hot_buckets(spark, monkeypatch):
    r = random.Random(1)
    base = r.getrandbits(64)
    fps = {base ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 6))) for _ in range(300)} | {r.getrandbits(64) for _ in range(200)}
    signed = [(f - 2**64 if f >= 2**63 else f, i) for i, f in enumerate(sorted(fps))]
    table = spark.createDataFrame(signed, "fp long, node long")
    for hot in (20_000, 8):
        monkeypatch.setattr(simhash, "HOT_BUCKET", hot)
        found = {x["node"]: x["root"] for x in common.components(simhash.links(table)).collect()}
        group = roots(sorted(fps))
        assert len({(found.get(i, i), g) for i, g in enumerate(group)}) == len(set(group)) == len({found.get(i, i) for i in range(len(group))})


def test_components(spark):
    r = random.Random(3)
    edges = [(r.randrange(400), r.randrange(400)) for _ in range(250)] + [(i, i + 1) for i in range(1000, 1100)] + [(5000, i) for i in range(5001, 5200)] + [(9, 9)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {x["node"]: x["root"] for x in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for e in edges for x in e}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_exact(odd, none):
    got = {r[0]: tuple(r)[1:4] for r in exact.exact_duplicates(odd).collect()}
    assert got[1] == (1, 2, True) and got[None] == (1, 2, False) and got[7] == (7, 2, True)
    assert got[4] == (4, 3, True) and got[2] == got[3] == (4, 3, False)
    assert exact.exact_duplicates(none).count() == 0 and exact.dedup(odd).count() == 6 and exact.dedup(odd).columns == odd.columns


def test_contamination_odd(spark, odd, none):
    bench = spark.createDataFrame([(10, "TWO three four"), (11, None), (12, ""), (None, "one two"), (13, "é é É")], "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, list(r["items"]), r.contaminated) for r in contamination.scan(odd, bench).collect()}
    assert got[1] == got[5] == got[None] == (7, 3, ["10"], True)
    assert got[2] == got[3] == got[4] == (0, 0, [], False) and got[7][1] == 0
    assert got[6][0] == 24000 and contamination.scan(none, bench).count() == 0
    assert not contamination.scan(odd, bench.where("item_id > 99")).where("contaminated").count()
    assert contamination.clean(odd, bench).count() == len(ROWS) - 3 and contamination.clean(odd, bench).columns == odd.columns
    assert contamination.scan(odd, bench).count() == len(ROWS)


def test_contamination_in_passes(spark, docs, odd, monkeypatch):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    run = lambda d: sorted(map(repr, contamination.scan(d, bench).collect()))
    want = [run(d) for d in (docs, odd)]
    monkeypatch.setattr(contamination, "PASS_BYTES", common.in_memory_bytes(contamination.windows(bench)[0]) // 3)
    assert [run(d) for d in (docs, odd)] == want and any("contaminated=True" in r for r in want[0])


def test_contamination_of_long_items(spark):
    r = random.Random(2)
    words = [f"w{i}" for i in range(50)]
    items = [(i, " ".join(r.choice(words[:6]) for _ in range(r.choice([1, 5, 13, 14, 30])))) for i in range(12)]
    texts = [" ".join(r.choice(words[:6]) for _ in range(r.randint(0, 300))) + " " + r.choice(items)[1].upper() for _ in range(40)]
    got = {x.doc_id: (x.n_words, x.n_hit, list(x["items"])) for x in contamination.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    for d, t in enumerate(texts):
        w, hit, who = t.lower().split(), set(), set()
        for i, x in items:
            x = x.split()
            k = min(13, len(x))
            for a in range(len(x) - k + 1):
                for p in range(len(w) - k + 1):
                    if w[p : p + k] == x[a : a + k]:
                        hit |= set(range(p, p + k))
                        who.add(str(i))
        assert got[d] == (len(w), len(hit), sorted(who))


def encoding():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe(docs, odd, none):
    enc, sha = encoding(), lambda b: hashlib.sha256(b).hexdigest()
    for table in (docs, odd):
        rows = table.select("doc_id", "text").collect()
        ids = [enc.encode_ordinary(r[1] or "") for r in rows]
        want = sorted((str(r[0]), len(i), sha(" ".join(map(str, i)).encode()), sha((r[1] or "").encode())) for r, i in zip(rows, ids, strict=True))
        assert sorted((str(r[0]), *tuple(r)[1:]) for r in bpe.round_trip(table).collect()) == want
    assert bpe.round_trip(none).count() == 0
    assert sorted(r.text for r in bpe.decode(bpe.encode(odd)).collect()) == sorted(r[1] or "" for r in ROWS)


def test_bpe_split_characters():
    coder = bpe.coder(public_tokenizers.path(bpe.RANKS))
    text = "a 漢🙂é"
    ids = coder.encode(text)
    assert coder.decode(ids) == text and "�" in coder.decode(ids[:-2])
    spans = coder.offsets(text)
    assert spans[0][0] == 0 and spans[-1][1] == len(text) and all(a < b for a, b in spans)


def test_bpe_offsets(spark, odd):
    got = bpe.encode(odd, with_offsets=True).collect()
    assert got == [] or len(got) == len(ROWS)
    coder = bpe.coder(public_tokenizers.path(bpe.RANKS))
    by = {r.doc_id: r for r in got}
    for d, text, *_ in ROWS:
        if d != 7 and d is not None:
            assert list(zip(by[d].starts, by[d].ends, strict=True)) == coder.offsets(text) and len(by[d].token_ids) == len(by[d].starts)


def test_token_counts(spark, docs, none):
    enc = encoding()
    want = defaultdict(lambda: [0, 0, 0])
    rows = [tuple(r) for r in docs.select("doc_id", "text", "source", "lang").collect()]
    for _, t, s, lang in rows:
        for i, v in enumerate((1, len(enc.encode_ordinary(t or "")), len(t or ""))):
            want[s, lang][i] += v
    rollup = token_counts.load(docs)
    totals = lambda: {(r.source, r.lang): [r.n_docs, r.n_tokens, r.n_chars] for r in rollup.totals().collect()}
    assert totals() == want
    r = random.Random(4)
    for batch in ("000001", "000002"):
        changes = []
        for d, _, s, lang in r.sample(rows, 300):
            changes.append((d, r.choice([s, "new"]), lang, token_counts.VERSION, r.randint(0, 99), 5, r.random() < 0.3))
        changed = spark.createDataFrame(changes, token_counts._CHANGE)
        assert rollup.commit(batch, changed) and not rollup.commit(batch, changed)
    assert rollup.commit("000003", spark.createDataFrame([], token_counts._CHANGE))
    before = totals()
    rollup.snapshot()
    assert totals() == before and rollup._history(None) == [("snapshot", "000003")]
    states = rollup.states().collect()
    again = defaultdict(lambda: [0, 0, 0])
    for x in states:
        for i, v in enumerate((1, x.n_tokens, x.n_chars)):
            again[x.source, x.lang][i] += v
    assert totals() == again and len(states) < len(rows)
    with pytest.raises(ValueError):
        rollup.commit("000000a", spark.createDataFrame([], token_counts._CHANGE))
    assert token_counts.corpus_totals(none).count() == 0


def near(a, b):
    """Levenshtein distance of 1 at most."""
    if abs(len(a) - len(b)) > 1:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    return a[i + (len(a) >= len(b)) :] == b[i + (len(b) >= len(a)) :]


def plain_lines(rows, least=10):
    """Documents without the lines that an earlier one, at any place, is within one edit of."""
    every = [(d, i, x.strip(" \t\x0b\x0c\r")) for d, t in sorted(rows) for i, x in enumerate((t or "").split("\n"))]
    first = {}
    for d, i, x in every:
        if len(x) >= least:
            first.setdefault(x, (d, i))
    by_len = defaultdict(list)
    for x in first:
        by_len[len(x)].append(x)
    gone = {x for x in first if any(first[y] < first[x] and near(x, y) for k in (-1, 0, 1) for y in by_len[len(x) + k])}
    keep = {(d, i) for d, i, x in every if len(x) < least or (x not in gone and first[x] == (d, i))}
    return {d: None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if (d, i) in keep) for d, t in rows}


def test_lines(spark):
    r = random.Random(6)
    base = ["".join(r.choice("abcd éß漢") for _ in range(r.randint(6, 26))).strip() for _ in range(60)]

    def edited(x):
        p, k = r.randrange(len(x)), r.randrange(5)
        return [x, x[:p] + x[p + 1 :], x[:p] + "b" + x[p + 1 :], x[:p] + "aa"[: r.randint(1, 2)] + x[p:], f" {x}\t"][k]

    rows = [(i, "\n".join(edited(r.choice(base)) for _ in range(r.randint(0, 12)))) for i in range(80)] + [(900, None), (901, "\n\n"), (902, "short\nshort")]
    table = spark.createDataFrame([(d, t, len(t or "")) for d, t in rows], "doc_id long, text string, n_chars long")
    got = {x.doc_id: (x.text, x.n_chars) for x in lines.dedup_lines(table).collect()}
    assert got == {d: (t, None if t is None else len(t)) for d, t in plain_lines(rows).items()}


def test_lines_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    got = {r.doc_id: r.text for r in lines.dedup_lines(docs).collect()}
    assert got == plain_lines(rows)


def test_lines_odd(odd, none):
    got = lines.dedup_lines(odd)
    assert got.columns == odd.columns and got.count() == len(ROWS)
    by = {r.doc_id: r.text for r in got.collect()}
    assert by[None] == ROWS[0][1] and by[1] == "" and by[5] == ROWS[4][1] and by[2] is None and by[7] == ROWS[6][1]
    assert lines.dedup_lines(none).count() == 0 and lines.line_report(none).count() == 0


def test_secret_scan(spark, docs, none, odd):
    forest = secret_scan.fit(spark.createDataFrame(secret_scan.labelled_findings(1200, 1), "candidate string, before string, after string, path string, label int"))
    held = spark.createDataFrame(secret_scan.labelled_findings(600, 99), "candidate string, before string, after string, path string, label int")
    f = secret_scan.features(*(held[c] for c in ("candidate", "before", "after", "path")))
    right = 0
    for row in held.select("label", *f).collect():
        p = sum(t.score(row[1:]) for t in forest) / len(forest)
        right += (p > 0.5) == (row[0] == 1)
    assert right >= 570
    found = {(r.doc_id, r.candidate) for r in secret_scan.scan(docs).collect()}
    planted = {(r[0], m) for r in docs.select("doc_id", "text").collect() for m in re.findall(r'token = "([0-9a-f]{40})"', r[1])}
    assert len(found & planted) >= 0.95 * len(planted) and len(found) <= 1.1 * len(planted) + 2
    assert secret_scan.scan(none).count() == 0
    secret_scan.scan(odd).collect()


def test_secret_scan_within_words(spark):
    key, other, uuid = "ghp_aB3dE5gH7jK9mN1pQ3rS5tU7vW9xY1zA3bC5", "ghp_Zq8Wx6Ec4Rv2Tb0Yn7Um5Ik3Ol1Pa9Sd2Fg4", "123e4567-e89b-12d3-a456-426614174000"
    texts = {
        1: f'see {{"id":"{uuid}","api_key":"{key}"}} there',
        2: f"{uuid},{key},{other},x",
        3: f"https://h.org/a?id={uuid}&token={key}&page=2",
        4: "pwd=hunter2!x",
        5: 'password="correct,horse&battery"',
        6: f"api_key={key}",
        7: 'a {"user":"me","password":"s3cr3t!pass","n":1} b',
        8: "the token=abc was password= none",
        9: None,
    }
    table = spark.createDataFrame([(d, t, "src/app.py") for d, t in texts.items()], "doc_id long, text string, source string")
    got = defaultdict(list)
    for r in secret_scan.candidates(table).orderBy("doc_id", "word_no").collect():
        got[r.doc_id].append((r.word_no, r.candidate, r.before, r.after))
    assert sorted(got[1]) == [(1, uuid, 'see {"id":"', ""), (1, key, '","api_key":"', "there")]
    assert {x[1] for x in got[2]} == {uuid, key, other} and {x[2] for x in got[2]} == {"", ","}
    assert {x[1] for x in got[3]} == {f"id={uuid}", key} and ("&token=" in {x[2] for x in got[3]})
    assert got[4] == [(0, "hunter2!x", "pwd=", "")] and got[5] == [(0, "correct,horse&battery", 'password="', "")]
    assert got[6] == [(0, key, "api_key=", "")] and got[7] == [(1, "s3cr3t!pass", 'a {"user":"me","password":"', "b")]
    assert 8 not in got and 9 not in got
    found = {(r.doc_id, r.candidate) for r in secret_scan.scan(table).collect()}
    assert {(1, key), (2, key), (2, other), (3, key), (6, key)} <= found and not {(d, uuid) for d in texts} & found


def test_license_scan(spark, docs, none, odd):
    model = license_scan.fit(license_scan.labelled_paragraphs(1500, 1))
    held = license_scan.labelled_paragraphs(400, 77)
    right = sum(max((p := model.probabilities(t)), key=p.get) == f for t, f in held)
    assert right >= 384
    got = {(r.doc_id, r.paragraph_no): (r.family, r.probability) for r in license_scan.scan(docs).where("confirmed").collect()}
    own = license_scan.own_model()
    want = {}
    for d, t in docs.select("doc_id", "text").collect():
        for i, x in enumerate(t.split("\n")):
            p = own.probabilities(x)
            best = max(p, key=p.get)
            if best != "unknown" and p[best] > 0.5:
                want[d, i] = (best, p[best])
    assert {k: v[0] for k, v in want.items() if k in got} == {k: v[0] for k, v in got.items()}
    assert all(abs(want[k][1] - got[k][1]) < 1e-4 for k in got)
    notices = {"Released under the MIT License.": "MIT", "Licensed under the Apache License, Version 2.0.": "Apache-2.0", "Licensed under CC BY-NC 4.0.": "CC-BY-NC", "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0"}
    for d, t in docs.select("doc_id", "text").collect():
        for i, x in enumerate(t.split("\n")):
            if x in notices:
                assert got[d, i][0] == notices[x]
    assert license_scan.scan(none).count() == 0 and license_scan.scan(odd).count() == 0


def test_license_scan_of_wrapped_notices(spark):
    mit = "# Permission is hereby granted, free of charge, to any person obtaining a copy\n# of this software and associated documentation files"
    bsd = " * Redistribution and use in source and binary forms, with or without\r\n * modification, are permitted provided that the following conditions are met:"
    apache = "you may not use this file except in compliance with the License.\nYou may obtain a copy of the License at\n    http://example.org"
    single = "Released under the MIT License."
    texts = [mit, f"def f():\n\n{bsd}\n\nend of it", f"x\n \n{apache}\n", f"{single}\n{bsd}", f"plain words\n{single}\nmore of it", f"{mit.replace(chr(10), chr(10) * 2)}", None, "\n\n", "a\nb"]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r.doc_id, r.paragraph_no, r.n_lines, r.family) for r in license_scan.scan(table).where("confirmed").collect()}
    assert got == {(0, 0, 2, "MIT"), (1, 2, 2, "BSD"), (2, 2, 3, "Apache-2.0"), (3, 0, 1, "MIT"), (3, 0, 3, "BSD"), (4, 1, 1, "MIT")}


def test_chat(spark):
    said = ["", "a\\b", "<s></s>[INST][/INST]", "<\\s>", "\\<s>", "[\\\\/INST]", "<<s>>", None, "漢字 🙂", "\\" * 5, "x" * 50_000]
    for t in said:
        e = chat.escape(t)
        assert chat.unescape(e) == (t or "") and not any(c in e for c in chat.CONTROLS)
    turns = [(1, i, r, t) for i, (t, r) in enumerate((t, r) for t in said for r in ("user", "assistant", "a[INST]b", None))] + [(2, 0, "assistant", "b"), (2, 0, "assistant", "a"), (2, 0, "assistant", "a"), (None, None, None, None)]
    table = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS n_turns")
    got = {r.conv_id: r for r in chat.digest_conversations(table).collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for c in (1, 2, None):
        own = sorted((r[1:] for r in turns if r[0] == c), key=lambda r: (r[0] is not None, r[0], r[1] or "", r[2] or ""))
        loss = "".join(t or "" for _, r, t in own if r == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256) == (len(own), sha("".join(f"{r or ''}\n{t or ''}\n" for _, r, t in own)))
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), sha(loss))
    for r in chat.format_conversations(table).collect():
        assert len(r.formatted) == got[r.conv_id].formatted_chars
        loss = "".join(chat.unescape(r.formatted[a:b]) for a, b in r.loss_spans)
        assert (len(loss), sha(loss)) == (got[r.conv_id].loss_chars, got[r.conv_id].loss_sha256)
    assert chat.digest_conversations(table.where("conv_id = 5")).count() == 0


def people(n):
    return [{"role": "user", "text": f"t{i}"} for i in range(n)]


def test_templates():
    from lodestone.llm.templates import TemplateError, fold, parse, render

    t = "{% for m in ms %}{% if loop.first %}^{% elif m.text == 't1' and not m.x %}one{% else %}{{ m.text | upper }}{% endif %}{% endfor %}{{ 'a' + 'b' | upper }}"
    assert render(t) == "aB"
    from lodestone.llm.templates import compile_template

    assert "".join(x for x, _ in compile_template(t)(ms=people(3))) == "^oneT2aB"
    assert fold(parse("{% if 1 == 2 %}x{% elif 'a' %}y{{ 'z' }}{% else %}{{ q }}{% endif %}w"), {}).parts[0].value == "yzw"
    for bad in ("{% for %}", "{% if x %}", "{{ x.__class__ ( ) }}", "{{ x | nothing }}", "{% endfor %}", "{{ }}", "{% import os %}"):
        with pytest.raises(TemplateError):
            fold(parse(bad), {})
    assert render("{{ x.__class__ }}") == ""


def test_quality(spark, odd, none):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    train = labels.where("doc_id % 2 = 0")
    found = quality.classify(docs, train)
    held = found.join(labels.where("doc_id % 2 = 1"), "doc_id").selectExpr("kept", "quality = 1 and toxic = 0 AS good").collect()
    n = Counter((r.kept, r.good) for r in held)
    assert n[False, True] <= 0.01 * (n[True, True] + n[False, True]) and n[True, False] <= 0.03 * (n[True, False] + n[False, False])
    labelled = spark.createDataFrame([(1, 1, 0), (6, 0, 0), (5, None, 1), (None, 0, 1)], "doc_id long, quality int, toxic int")
    assert quality.classify(odd, labelled).count() == len(ROWS)
    assert quality.classify(none, labelled).count() == 0 and quality.keep_good(odd, labelled.where("doc_id > 99")).count() == len(ROWS)


def plain_groups(rows, words=5, least=0.8):
    """The least member of the group of each of ``rows`` (key: text), in their order: similarity by all pairs."""
    def shingles(t):
        w = (t or "").encode().lower().split()
        return frozenset(b" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))) if w else frozenset()

    keys = sorted(rows)
    sets = [shingles(rows[k]) for k in keys]
    parent = list(range(len(keys)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a == b or (a and b and min(len(a), len(b)) >= least * max(len(a), len(b)) and len(a & b) >= least * len(a | b)):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {k: keys[find(i)] for i, k in enumerate(keys)}


def test_pipeline(spark):
    import corpus_pipeline as p

    enc = encoding()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in p.STAGES]
    assert names == ["quality_classifier", "line_dedup", "simhash_near_dedup", "benchmark_decontamination", "bpe_encoding"]
    kept = common.table(p.STAGES[0][1](spark, docs, SF))
    bad = {r.doc_id for r in quality.classify(docs, spark.read.parquet(f"{SF}/labels.parquet")).where("not kept").collect()}
    rows = {r.doc_id: r.text for r in docs.collect() if r.doc_id not in bad}
    assert {r.doc_id: r.text for r in kept.collect()} == rows and kept.columns == docs.columns
    rows = plain_lines(list(rows.items()))
    first = {}
    for d, g in plain_groups(rows).items():
        first.setdefault(g, d)
    rows = {d: rows[d] for d in first.values()}
    found = contamination.scan(spark.createDataFrame(list(rows.items()), "doc_id long, text string"), spark.read.parquet(f"{SF}/benchmark.parquet"))
    for r in found.where("contaminated").collect():
        del rows[r.doc_id]
    assert {r.doc_id: list(r.token_ids) for r in p.run(spark, SF).collect()} == {d: enc.encode_ordinary(t) for d, t in rows.items()}


def test_queries_are_complete():
    assert sorted(int(k[2:].split("_")[0]) for k in queries.QUERIES) == list(range(1, 11)) and set(queries.ORACLE_SQL) <= set(queries.QUERIES)
