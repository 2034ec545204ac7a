"""The corpus operators against brute force on small, messy tables."""

from __future__ import annotations

import re
import string
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from twosight.llm import benchmark, common, language, licences, lines, mixing, neardup, neighbours, quality, tokens, urls
from twosight.llm.queries import URL_RULES

WORD = re.compile(r"[^\x20\x09-\x0D]+")
AZ = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
BASE = [f"w{i}" for i in range(60)]
PASSAGE = " ".join(f"p{i}" for i in range(55))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _row string, size string, score string"


def variant(*changes: int) -> str:
    return " ".join(f"x{c}" if i in changes else w for i, w in enumerate(BASE) for c in [i * 7 + len(changes)])


TEXTS = [
    None, "", " \t\n ", "one", "One  TWO", "one two", variant(), variant().upper().replace("W", "w"), variant(5), variant(5, 40), variant(1, 15, 30, 45),
    variant(10), variant(10, 50), PASSAGE, f"head line of it\n{PASSAGE}\ntail line of it", f"other words go here\n{PASSAGE}", "a b\na b\na b\na b\nlast", "...", "12 34",
    "Licensed under the Apache License, Version 2.0.\nsome text", "é " * 3 + "Ünïcode wörds", " ".join(f"long{i}" for i in range(6000)),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ["en", "de", None][i % 3], [None, "a", "b", "c", ""][i % 5], len(t or ""), "x", "y", "z") for i, t in enumerate(TEXTS)]
    rows += [(None, variant(), "en", "a", 1, "x", "y", "z"), (None, None, None, None, None, None, None, None), rows[8], rows[8]]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


def shingles(text, n):
    w = WORD.findall((text or "").translate(AZ))
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def test_mixing(docs, none):
    rows = mixing.mix(docs, block=16).toPandas()
    assert len(rows) == docs.count()
    sizes = {r.doc_id: len(WORD.findall(r.text or "")) for r in docs.collect() if r.doc_id is not None}
    assert all(r["size"] == sizes[r.doc_id] for _, r in rows.dropna(subset=["doc_id"]).iterrows())
    assert (rows.taken <= 2 * rows["size"]).all()
    by = rows.groupby(rows.source.fillna("~null"), sort=True).agg(size=("size", "sum"), taken=("taken", "sum"), target=("target", "first"), said=("source_size", "first"))
    assert (by["size"] == by.said).all() and (abs(by.taken - by.target) <= 1).all()
    weights, left, target = dict(zip(["", "a", "b", "c", "~null"], (3, 1, 2, 3, 1))), 1.5 * by["size"].sum(), {}
    while len(target) < len(by):
        open_ = [s for s in by.index if s not in target]
        rest = left - sum(target.values())
        share = {s: rest * weights[s] / sum(weights[o] for o in open_) for s in open_}
        over = {s: 2 * by["size"][s] for s in open_ if share[s] > 2 * by["size"][s]}
        target |= over or share
    assert np.allclose([target[s] for s in by.index], by.target)
    again = mixing.mix(docs, block=16).toPandas()
    assert sorted(map(str, rows.values.tolist())) == sorted(map(str, again.values.tolist()))
    assert mixing.mix(none).count() == 0


def test_mix_pieces(docs, none):
    """The written pieces are the mix: each slot holds a block of one source's words in order, as the documents have them."""
    block = 16
    rows = mixing.pieces(docs, block=block).collect()
    assert rows == sorted(rows, key=lambda r: (r.slot, r.at))
    texts = {}
    for d in docs.collect():
        texts.setdefault((d.doc_id, d.source), []).append(d.text or "")
    for r in rows:
        spans = [[m.span() for m in WORD.finditer(t)] for t in texts[r.doc_id, r.source]]
        assert r.text in [t[s[r.first_word][0] : s[r.last_word][1]] for t, s in zip(texts[r.doc_id, r.source], spans) if len(s) > r.last_word]
    slots = {}
    for r in rows:
        slots.setdefault(r.slot, []).append(r)
    ranks = {}
    for slot in sorted(slots):
        here = slots[slot]
        assert len({(r.source, r.rank) for r in here}) == 1 and here[0].at == here[0].rank * block
        assert all(b.at == a.at + a.last_word - a.first_word + 1 for a, b in zip(here, here[1:]))
        ranks.setdefault(here[0].source, []).append(here[0].rank)
    assert all(r == list(range(len(r))) for r in ranks.values())
    report = mixing.mix(docs, block=block).toPandas()
    assert sum(len(WORD.findall(r.text)) for r in rows) == report.taken.sum() and any("\n" in r.text for r in rows)
    assert mixing.pieces(none).count() == 0


def test_tokens(docs, none):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    texts = [*TEXTS, "a<|endoftext|>b", "aaaa" * 300, "\u2028 \x85  x's", "😀 12½"]
    want = [len(e.ids) for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert tokens.Merger(path).count(texts).tolist() == want
    rows = {r.doc_id: r for r in tokens.count_tokens(docs, path).collect() if r.doc_id is not None}
    assert all(rows[i].n_tokens == want[i] and rows[i].n_bytes == len((t or "").encode()) and rows[i].over_limit == (want[i] > 1024) for i, t in enumerate(TEXTS))
    assert tokens.count_tokens(none, path).count() == 0


def test_near_duplicates(docs, none):
    for percent, n in ((85, 3), (80, 5)):
        rows = neardup.near_duplicates(docs, percent, n).collect()
        assert len(rows) == docs.count()
        sets = [shingles(r.text, n) for r in rows]
        parent = list(range(len(rows)))
        for i, a in enumerate(sets):
            for j, b in enumerate(sets[:i]):
                if a and b and 100 * len(a & b) >= percent * len(a | b):
                    x, y = parent[i], parent[j]
                    parent = [y if p == x else p for p in parent]
        for i, r in enumerate(rows):
            group = [rows[j] for j, p in enumerate(parent) if p == parent[i]]
            ids = [g.doc_id for g in group if g.doc_id is not None]
            assert r.n_shingles == len(sets[i]) and r.component_id == (min(ids) if ids else None)
            assert sum(g.representative for g in group) == 1
    assert neardup.near_duplicates(none).count() == 0


def test_open_buckets(spark):
    """A chain of links in one bucket, among near texts that are not linked: the block step finds what the heads miss."""
    base = [f"w{i}" for i in range(400)]
    texts = []
    for i in range(40):
        w = list(base)
        for k in range(0, i % 10 * 3 + 12):
            w[(k * 31 + i // 10 * 3) % 400] = f"y{i}_{k}" if i % 10 > 4 else f"y{k}"
        texts.append(" ".join(w))
    rows = neardup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 85, 3).collect()
    sets = [shingles(t, 3) for t in texts]
    parent = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 100 * len(a & b) >= 85 * len(a | b):
                x, y = sorted((parent[i], parent[j]))
                parent = [x if p == y else p for p in parent]
    assert {r.doc_id: r.component_id for r in rows} == dict(enumerate(parent))


def test_licenses(docs, none):
    rows = licences.scan(docs).collect()
    assert [(r.doc_id, r.line, r.license, r.exact) for r in rows] == [(19, 0, "Apache-2.0", True)]
    one = docs.sparkSession.createDataFrame([(1, "word " * 500 + "released under the MIT License. " + "word " * 500)], "doc_id long, text string")
    assert {(r.license, r.exact) for r in licences.scan(one, changed=0.5).collect()} <= {("MIT", False), ("MIT", True)}
    assert licences.scan(none).count() == 0


def test_license_windows(spark):
    """An exact notice is found and exact whatever prose stands around it, over line ends, beside others and at any length."""
    rng = np.random.default_rng(7)
    prose = lambda n: " ".join("".join(rng.choice(list("abcdefghij"), rng.integers(2, 9))) for _ in range(n))
    short = {name: of if isinstance(of, str) else of[0] for name, of in licences.TEMPLATES.items()}
    cases, want = [], []
    for name, notice in short.items():
        for text in (f"{prose(6)} {notice} {prose(8)}", f"{prose(40)} {notice} {prose(900)}", f"{prose(3)}\n{notice.replace(' ', chr(10), 3)} {prose(5)}"):
            want.append((len(cases), name, True))
            cases.append(text)
    assert ("MIT", True) in {x[1:] for x in want}
    want += [(len(cases), "CC-BY-NC-4.0", True), (len(cases), "MIT", True), (len(cases) + 1, "MIT", False)]
    cases += [f"{prose(4)} {short['MIT']} {short['CC-BY-NC-4.0']}", f"{prose(40)} released under the MIT License. {prose(70)}", f"{prose(300)} of the license and the License under", None, ""]
    rows = licences.scan(spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.license, r.exact) for r in rows) == sorted(want)
    long = prose(200)
    wrapped = "\n".join("# " + " ".join(long.split()[i : i + 12]) for i in range(0, 200, 12))
    own = licences.scan(spark.createDataFrame([(1, f"x\n{prose(30)}\n{long} {prose(20)}"), (2, wrapped)], "doc_id long, text string"), {"own": long}).orderBy("doc_id").collect()
    assert [(r.doc_id, r.license, r.line, r.n_words, r.exact) for r in own] == [(1, "own", 2, 200, True), (2, "own", 0, 216, False)]
    assert licences.scan(spark.createDataFrame([(1, "x")], "doc_id long, text string"), {}).count() == 0


def test_license_templates(spark):
    """Every wording of the production templates, wrapped as in a source file, is found once under its own license."""
    every = [(name, t) for name, of in licences.TEMPLATES.items() for t in ([of] if isinstance(of, str) else of)]
    assert {"Permission", "Redistribution", "Licensed"} <= {t.split()[0] for _, t in every if len(t.split()) > 70}
    cases = ["some words before\n" + "\n".join(" ".join(t.split()[i : i + 11]) for i in range(0, len(t.split()), 11)) + "\nand after it" for _, t in every]
    rows = licences.scan(spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")).collect()
    got = sorted((r.doc_id, r.license, r.line, r.n_words, r.exact) for r in rows)
    assert got == [(i, name, 1, len(t.split()), True) for i, (name, t) in enumerate(every)]


def test_urls(spark):
    cases = {
        "http://A.Example.com/en/x?y": ("a.example.com", "/en/x", "example.com/en/", "block"), "https://www.example.com/en/": ("www.example.com", "/en/", "www.example.com/en/", "allow"),
        "http://x.net/es/1": ("x.net", "/es/1", "net/es/", "block"), "http://x.net/esp": ("x.net", "/esp", None, "allow"), "http://badexample.com/en/": ("badexample.com", "/en/", "com/", "allow"),
        "http://example.com": ("example.com", "", None, "allow"), "no scheme": ("", "", None, "allow"), None: ("", "", None, "allow"), "": ("", "", None, "allow"), "x://com/#a": ("com", "/", "com/", "allow"),
    }
    frame = spark.createDataFrame([(i, u, "z") for i, u in enumerate([*cases, "x://com/#a"])], "page_id long, url string, rule string")
    for most in (urls.TRIE_BYTES, 1):
        rows = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(frame, URL_RULES, most=most).collect()}
        assert rows == dict(enumerate([*cases.values(), cases["x://com/#a"]]))
    assert urls.judge(frame.where("false"), URL_RULES).count() == 0
    assert {r.verdict for r in urls.judge(frame, []).collect()} == {"allow"}


def test_lines(docs, none):
    rows = sorted(lines.without_repeats(docs, 5).collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0))
    assert len(rows) == docs.count()
    source = sorted(docs.collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0))
    seq, own = [], []
    for d, r in enumerate(source):
        for x in (r.text or "").split("\n"):
            if WORD.search(x):
                seq.append(x)
                own.append(d)
    dead = set()
    for p in range(len(seq)):
        best = 0
        for q in range(p):
            k = 0
            while p + k < len(seq) and own[p + k] == own[p] and own[q + k] == own[q] and seq[p + k] == seq[q + k]:
                k += 1
            best = max(best, k)
        if sum(len(WORD.findall(x)) for x in seq[p : p + best]) >= 5:
            dead.update(range(p, p + best))
    lost = [sum(own[p] == d for p in dead) for d in range(len(source))]
    same = lambda rs, ns: sorted((str(r.doc_id), n) for r, n in zip(rs, ns))
    assert same(rows, [r.removed_lines for r in rows]) == same(source, lost)
    by = {r.doc_id: r.text for r in rows if r.doc_id is not None}
    assert by[13] == PASSAGE and by[14] == "head line of it\ntail line of it" and by[15] == "other words go here" and by[0] is None and by[2] == TEXTS[2]
    assert lines.without_repeats(none).count() == 0


def test_line_originals(spark):
    """The longest copy counts, whichever earlier place has it, not that of the earliest place which shares its beginning."""
    menu, rng = "Home\nAbout\nContact\nBlog\n", np.random.default_rng(11)
    frame = spark.createDataFrame([(1, menu + "Jobs"), (2, menu + "News"), (3, menu + "News")], "doc_id long, text string")
    assert {r.doc_id: (r.text, [tuple(x) for x in r.removed_runs]) for r in lines.without_repeats(frame, 5).collect()} == {1: (menu + "Jobs", []), 2: (menu + "News", []), 3: ("", [(0, 5)])}
    texts = [list(rng.choice(["a b", "c", "d e f"], rng.integers(1, 14), p=[0.5, 0.3, 0.2])) for _ in range(60)]
    texts += [texts[i][:j] + ["x"] + texts[i + 1][j:] for i in range(30) for j in (2, 5)]
    got = {r.doc_id: r.removed_lines for r in lines.without_repeats(spark.createDataFrame([(i, "\n".join(x)) for i, x in enumerate(texts)], "doc_id long, text string"), 9).collect()}
    starts = [(i, j) for i, x in enumerate(texts) for j in range(len(x))]
    for i, x in enumerate(texts):
        dead = set()
        for j in range(len(x)):
            best = 0
            for a, b in starts[: starts.index((i, j))]:
                k = 0
                while j + k < len(x) and b + k < len(texts[a]) and texts[a][b + k] == x[j + k]:
                    k += 1
                best = max(best, k)
            if sum(len(y.split()) for y in x[j : j + best]) >= 9:
                dead.update(range(j, j + best))
        assert got[i] == len(dead)


def test_benchmark(docs, none):
    items = docs.sparkSession.createDataFrame([(1, PASSAGE), (2, " ".join(PASSAGE.split()[:20]) + " q r"), (3, "one two"), (4, None), (5, " "), (6, "long5999"), (None, "w1 w2 w3 w4 w5")], "item_id long, text string")
    got = sorted((str(r.doc_id), str(r.item_id), r.found) for r in benchmark.contained(docs, items).collect())
    want = []
    for d in docs.collect():
        for i in items.collect():
            n = min(5, len(WORD.findall(i.text or "")))
            if n and 100 * len(shingles(i.text, n) & (shingles(d.text, n) if len(WORD.findall(d.text or "")) >= n else set())) >= 80 * len(shingles(i.text, n)):
                want.append((str(d.doc_id), str(i.item_id), len(shingles(i.text, n) & shingles(d.text, n))))
    assert got == sorted(want) and got
    assert benchmark.without(docs, items).count() == docs.count() - sum(1 for d in docs.collect() if str(d.doc_id) in {g[0] for g in got} and (d.doc_id is not None or d.text))
    assert benchmark.contained(none, items).count() == 0 and benchmark.contained(docs, items.where("false")).count() == 0


def test_neighbours(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(900, 8)) + 3 * rng.normal(size=(9, 8))[np.arange(900) % 9]
    x[400:700] = x[400]
    rows = [(i, [float(np.float32(v)) for v in x[i]], "z") for i in range(900)]
    bad = [(1000, None, "z"), (1020, [0.0] * 8, "z"), (1040, [float("nan")] * 8, "z"), (1060, [None] * 8, "z"), (None, rows[0][1], "z"), (1080, [1.0], "z"), rows[3]]
    frame = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, score string")
    got = {}
    for r in neighbours.nearest(frame, F.col("id") % 20 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    v = np.array([r[1] for r in rows])
    hits = 0
    assert set(got) == set(range(0, 900, 20))
    for q, found in got.items():
        score = (v * v[q]).sum(axis=1)
        order = [i for i in sorted(range(900), key=lambda i: (-round(score[i], 9), i)) if i != q][:20]
        hits += len({f for f, _ in found} & set(order))
        assert len(found) == 20 and all(abs(s - score[f]) < 1e-9 for f, s in found)
    assert hits >= 0.9 * 20 * len(got)
    assert neighbours.nearest(frame.where("false"), F.col("id") % 20 == 0).count() == 0


def test_neighbours_with_lists_that_no_query_reads(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(6000, 6)) + 8 * rng.normal(size=(60, 6))[np.arange(6000) % 60]
    rows = [(i, [float(v) for v in x[i]]) for i in range(6000)] + [(20, [-float(v) for v in x[20]])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = neighbours.nearest(frame, F.col("id").isin(7), width=4).toPandas()
    best = [i for i in np.argsort(-(x @ x[7]), kind="stable") if i != 7][:20]
    assert got["rank"].tolist() == list(range(1, 21)) and len(set(got.vec_id) & set(best)) >= 18
    # Two vectors of one id: one ranking, no candidate twice. A narrow first search finds what a wide one does.
    both = neighbours.nearest(frame, F.col("id").isin(20), width=4, ratio=50.0).toPandas().sort_values("rank")
    score = np.maximum(x @ x[20], -(x @ x[20]))
    best = [i for i in np.argsort(-score, kind="stable") if i != 20][:20]
    assert both["rank"].tolist() == list(range(1, 21)) and both.vec_id.tolist() == best


def test_quality(spark, none):
    rng = np.random.default_rng(3)
    good = lambda: " ".join("".join(rng.choice(list("abcdefgh"), rng.integers(2, 8))) for _ in range(80)).capitalize() + "."
    junk = lambda: ("SPAM!! " * 80).strip()
    rows = [(i, junk() if i % 5 == 0 else good()) for i in range(1500)] + [(None, None), (1501, ""), (1502, "x" * 50_000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 0 if i % 5 == 0 else 1) for i in range(0, 1500, 2)] + [(None, 1), (7, 0), (7, 1)], "doc_id long, quality int")
    learn = F.crc32(F.col("doc_id").cast("string")) % 5 != 0
    out = {r.doc_id: r for r in quality.judge(frame, labels, learn).collect()}
    assert len(out) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in out.values())
    assert all(r.held_out == (i is None or zlib.crc32(str(i).encode()) % 5 == 0) for i, r in out.items())
    assert np.mean([out[i].predicted == (i % 5 != 0) for i in range(1500) if out[i].held_out]) > 0.95
    assert quality.judge(none, labels, learn).count() == 0
    assert {r.score for r in quality.judge(frame, labels.where("false"), learn).collect()} == {0.5}


def test_language(docs, none):
    spark = docs.sparkSession
    rng = np.random.default_rng(5)
    word = {"en": ["the", "thing", "ship", "with"], "de": ["und", "schön", "nicht", "über"]}
    text = lambda lang, n: " ".join(rng.choice(word[lang], n))
    rows = [(i, text(lang, 40), lang) for i, lang in enumerate(["en", "de"] * 40)]
    learned = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True))
    cases = [text("en", 5), text("de", 300), text("en", 200) + " " + text("de", 100), None, "", "12 ...", text("en", 40) * 9000]
    frame = spark.createDataFrame([(i, t, "x") for i, t in enumerate(cases)], "doc_id long, text string, score string")
    out = {r.doc_id: r for r in language.identify(frame, learned).collect()}
    assert [out[i].lang_pred for i in range(7)] == ["en", "de", "en", "und", "und", "und", "en"]
    assert set(out[2].languages) == {"en", "de"} and 0.55 < out[2].score < 0.8 and out[1].score > 0.99 and out[3].score == 0
    assert language.identify(none, learned).count() == 0
    assert {r.lang_pred for r in language.identify(frame, learned.where("false")).collect()} == {"und"}


def test_language_sets(spark):
    """A set may hold as many languages as the likelihood asks for."""
    rng = np.random.default_rng(9)
    letters = ["abcde", "fghij", "klmno", "pqrst", "uvwxy", "zäöüß"]
    text = lambda k, n: " ".join("".join(rng.choice(list(letters[k]), rng.integers(3, 8))) for _ in range(n))
    names = [f"l{k}" for k in range(6)]
    learned = language.train(spark.createDataFrame([(i, text(i % 6, 200), names[i % 6]) for i in range(60)], "doc_id long, text string, lang string"), F.lit(True))
    frame = spark.createDataFrame([(n, " ".join(text(k, 400) for k in range(n))) for n in range(1, 7)], "doc_id long, text string")
    for r in language.identify(frame, learned).collect():
        assert set(r.languages) == set(names[: r.doc_id]) and abs(r.score - 1 / r.doc_id) < 0.05


def test_language_stage_without_languages(docs):
    """Where no document has a language, the stage drops only null texts and those without letters."""
    import corpus_pipeline

    unknown = docs.withColumn("lang", F.lit(None).cast("string"))
    want = sorted(r.text for r in docs.collect() if any(c.isalpha() for c in r.text or ""))
    assert sorted(r.text for r in corpus_pipeline.language_id(docs.sparkSession, unknown, "").collect()) == want
    assert sorted(r.text for r in corpus_pipeline.language_id(docs.sparkSession, docs, "").collect()) == want


def plain_mixture(counts, shares, penalty, rounds):
    """EM of one text over every set of its 1, 2, ... likeliest languages, n-gram by n-gram in double precision."""

    def fit(use):
        weight = {k: 1 / len(use) for k in use}
        for _ in range(rounds):
            new = dict.fromkeys(use, 0.0)
            for b, n in zip(*counts):
                whole = sum(weight[k] * float(shares[b, k]) for k in use)
                for k in use:
                    new[k] += n * weight[k] * float(shares[b, k]) / whole
            weight = {k: v / sum(counts[1]) for k, v in new.items()}
        return weight, sum(n * np.log(sum(weight[k] * float(shares[b, k]) for k in use)) for b, n in zip(*counts))

    every = range(shares.shape[1])
    first, _ = fit(every)
    order = sorted(every, key=lambda k: (-first[k], k))
    tried = [fit(order[: size + 1]) for size in every]
    value, size = max((v - penalty * k * np.log(sum(counts[1])), -k) for k, (_, v) in enumerate(tried))
    return [tried[-size][0].get(k, 0.0) for k in every], value


def test_mixture_against_plain_version():
    """The batched EM finds the proportions that EM over all nested sets finds, also when texts are judged a few at a time."""
    rng = np.random.default_rng(3)
    shares = rng.dirichlet(np.full(40, 0.3), 5).T + 1e-4
    shares = (shares / shares.sum(axis=0)).astype(np.float32)
    texts = []
    for i in range(30):
        mixed = shares[:, rng.choice(5, 1 + i % 4, replace=False)].mean(axis=1)
        drawn = rng.multinomial(int(rng.integers(1, 600)), mixed / mixed.sum())
        texts.append((np.flatnonzero(drawn), drawn[drawn > 0]))
    got = language.infer(texts, shares, 4.0, 8)
    for text, row in zip(texts, got):
        want, _ = plain_mixture(text, shares, 4.0, 8)
        assert np.allclose(row, want, atol=2e-3), (row, want)
    parts = list(language.together([5 * len(t[0]) for t in texts], 300))
    assert len(parts) > 3 and [i for x in parts for i in range(30)[x]] == list(range(30))
    assert np.allclose(np.concatenate([language.infer(texts[x], shares, 4.0, 8) for x in parts]), got, atol=1e-5)
    assert list(language.together([], 5)) == [] and list(language.together([9, 1, 9], 5)) == [slice(0, 1), slice(1, 2), slice(2, 3)]


def test_mix_output(docs, tmp_path):
    """The mix goes to the folder named, whole; with a share above the cap every word is taken cap times."""
    folder = f"{tmp_path}/mix"
    report = mixing.mix(docs, block=16, output=folder).toPandas()
    assert sorted(map(str, report.values.tolist())) == sorted(map(str, mixing.mix(docs, block=16).toPandas().values.tolist()))
    kept = docs.sparkSession.read.parquet(folder).drop("doc_at").collect()
    assert sorted(map(str, kept)) == sorted(map(str, mixing.pieces(docs, block=16).collect()))
    full = mixing.mix(docs, block=16, share=3.0, cap=2.0).toPandas()
    assert (full.taken == 2 * full["size"]).all() and (full.target == 2 * full.source_size).all()


def test_mix_counts_each_text_once(docs, monkeypatch):
    """Rows are dealt into ranges without their texts being read again for the range sample."""
    plans = []

    def spy(df, *args):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return running_totals(df, *args)

    running_totals = mixing.running_totals
    monkeypatch.setattr(mixing, "running_totals", spy)
    mixing.mix(docs, block=16)
    assert len(plans) == 1 and "regexp" not in plans[0].lower() and "text" not in plans[0].lower()


def test_mix_pieces_of_whole_and_cut_documents(spark):
    """Documents taken whole and cut ones give the same words; only ASCII white space at the edges goes."""
    texts = ["\x0b a b \t\x1c", " c  d\n\n", " \x85 ", "é\x1cf\r\n" * 40, "\r\n", "x"]
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    for block in (1, 7, 4096):
        rows = mixing.pieces(docs, block=block).collect()
        for r in rows:
            spans = [m.span() for m in WORD.finditer(texts[r.doc_id])]
            assert r.text == texts[r.doc_id][spans[r.first_word][0] : spans[r.last_word][1]]
        assert sum(len(WORD.findall(r.text)) for r in rows) == int(1.5 * sum(len(WORD.findall(t)) for t in texts))


def test_neighbours_read_lists_in_rounds(spark, monkeypatch):
    """A query stops when a doubling of its lists brings next to nothing; told to read all, it reads each list once and loses none."""
    read = []

    def spy(df):
        out = common.written(df)
        if "lists" in df.columns:
            read.extend((r["query"], x) for r in out.select("query", "lists").collect() for x in r.lists)
        return out

    monkeypatch.setattr(neighbours, "written", spy)
    rng = np.random.default_rng(4)
    x = np.rint(9 * (rng.normal(size=(9000, 8)) + 4 * rng.normal(size=(300, 8))[np.arange(9000) % 300]))
    frame = spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(9000)], "vec_id long, embedding array<double>")
    asked = list(range(0, 9000, 300))
    score = x[asked] @ x.T
    order = [[i for i in np.lexsort((np.arange(9000), -s)) if i != q][:20] for q, s in zip(asked, score)]
    soon = neighbours.nearest(frame, F.col("id") % 300 == 0).toPandas()
    few = len(read)
    assert few == len(set(read)) and len(soon) == 20 * len(asked)
    found = [set(soon[soon.query_id == q].vec_id) for q in asked]
    assert sum(len(f & set(o)) for f, o in zip(found, order)) >= 0.9 * 20 * len(asked)
    read.clear()
    every = neighbours.nearest(frame, F.col("id") % 300 == 0, ratio=1e9, recall=None).toPandas().sort_values(["query_id", "rank"])
    assert len(read) == len(set(read)) and few < 0.8 * len(read)
    assert every.vec_id.tolist() == [i for o in order for i in o]
