"""Spelling variants, ranked search and license scan against brute force, and their edge cases."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from tests.llm.test_operators import DOCS, ODD_TEXTS, documents, empty
from tidewatch.llm import licenses, search, spelling
from tidewatch.llm.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


# 11


def brute_words(rows, least_chars, least_n, thinned):
    count = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lowered(run)
            h = zlib.crc32(f"{doc_id}:{run}".encode())
            if thinned and doc_id is not None and h % thinned == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            count[run] += 1
    return {w: n for w, n in count.items() if len(w) >= least_chars and n >= least_n}


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    i = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[i + 1:] == b[i + 1:] if len(a) == len(b) else a[i + 1:] == b[i:] if len(a) > len(b) else a[i:] == b[i + 1:]


def brute_variants(words, ratio=5):
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    best = {w: min(near[w], key=lambda v: (-words[v], v)) for w in words if near[w]}
    form = {w: v for w, v in best.items() if words[v] >= ratio * words[w]}
    out = {}
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out[w] = (form.get(w), root, n, len(near[w]), words[form[w]] if w in form else None)
    return out


def as_variants(df):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


def test_words(spark):
    texts = [*ODD_TEXTS, "Straße STRASSE straße", "×÷ÀÿĀ abcÿdef", "Letters" * 3 + " Letters"]
    rows = [(i if i % 7 else None, t) for i, t in enumerate(texts)] + [(3, "letters"), (3, "letters")]
    docs = spark.createDataFrame([(i, t, "en", "s", "9", "w", "x") for i, t in rows], DOCS)
    for thinned in (None, 3):
        got = {r["word"]: r["n"] for r in spelling.word_counts(docs, 1, 1, thinned).collect()}
        assert got == brute_words(rows, 1, 1, thinned)
    assert spelling.word_counts(docs).columns == ["word", "n"]
    assert spelling.word_counts(empty(spark)).count() == 0


def test_variants_of_random_words(spark):
    rng = random.Random(5)
    words = {"aaaaaa": 9, "aaaaaaa": 400, "aaaaaaaa": 20, "éàéàéà": 6, "éàéàé": 70, "éàéàéàÀ": 31, "listen": 8, "silent": 50}
    while len(words) < 1500:
        base = [rng.choice("abcdeéÿ") for _ in range(rng.randint(4, 9))]
        for _ in range(rng.randint(1, 6)):
            words["".join(base)] = int(10 ** rng.uniform(0.7, 6))
            at, kind = rng.randrange(len(base)), rng.randrange(3)
            base[at:at + (kind > 0)] = [] if kind == 1 else [rng.choice("abcdeéÿ")]
            base = base or ["a"]
    words.pop("", None)
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    for parts in (4, 6):
        assert as_variants(spelling.variants(df, parts=parts)) == brute_variants(words)
    pairs = [(r["a"], r["b"]) for r in spelling.near_pairs(df).collect()]
    assert len(pairs) == len({frozenset(p) for p in pairs}) and all(one_edit(*p) for p in pairs)


def test_variants_edges(spark):
    df = spark.createDataFrame([("abcdef", 5), ("abcdeg", 25), ("abcdeh", 25), ("abcde", 125), ("zzzzzz", 7)], "word string, n long")
    got = as_variants(spelling.variants(df))
    assert got["abcdef"] == ("abcde", "abcde", 5, 3, 125)
    assert got["abcdeg"] == ("abcde", "abcde", 25, 3, 125)
    assert got["zzzzzz"] == (None, "zzzzzz", 7, 0, None)
    tied = spark.createDataFrame([("abcdef", 5), ("abcdeg", 25), ("abcdeé", 25)], "word string, n long")
    assert as_variants(spelling.variants(tied))["abcdef"][0] == "abcdeg"
    chain = [("abcdefghij"[:6 + k], 5 ** (k + 1)) for k in range(5)]
    assert as_variants(spelling.variants(spark.createDataFrame(chain, "word string, n long")))["abcdef"][1] == "abcdefghij"
    assert spelling.variants(df.limit(0)).count() == 0


def test_a_thinned_run_is_not_thinned_again(spark):
    """A run that becomes another thinned run of its document loses one letter, whichever of them comes first."""
    rng = random.Random(5)
    rows = []
    while len(rows) < 6:
        doc_id, run = len(rows), "".join(rng.choice("abcdefghij") for _ in range(9))
        h = zlib.crc32(f"{doc_id}:{run}".encode())
        shorter = run[:h % 9] + run[h % 9 + 1:]
        if h % 7 == 0 and zlib.crc32(f"{doc_id}:{shorter}".encode()) % 7 == 0:
            pair = [run, shorter] if doc_id % 2 else [shorter, run]
            rows.append((doc_id, " ".join(pair * 5)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["word"]: r["n"] for r in spelling.word_counts(docs, thinned=7).collect()}
    assert got == brute_words(rows, 6, 5, 7)


def test_no_table_of_words_is_broadcast(spark, monkeypatch):
    """Spark takes the exploded signatures for as large as the words, and would broadcast them below its threshold."""
    plans, write = [], spelling.staged

    def staged(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, name)

    monkeypatch.setattr(spelling, "staged", staged)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1g")
    try:
        got = spelling.variants(spark.createDataFrame([("abcdef", 5), ("abcdeg", 25), ("abcdeh", 125)], "word string, n long"))
        plans.append(got._jdf.queryExecution().executedPlan().toString())
        assert as_variants(got)["abcdef"] == ("abcdeh", "abcdeh", 5, 2, 125)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert sum("SortMergeJoin" in plan for plan in plans) >= 4
    assert not any("Broadcast" in plan for plan in plans)


def test_spelling_query(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()]
    df = QUERIES["op11_spelling"](spark, SF_DIR)
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    want = brute_variants(brute_words(rows, 6, 5, 199))
    assert as_variants(df) == want and any(v[0] for v in want.values())


# 12


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, (1 << 35) - 1)))
def test_packed_numbers(values):
    data, sizes = search.pack(np.array(values, np.int64))
    assert search.unpack(data.tobytes()).tolist() == values and len(sizes) == len(values) and sizes.sum() == len(data)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(1, 6), st.integers(1, 9)), min_size=1))
def test_fronts(rows):
    rows.sort(key=lambda r: r[0])
    block = np.array([r[0] for r in rows])
    block = np.cumsum(np.diff(block, prepend=block[0]) > 0)
    tf, n = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    front = search.fronts(block, tf, n)
    assert (np.diff(block[front]) >= 0).all()
    for b in set(block.tolist()):
        kept = {(tf[i], n[i]) for i in front if block[i] == b}
        for i in np.flatnonzero(block == b):
            assert any(t >= tf[i] and m <= n[i] for t, m in kept)


def brute_ranking(rows, items, k):
    find = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    docs = [(i, Counter(find.findall(lowered(t)))) for i, t in rows if i is not None]
    docs = [(i, c) for i, c in docs if c]
    n, total = len(docs), sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    out = []
    for item, text in items.items():
        scored = []
        for doc_id, c in docs:
            m = 100 - 75 + (75 * sum(c.values()) * n) // total
            score = sum(
                q * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m))
                for t, q in Counter(find.findall(lowered(text))).items() if t in c
            )
            if score > 0:
                scored.append((-score, doc_id))
        out += [(item, rank, doc_id, -score) for rank, (score, doc_id) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


def corpus(rng, n):
    vocabulary = [f"w{i}" for i in range(60)] + ["Ünder", "CAFÉ", "x1"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    texts = [" ".join(rng.choices(vocabulary, weights, k=rng.choice([1, 3, 30, 300]))) for _ in range(n)]
    return [*ODD_TEXTS, *texts, *texts[:40], "w0 " * 5000 + "w59"]


@pytest.mark.parametrize("segment_terms", [50, 3000, 10**9])
def test_ranking(spark, tmp_path, segment_terms, monkeypatch):
    rng = random.Random(segment_terms)
    texts = corpus(rng, 700)
    rows = list(zip(rng.sample(range(10**6), len(texts)), texts))
    rows[7] = (None, "w59 w58")
    docs = spark.createDataFrame([(i, t, "en", "s", "9", "w", "x") for i, t in rows], DOCS).repartition(3)
    items = {i: " ".join(rng.choices([f"w{j}" for j in range(60)], k=rng.choice([1, 2, 8, 40]))) for i in range(1, 40)}
    items |= {90: "W0 w0 w0", 91: "nowhere at-all", 92: "", 93: "CAFÉ Ünder café x1"}
    asked = [(i, t, "t") for i, t in items.items()] + [(None, "w1", "t"), (94, None, "t"), (1, items[1], "t"), (2, items[2] + "zz", "t")]
    queries = spark.createDataFrame(asked, "item_id long, text string, term string")
    monkeypatch.setattr(search, "QUERY_PAIRS", 100)
    index = search.build_index(docs, str(tmp_path / "index"), segment_terms)
    for k in (1, 10):
        got = search.search(index, queries, k)
        assert got.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
        assert sorted(map(tuple, got.collect())) == brute_ranking(rows, items, k)


def test_block_maxima_spare_blocks(spark, tmp_path, monkeypatch):
    """A common list beside a rare one is decompressed only where the rare term's documents are."""
    rows = [(i, "common " * (1 + i % 3) + ("rare " * 20 if i in (5, 3000) else "filler")) for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    index = search.build_index(docs, str(tmp_path / "index"))
    frame = index.filter("term IS NULL OR term IN ('common', 'rare')").toPandas()
    blocks = int((frame["term"] == "common").sum())
    frame["items"] = [[1] if b == 0 else None for b in frame["block"]]
    frame["repeats"] = frame["items"]
    frame["weight"] = [{"common": 1, "rare": 8000}.get(t, 0) for t in frame["term"]]
    total = index.filter("term IS NULL").first()
    segment = search.Segment(frame, total["postings"], total["terms"])
    opened = []
    monkeypatch.setattr(search.Segment, "postings", lambda self, b, read=search.Segment.postings: (opened.extend(b), read(self, b))[1])
    docs_found, _ = segment.best(segment.queries[1], 2)
    assert sorted(segment.doc_ids[docs_found]) == [5, 3000]
    assert blocks == 47 and len(opened) == 1 + 2


def test_search_of_nothing(spark, tmp_path):
    queries = spark.createDataFrame([(1, "alpha")], "item_id long, text string")
    docs = documents(spark, ["alpha beta", None, "..."])
    assert search.search(search.build_index(empty(spark), str(tmp_path / "a")), queries).count() == 0
    index = search.build_index(docs, str(tmp_path / "b"))
    assert search.search(index, queries.limit(0)).count() == 0
    assert search.search(index, spark.createDataFrame([(1, "gamma")], queries.schema)).count() == 0
    assert [tuple(r)[:3] for r in search.search(index, queries).collect()] == [(1, 1, 0)]


# 13


def brute_scan(text, templates, threshold):
    words = licenses.words_of(text or "")
    places, base, added, best = [], set(), set(), 0.0
    for phrase, label in licenses.PHRASES:
        p = phrase.split()
        at = [i for i in range(len(words)) if words[i:i + len(p)] == p]
        places += at
        base |= {label} if at else set()
    for label, notice in templates:
        own = set(licenses.words_of(notice))
        c = licenses.size_class(licenses.words_of(notice))
        for start in range(0, len(words), c):
            share = len(own & set(words[start:start + 2 * c])) / len(own)
            if share >= threshold:
                added.add(label)
                best = max(best, share)
    return (
        len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)),
        ",".join(sorted(base | added)), 1.0 if places else best,
    )


@pytest.mark.parametrize("threshold", [0.5, 0.9])
def test_scan(spark, threshold):
    rng = random.Random(3)
    notices = [t for _, t in licenses.TEMPLATES]
    vocabulary = sorted({w for t in notices for w in licenses.words_of(t)})
    texts = [*ODD_TEXTS, "MIT License mit license", "the mit-license", "mit\nLicense. GENERAL public   license", "mit licenses"]
    for notice in notices:
        words = notice.split()
        texts += [notice, "x " * 13 + notice, "y\n" * 1000 + "\n".join(words) + " z" * 50, notice.upper() + " " + notice]
        texts += [" ".join(rng.sample(words, len(words) - cut)) for cut in (1, 2, 3) if len(words) > 5]
    texts += [" ".join(rng.choices(vocabulary + ["foreign"] * 30, k=rng.choice([5, 60, 400]))) for _ in range(150)]
    docs = documents(spark, texts).unionByName(documents(spark, [notices[0], notices[0]], [None, 4]))
    got = licenses.scan(docs, threshold=threshold)
    assert got.columns == ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    want = [(i, *brute_scan(t, licenses.TEMPLATES, threshold)) for i, t in [*enumerate(texts), (None, notices[0]), (4, notices[0])]]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


def test_scan_of_nothing(spark):
    assert licenses.scan(empty(spark)).count() == 0
    docs = documents(spark, ["MIT License", None])
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in licenses.scan(docs, templates=[("none", "...")]).collect()}
    assert got == {0: ("mit", 1.0), 1: ("", 0.0)}
