"""Small cases of each operator: nulls, empty and long texts, ties, repeats, empty tables, extra columns."""

import gzip
import io
import random
import re
import zipfile
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidewatch.llm import (
    bpe, components, decontaminate, overlap, pq, preference, repair, rollups, rules, simhash, toxicity, tries, warc,
)
from tidewatch.llm.queries import QUERIES
from tidewatch.llm.storage import shared_folder

DOCS = "doc_id long, text string, lang string, source string, score string, words string, stats string"
WORD = public_tokenizers.path("word_bpe_49k.json")
BYTE = public_tokenizers.path("byte_bpe_50k.json")

ODD_TEXTS = [
    None, "", "   \t\n ", "one", "Two words", "naïve café Σίσυφος ΣΑΣ İstanbul ﬁne", "a<|endoftext|>b <|startoftext|> c",
    "don't we'll I'M x's", "汉字 テスト 👩‍🔬 42 3.14 --- !!", "áé  nbsp em\u0085nel", "word " * 3000,
    "tail  spaces   \n\n  x \n", "ſ ŉ ŀ ĳ ß ÿ × ÷", "x" * 5000, "tab\tnew\r\nline\x0bvt\x0cff",
]


def documents(spark, texts, ids=None):
    ids = ids or range(len(texts))
    return spark.createDataFrame([(i, t, "en", "s", "9", "w", "x") for i, t in zip(ids, texts)], DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)


# 1


def test_decontaminate(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron"
    other = item.split()
    close = " ".join(other[:14] + ["changed"])  # ten of eleven shingles
    far = " ".join(other[:8] + ["x"] + other[9:])
    docs = documents(spark, [
        None, "", "few words", "Start. " + item.upper().replace(" ", ", ") + "! end", "pre " * 20000 + close, far, item, item,
    ], [1, 2, 3, 4, 5, 6, 7, None])
    items = spark.createDataFrame(
        [(1, item, "t"), (1, item, "t"), (2, None, "t"), (3, "too short", "t"), (None, item, "t")], "item_id long, text string, lang string"
    )
    got = {(r["doc_id"], r["item_id"]): r["shared"] for r in decontaminate.contaminated(docs, items).collect()}
    assert got == {(4, 1): 11, (5, 1): 10, (7, 1): 11}
    kept = decontaminate.clean(docs, items)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] or -1 for r in kept.collect()) == [-1, 1, 2, 3, 6]
    assert decontaminate.contaminated(empty(spark), items).count() == 0
    assert decontaminate.contaminated(docs, items.limit(0)).count() == 0


@pytest.mark.parametrize("q", [1, 5, 6, 11, 33, 64, 65, 400])
def test_sketch_cannot_miss(spark, q):
    """However the lacking shingles are chosen, at least ``need`` of the sketch are left."""
    rows = spark.createDataFrame([(1, i) for i in range(q)], "key long, h long").withColumn("q", F.lit(q))
    sketch = decontaminate.sketches(rows, 0.8).collect()
    lacking = q - min(k for k in range(q + 1) if k >= 0.8 * q - 1e-9)
    assert len(sketch) - lacking >= sketch[0]["need"] >= 1


# 2


def test_packages_round_trip(spark, tmp_path):
    pages = spark.createDataFrame(
        [(1, "http://a", None, 0), (2, "http://b", "", 0), (3, "u\r\nX: y", "same é", 0), (4, None, "same é", 0),
         (5, "z", "long " * 50000, 0), (None, "n", "none", 0), (4, "t", "same é", 0)],
        "page_id long, url string, html string, key int",
    )
    rows = warc.roles(pages)
    got = warc.read_packages(warc.write_packages(rows, f"file://{tmp_path}/p", package_bytes=200)).collect()
    found = sorted((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in got)
    assert found[0] == (1, 0, "revisit", 2) and found[1] == (2, 0, "response", None)
    assert found[2] == (3, 7, "revisit", 4) and found[-1][:3] == (5, 250000, "response")
    assert [f[2] for f in found if f[0] == 4] == ["response", "response"]
    assert warc.read_packages(warc.write_packages(warc.roles(pages.limit(0)), f"file://{tmp_path}/e")).count() == 0
    small = warc.roles(pages, min_bytes=8).filter("page_id < 5 and record_type = 'revisit'")
    assert small.count() == 0
    # what is written is a ZIP file that other readers take
    for path in (tmp_path / "p").iterdir():
        with zipfile.ZipFile(path) as z:
            assert z.testzip() is None and z.namelist() == [warc.ARCHIVE, warc.INDEX]
            index = z.read(warc.INDEX).decode().splitlines()
            assert index[0] == warc.CDX and all(len(line.split(" ")) == 11 for line in index[1:])
            assert b"WARC-Date: 1970-01-01T00:00:00Z" in gzip.decompress(z.read(warc.ARCHIVE))


def test_many_packages_are_read_by_many_tasks(spark, tmp_path):
    pages = spark.range(60).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.repeat(F.col("id").cast("string"), 90).alias("html"))
    packages = warc.write_packages(warc.roles(pages).coalesce(1), f"file://{tmp_path}/p", package_bytes=400)
    got = warc.read_packages(packages)
    assert packages.count() >= 8 and got.select(F.spark_partition_id().alias("p")).distinct().count() >= 4
    assert got.count() == 60


def test_packages_with_several_archives(spark, tmp_path):
    """Two archives with index lines, one without, records of other types and other packages' names."""
    def archive(*records):
        packed = [warc._gzip(r) for r in records]
        return b"".join(packed), packed

    info = b"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:1>\r\nContent-Length: 2\r\n\r\nhi\r\n\r\n"
    plain = b"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:uuid:2>\r\nContent-Type: text/html\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    one, parts = archive(warc.record(1, "a", b"first" * 9, "response", None), warc.record(2, "b", b"first" * 9, "revisit", 1))
    two, single = archive(warc.record(3, "c", "é".encode(), "response", None))
    three, _ = archive(info, plain, warc.record(4, "d", b"x" * 3_000_000, "response", None), warc.record(5, "e", b"", "response", None))
    lines = warc.CDX + "\n" + warc.index_line("a", "2024-01-01", "D", "response", len(parts[0]), 0, "one.warc.gz")
    lines += warc.index_line("b", "2024-01-01", "D", "revisit", len(parts[1]), len(parts[0]), "one.warc.gz")
    with zipfile.ZipFile(tmp_path / "x.wacz", "w") as z:
        for name, data in (("archive/one.warc.gz", one), ("archive/two.warc.gz", two), ("archive/three.warc.gz", three), ("indexes/a.cdx", lines),
                           ("indexes/b.cdx", " CDX S V g\n%d 0 two.warc.gz\n" % len(single[0])), ("indexes/index.idx", "ignored"), ("pages/pages.jsonl", "{}")):
            z.writestr(name, data)
    packages = spark.createDataFrame([(str(tmp_path / "x.wacz"),)], "path string")
    got = {(r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"], len(r["body"])) for r in warc.read_packages(packages).collect()}
    assert got == {
        (1, "response", None, 45, 45), (2, "revisit", 1, 45, 0), (3, "response", None, 2, 2), (None, "resource", None, 3, 3),
        (4, "response", None, 3_000_000, 3_000_000), (5, "response", None, 0, 0),
    }
    assert list(warc.Reader(str(tmp_path / "x.wacz")).walk("archive/three.warc.gz", 7))[-1][0] > 0
    with zipfile.ZipFile(tmp_path / "y.wacz", "w") as z:
        z.writestr("indexes/a.cdx", lines)
    with pytest.raises(ValueError):
        warc.Reader(str(tmp_path / "y.wacz")).index()


@pytest.mark.parametrize("zip64", [False, True])
def test_reads_foreign_zip(tmp_path, zip64):
    path = tmp_path / "x.wacz"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_STORED) as z:
        z.comment = b"a comment"
        lines = b" CDX V S g\n2 3 data.warc.gz\n"
        for name, data in ((warc.ARCHIVE, b"0123456789"), (warc.INDEX, lines)):
            with z.open(name, "w", force_zip64=zip64) as f:
                f.write(data)
    reader = warc.Reader(str(path))
    assert reader.index() == {warc.ARCHIVE: [(2, 3)]}
    assert reader.range(reader.start_of(warc.ARCHIVE) + 2, 3) == b"234"
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a", b"x" * 100)
    (tmp_path / "y").write_bytes(packed.getvalue())
    with pytest.raises(ValueError):
        warc.Reader(str(tmp_path / "y")).start_of("a")
    (tmp_path / "z").write_bytes(b"no zip at all")
    with pytest.raises(ValueError):
        warc.Reader(str(tmp_path / "z"))


# 3


@pytest.mark.parametrize("seed", range(6))
def test_grammar_round_trip(seed):
    rng = np.random.default_rng(seed)
    words = [rng.integers(0, 50, rng.integers(1, 9)) for _ in range(40)]
    ids = np.concatenate([words[i] for i in rng.integers(0, 40, 3000)] + [np.full(500, 7)]) if seed else np.zeros(0, np.int64)
    rule, lengths, sequence = repair.compress(ids, 50, least=2)
    shard = repair.Shard(50, repair.pack(rule.ravel()), repair.pack(lengths), repair.pack(sequence))
    assert (shard.ids(0, len(ids)) == ids).all()
    assert not seed or len(sequence) + 3 * len(rule) < len(ids)
    for _ in range(50 if seed else 0):
        a, b = sorted(rng.integers(0, len(ids) + 1, 2))
        assert (shard.ids(a, b) == ids[a:b]).all()


def test_words_are_put_together_from_pieces():
    """Only words not met before are split, only pieces not met before are encoded; the ids are the library's."""
    parts = ["a", " word", "word", "  ", " ", "\n", "\t", "'s", "'S", "'", "don't", " it's,", "12", " 3x", "é", " Œuvre", "…", "!?", " —", "<|endoftext|>", "漢"]
    rng = np.random.default_rng(3)
    texts = ["", " ", *parts, *("".join(parts[i] for i in rng.integers(0, len(parts), n)) for n in rng.integers(1, 40, 300))]
    tokenizer, encoder, encoded = Tokenizer.from_file(BYTE), repair.Encoder(BYTE), []
    whole = encoder.model

    class Counted:
        def encode_batch_fast(self, strings, **options):
            encoded.extend(strings[0].split("Ā")[:-1])
            return whole.encode_batch_fast(strings, **options)

    encoder.model = Counted()
    for _ in range(2):
        for at in range(0, len(texts), 50):
            ids, sizes = encoder.encode(pa.array(texts[at:at + 50]))
            want = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts[at:at + 50]]
            assert sizes.tolist() == list(map(len, want))
            assert ids.tolist() == [i for w in want for i in w]
    assert len(encoded) == len(set(encoded)) < 200


@pytest.mark.parametrize("least", [2, 3, 8])
def test_no_frequent_pair_is_left(least):
    """Rounds go on until no pair occurs ``least`` times side by side; colliding hashes count as well."""
    rng = np.random.default_rng(least)
    ids = rng.zipf(1.3, 20_000) % 3000
    _, _, sequence = repair.compress(ids, 3000, least)
    apart, last = {}, {}
    for i, pair in enumerate(zip(sequence[:-1].tolist(), sequence[1:].tolist())):
        if last.get(pair) != i - 1:
            apart[pair] = apart.get(pair, 0) + 1
            last[pair] = i
    assert max(apart.values()) < least


def test_shards_of_odd_texts(spark):
    path = shared_folder(spark, "odd")
    order = [7, 3, 11, 0, 5, 2, 9, 14, 1, 4, 6, 8, 10, 12, 13]
    docs = documents(spark, [ODD_TEXTS[i] for i in order] + ["lost"], order + [None])
    repair.write_shards(docs, path, BYTE, end_id=2, shard_ids=500)
    tokenizer, start, want = Tokenizer.from_file(BYTE), 0, []
    for i, text in enumerate(ODD_TEXTS):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, repair.read_documents(spark, path).collect())) == want
    path = shared_folder(spark, "none")
    repair.write_shards(empty(spark), path, BYTE)
    assert repair.read_documents(spark, path).count() == 0


# 4


def test_embeddings_against_brute_force(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(60, 16))
    vectors = [v + rng.normal(scale=s, size=16) for v in base for s in (0, 0.05, 0.1, 0.2)] + [base[0], 2 * base[0]]
    table = [(i, [float(x) for x in v], 0) for i, v in enumerate(vectors)]
    odd = [(1000, None), (1001, []), (1002, [0.0] * 16), (1003, [None] + [1.0] * 15), (1004, [float("nan")] * 16), (1005, [float("inf")] * 16), (1006, [1.0, 2.0])]
    df = spark.createDataFrame(table + [(i, v, 0) for i, v in odd] + [(None, [1.0] * 16, 0)], "vec_id long, embedding array<double>, id int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in pq.near_duplicates(df).collect()}
    x = np.array(vectors)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.9
    np.fill_diagonal(near, True)
    reach = near.copy()
    for _ in range(10):
        reach = (reach.astype(int) @ reach.astype(int)) > 0
    want = {i: (int(near[i].sum()) - 1, int(np.flatnonzero(reach[i])[0]), int(np.flatnonzero(reach[i])[0]) == i) for i in range(len(x))}
    want |= {i: (0, i, True) for i, _ in odd}
    assert got == want
    assert pq.near_duplicates(df.limit(0)).count() == 0


def spread_vectors(kind, n, rng):
    """``n`` unit vectors in 64 dimensions and ``n // 3`` more at a cosine of about 0.85 to 0.97 to some of them."""
    scale = np.ones(64) if kind == "isotropic" else 1 / np.arange(1, 65) ** 0.5
    x = rng.normal(size=(n, 64)) * scale
    x = np.r_[x, x[:n // 3] + rng.uniform(0.25, 0.6, (n // 3, 1)) * rng.normal(size=(n // 3, 64)) * scale]
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def counted_links(spark, x, weight, **options):
    df = spark.createDataFrame([(i, v.tolist(), int(n)) for i, (v, n) in enumerate(zip(x, weight))], "id long, unit array<double>, weight long")
    counts = np.zeros(len(x), int)
    for r in pq.distinct_links(df.repartition(4), 0.9, **options).filter("kind = 'links'").collect():
        counts[r["a"]] += r["n"]
    near = x @ x.T >= 0.9
    np.fill_diagonal(near, False)
    return counts, near @ weight


@pytest.mark.parametrize("kind", ["isotropic", "anisotropic"])
def test_calibrated_probes_find_the_links(spark, kind):
    """Two hundred lists: nearly all links with calibrated probes, none counted twice; every link with ``exact``."""
    rng = np.random.default_rng(6)
    x = spread_vectors(kind, 4500, rng)
    weight = rng.integers(1, 4, len(x))
    got, want = counted_links(spark, x, weight, per_list=30)
    assert (got <= want).all() and want.sum() > 1000
    assert got.sum() >= 0.999 * want.sum()
    some = np.r_[0:800, 4500:5300]  # vectors and their partners
    got, want = counted_links(spark, x[some], weight[some], per_list=25, exact=True)
    assert (got == want).all() and want.sum() > 100


def test_few_lists_are_probed():
    rng = np.random.default_rng(7)
    x = spread_vectors("anisotropic", 15_000, rng)
    q = pq.fit(x, 80)
    probes = [pq.calibrated_probes(q, x, 0.9, recall) for recall in (0.9, 0.99, 0.9999)]
    assert probes == sorted(probes) and probes[-1] < 40


def test_planted_links_reach_the_query(spark, tmp_path):
    rng = np.random.default_rng(8)
    x = spread_vectors("anisotropic", 600, rng).astype(np.float32)
    x = np.r_[x, x[:5], 3 * x[5:7]]
    rows = [(i, [float(v) for v in e], 0) for i, e in enumerate(x)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in QUERIES["op4_embedding_dedup"](spark, str(tmp_path)).collect()}
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near = unit @ unit.T >= 0.9
    reach = near.copy()
    for _ in range(10):
        reach = (reach.astype(int) @ reach.astype(int)) > 0
    assert got == {i: (int(near[i].sum()) - 1, int(np.flatnonzero(reach[i])[0])) for i in range(len(x))}
    assert sum(n for n, _ in got.values()) > 100


# 5


def test_rollup_batches_are_idempotent(spark):
    image = "struct<source:string,lang:string,tokenizer:string,n_tokens:bigint>"
    schema = f"change_id string, before {image}, after {image}, extra int"
    a, b, c = ("s", "en", "t1", 10), ("s", "en", "t1", 13), (None, "de", "t1", None)
    first = spark.createDataFrame([("1", None, a, 0), ("2", None, a, 0), ("2", None, a, 1), ("3", None, c, 0), (None, None, b, 0), (None, None, b, 0)], schema)
    second = spark.createDataFrame([("4", a, b, 0), ("5", a, None, 0)], schema)
    store = shared_folder(spark, "store")
    for _ in range(2):
        rollups.commit(store, "b1", first)
        rollups.commit(store, "b2", second)
        got = {(r["source"], r["lang"], r["tokenizer"]): (r["n_docs"], r["n_tokens"]) for r in rollups.totals(spark, store).collect()}
        assert got == {("s", "en", "t1"): (3, 39), (None, "de", "t1"): (1, 0)}
    rollups.commit(store, "b3", first.limit(0))
    assert rollups.totals(spark, store).count() == 2


# 6


def test_preference_rows(spark):
    schema = "pair_id long, turn long, role string, text string, segment string"
    chosen = spark.createDataFrame([
        (1, 0, "user", "q", ""), (1, 0, "user", "q", ""), (1, 1, "assistant", "good", ""), (2, 0, "user", None, ""), (3, 0, "assistant", "only", ""),
        (None, 0, "user", "lost", ""), (4, None, "user", "lost", ""),
    ], schema)
    rejected = spark.createDataFrame([
        (1, 0, "user", "q", ""), (1, 1, "assistant", "bad", ""), (1, 2, "user", "why", ""), (2, 0, "user", "", ""),
    ], schema)
    got = sorted(map(tuple, preference.preference_rows(chosen, rejected).collect()))
    assert got == [
        (1, "chosen", 1, "assistant", "<|assistant|>\ngood\n", 14, 19), (1, "prompt", 0, "user", "<|user|>\nq\n", 11, 11),
        (1, "rejected", 1, "assistant", "<|assistant|>\nbad\n", 14, 18), (1, "rejected", 2, "user", "<|user|>\nwhy\n", 13, 13),
        (2, "prompt", 0, "user", "<|user|>\n\n", 10, 10), (3, "chosen", 0, "assistant", "<|assistant|>\nonly\n", 14, 19),
    ]
    assert preference.preference_rows(chosen.limit(0), rejected.limit(0)).count() == 0


def test_branched_answers(spark):
    """No turn is lost, and both sides part at the picked answer."""
    rng = random.Random(2)
    talks = {c: [(t, "assistant" if t % 2 else "user", f"{c}/{t}") for t in range(rng.randint(1, 9))] for c in range(40)}
    talks[6] = [(0, "user", "no answer"), (1, None, None)]
    talks[8] = talks[9] = [(0, "assistant", "same")]
    rows = [(c, t, role, text, "x") for c, turns in talks.items() for t, role, text in turns]
    rows += [(1, 0, "user", "1/0", "x"), (None, 1, "user", "a", "x"), (1, None, "user", "a", "x")]
    conversations = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, said string")
    chosen, rejected = ({(r["pair_id"], r["turn"]): (r["role"], r["text"]) for r in side.collect()} for side in preference.branched_answers(conversations))
    assert chosen == {(c, t): (role or "", text or "") for c, turns in talks.items() for t, role, text in turns}
    assert set(rejected) == set(chosen)
    depths = set()
    for c, turns in talks.items():
        answers = [t for t, role, _ in turns if role == "assistant"]
        apart = [t for t, *_ in turns if chosen[c, t] != rejected[c, t]]
        if not answers or c in (8, 9):
            assert not apart
            continue
        at = min(answers, key=lambda t: ((c * 31 + t * 17) % 101, t))
        last = [text for _, role, text in talks.get(c ^ 1, []) if role == "assistant"][-1:]
        assert apart == [at] and rejected[c, at] == ("assistant", *(last or [""]))
        depths.add((answers.index(at), len(answers) - answers.index(at)))
    assert len(depths) > 5
    assert preference.branched_answers(conversations.limit(0))[1].count() == 0


# 7 and 10


def test_tree_rules():
    text = """DecisionTreeClassificationModel: depth=2
  If (feature 0 <= 0.5)
   If (feature 1 <= 2.0)
    Predict: 0.0
   Else (feature 1 > 2.0)
    Predict: 1.0
  Else (feature 0 > 0.5)
   Predict: 1.0"""
    got = {r.bounds for r in rules.tree_rules(text, ["a", "b"])}
    assert got == {
        (("a", None, 0.5),), (("a", None, 0.5), ("b", None, 2.0)), (("a", None, 0.5), ("b", 2.0, None)), (("a", 0.5, None),),
    }


def test_classifiers_on_odd_tables(spark):
    docs = documents(spark, [*ODD_TEXTS, "again"], [*range(len(ODD_TEXTS)), None])
    labels = spark.createDataFrame([(1, 1), (3, 1), (3, 0), (None, 1), (4, None)], "doc_id long, label int")
    for given in (labels, labels.limit(0)):
        model = rules.fit_labelled(rules.text_statistics(docs), given, F.lit(True))
        out = rules.scored(docs, model)
        assert out.columns == [c for c in docs.columns if c != "score"] + ["score"] and out.count() == docs.count()
        assert all(0 <= r["score"] <= 1 for r in out.select(out["score"].cast("double").alias("score")).collect())
        heat = toxicity.scored(docs, toxicity.fit(docs, given, F.lit(True)))
        assert heat.count() == docs.count() and all(0 <= r["score"] <= 1 for r in heat.collect())
    assert rules.scored(empty(spark), model).count() == 0
    assert toxicity.scored(empty(spark), toxicity.fit(empty(spark), labels, F.lit(True))).count() == 0


def test_misspelt_words_share_vectors():
    rng = random.Random(1)
    plain = ["river", "stone", "cloud", "meadow", "window", "garden", "paper", "letter"]
    texts = [" ".join(rng.choices(plain, k=30) + (["dreadful", "horrid"] if k % 2 else [])) for k in range(200)]
    model = toxicity.train(texts, [k % 2 for k in range(200)])
    odds = dict(zip(["dreadfull", "horridd", "river", "garden"], model.words(["dreadfull", "horridd", "river", "garden"])))
    assert min(odds["dreadfull"], odds["horridd"]) > max(odds["river"], odds["garden"])
    assert model.empty < 0


# 8


@pytest.mark.parametrize("depth", [0, 3, 6])
def test_trie_links(depth):
    rng = np.random.default_rng(depth)
    base = rng.integers(0, 1 << 63, 80, dtype=np.uint64)
    flips = [base] + [base ^ (np.uint64(1) << rng.integers(0, 64, 80, dtype=np.uint64)) for _ in range(3)]
    fps = np.unique(np.concatenate(flips))
    want = {(int(a), int(b)) for i, a in enumerate(fps) for b in fps[:i] if int(a ^ b).bit_count() <= 2}
    want = {tuple(sorted(p)) for p in want}
    keys, side, sent = [], [], []
    for f in fps:
        p = int(f) >> (64 - depth) if depth else 0
        for other in range(1 << depth):
            if (p ^ other).bit_count() <= 2:
                keys.append(min(p, other) * (1 << depth) + max(p, other))
                side.append(int(p > other))
                sent.append(f)
    sent = np.array(sent, np.uint64)
    a, b = simhash.trie_links(np.array(keys), np.array(side), sent, depth, 2)
    got = [tuple(sorted((int(x), int(y)))) for x, y in zip(sent[a], sent[b])]
    assert len(got) == len(set(got)) and set(got) == want


def test_simhash_odd_rows(spark):
    docs = documents(spark, [*ODD_TEXTS, "lost", "one"], [*range(len(ODD_TEXTS)), None, 3])
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(ODD_TEXTS) + 1
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[0]["fingerprint"] == "0" * 16 and by_id[2]["component_id"] == 0
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] if r["doc_id"] is not None else -1 for r in kept.collect())[:2] == [-1, 0]
    assert simhash.near_duplicates(empty(spark)).count() == 0


def test_near_copies_against_brute_force(spark):
    """Every pair at 0.8 or more of the five-word shingles goes, and rows of other texts stay."""
    rng = random.Random(4)
    texts = ["", None, " ", "One two", "one  two", "three"]
    for length in (30, 120, 900):
        for _ in range(12):
            words = [f"w{rng.randrange(4000)}" for _ in range(length)]
            for changes in (0, 1, 2, 3, length // 60):  # chains, and pairs on both sides of the threshold
                words = list(words)
                for _ in range(changes):
                    words[rng.randrange(length)] = f"x{rng.randrange(10**6)}"
                texts.append(" ".join(words))
    rng.shuffle(texts)
    rows = [(i // 2 if i % 7 else None, t) for i, t in enumerate(texts)]  # ids repeat over texts, or are missing
    docs = documents(spark, [t for _, t in rows], [i for i, _ in rows]).repartition(5)

    def shingles(text):
        words = (text or "").lower().split()
        return {" ".join(words[i:i + 5]) for i in range(max(1, len(words) - 4))}

    sets = [shingles(t) for t in texts]
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if len(a & b) >= 0.8 * len(a | b):
                root[find(i)] = find(j)
    groups = {}
    for k, (i, t) in enumerate(rows):
        groups.setdefault(find(k), []).append((i is None, i or 0))
    got = simhash.one_of_each(docs).collect()
    place = {t or "": find(k) for k, t in enumerate(texts)}
    assert {place[r["text"] or ""]: (r["doc_id"] is None, r["doc_id"] or 0) for r in got} == {g: min(m) for g, m in groups.items()}
    assert len(got) == len(groups)


def test_simhash_pieces_meet():
    """Near copies are found by pieces of a long SimHash, in dense groups too, and nothing else is."""
    rng = np.random.default_rng(3)
    sets = []
    for size in (1, 9, 40, 300):
        for copies in (1, 6, 90):
            base = rng.integers(0, 1 << 63, size, dtype=np.uint64)
            for _ in range(copies):
                base = base.copy()
                if copies > 1 and size > 1:  # a chain: one text differs little from the one before
                    base[rng.integers(0, size, max(1, size // 11))] = rng.integers(0, 1 << 63, dtype=np.uint64)
                sets.append(np.unique(base))
    prefix, pieces, limit = overlap.layout(len(sets), 0.8)
    width = prefix + overlap.TRIE_BITS
    bits = np.stack([overlap.long_simhash(s, -(-(overlap.CHECK_BITS + pieces * width) // 64)) for s in sets])
    assert abs(bits[[len(s) > 1 for s in sets]].mean() - 0.5) < 0.02
    signs = np.packbits(bits[:, :overlap.CHECK_BITS], axis=1, bitorder="little").view(np.uint64)
    cut = bits[:, overlap.CHECK_BITS:overlap.CHECK_BITS + pieces * width].reshape(len(sets), pieces, width)
    k = ((cut @ (1 << np.arange(width))) + (np.arange(pieces) << width)).ravel()
    order = np.argsort(k, kind="stable")
    row = order // pieces
    a, b = overlap.piece_links(k[order], signs[row], limit)
    far = np.bitwise_count(signs[row[a]] ^ signs[row[b]]).sum(1)
    assert far.max() <= limit and len(a) < 4 * len(k)
    # the links connect exactly what brute force over pieces and further bits connects
    same = np.zeros((len(sets), len(sets)), bool)
    for p in range(pieces):
        top = (cut[:, None, p, overlap.TRIE_BITS:] == cut[None, :, p, overlap.TRIE_BITS:]).all(2)
        same |= top & ((cut[:, None, p, :overlap.TRIE_BITS] != cut[None, :, p, :overlap.TRIE_BITS]).sum(2) <= overlap.BUDGET)
    same &= np.bitwise_count(signs[:, None] ^ signs[None]).sum(2) <= limit
    want = tries.roots(len(sets), *np.nonzero(same))
    assert (tries.roots(len(sets), row[a], row[b]) == want).all()
    for i, s in enumerate(sets):
        for j in range(i):
            shared = len(np.intersect1d(s, sets[j]))
            assert shared < 0.8 * (len(s) + len(sets[j]) - shared) or want[i] == want[j]


def test_toxicity_goes_through_the_ids_once(spark, monkeypatch):
    """Counts and draws of both labels read one written table of labelled ids."""
    written, write = [], toxicity.staged
    monkeypatch.setattr(toxicity, "staged", lambda df, name: written.append(df.columns) or write(df, name))
    docs = documents(spark, [f"{'bad' if i % 2 else 'good'} word{i % 5}" for i in range(40)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(1, 0), (99, 1), (3, 1), (None, 1)], "doc_id long, label int")
    model = toxicity.fit(docs, labels, F.lit(True))
    assert written == [["doc_id", "label"]]
    odds = model.words(["bad", "good"])
    assert odds[0] > odds[1]


def test_a_larger_table_needs_no_more_pieces():
    """Rows and bits a text stay the same up to millions of texts, and other texts of theirs fail the further bits."""
    prefix, pieces, limit = overlap.layout(2_300_000, 0.8)
    assert (prefix, pieces, limit) == overlap.layout(190_000, 0.8)
    assert overlap.layout(12_000_000, 0.8)[1] <= 1.5 * pieces
    near = overlap._at_most(overlap.BUDGET, overlap.TRIE_BITS, 0.5) * overlap._at_most(limit, overlap.CHECK_BITS, 0.5)
    assert pieces * 12_000_000 / (1 << overlap.layout(12_000_000, 0.8)[0]) * near < 1e-2  # false links a text


def test_tries_joined_with_themselves():
    rng = np.random.default_rng(9)
    for trees, size, budget, step in ((1, 1, 2, 8), (3, 40, 2, 8), (2, 1500, 2, 8), (2, 300, 3, 4), (1, 2, 0, 16)):
        leaves = np.unique((rng.integers(0, trees, size) << 16) | rng.integers(0, 1 << 16, size) & rng.integers(0, 1 << 16, size))
        a, b = tries.self_joined(leaves, 16, budget, step)
        differing = np.bitwise_count(leaves[:, None] ^ leaves[None]) + 99 * (leaves[:, None] >> 16 != leaves[None] >> 16)
        want = [(i, j) for i, j in zip(*np.nonzero(differing <= budget)) if i < j]
        assert sorted(zip(a.tolist(), b.tolist())) == want


def test_rows_that_meet_no_other_make_no_links():
    for k in ([5], [0, 0xFFFF], [1 << 16, 2 << 16, 2 << 16 | 0xFF]):
        a, b = overlap.piece_links(np.array(k), np.zeros((len(k), 3), np.uint64), 58)
        assert len(a) == len(b) == 0


def test_pairs_of_ranges(monkeypatch):
    monkeypatch.setattr(overlap, "PAIRS", 50)
    rng = np.random.default_rng(2)
    for _ in range(50):
        n = rng.integers(0, 8)
        al, bl = rng.integers(0, 50, n), rng.integers(0, 50, n)
        ah, bh = al + rng.integers(0, 30, n), bl + rng.integers(0, 130, n)
        got = [*overlap._products(al, ah, bl, bh)]
        assert all(len(i) == len(j) <= 50 for i, j in got)
        pairs = [pair for i, j in got for pair in zip(i.tolist(), j.tolist())]
        want = [(i, j) for a, b, c, d in zip(al, ah, bl, bh) for i in range(a, b) for j in range(c, d)]
        assert sorted(pairs) == sorted(want)


def test_word_hashes(monkeypatch):
    texts = ["", " a  b", "A\tb\x0bc\x0cd\re\nf ", "\x00 \x1f\x85", "Éé É é\u00a0x\u2003y", "x" * 64, "X" * 64 + " " + "x" * 65, "x" * 65, "ab", "", "a b"]
    words = [[w for w in re.split(rb"[ \t\n\x0b\x0c\r]+", t.encode().lower()) if w] for t in texts]
    for held in (1 << 17, 3):
        monkeypatch.setattr(overlap, "HASHED_BYTES", held)
        monkeypatch.setattr(overlap, "HASHED_WORDS", held)
        for skip in (0, 1, 4):
            column = pa.array([t.encode() for t in texts], pa.large_binary() if skip == 1 else pa.binary())[skip:]
            hashes, bounds = overlap.word_hashes(column)
            flat = [w for of in words[skip:] for w in of]
            assert np.diff(bounds).tolist() == [len(of) for of in words[skip:]] and len(hashes) == len(flat)
            assert len(set(zip(flat, hashes.tolist()))) == len(set(flat)) == len(set(hashes.tolist()))
            sets = [*overlap._sets(column, 2)]
            assert all((s == overlap.shingle_set(hashes[a:b], 2)).all() for s, a, b in zip(sets, bounds[:-1], bounds[1:]))
            assert len(sets) == len(column)


def test_simhashes_of_many_sets(monkeypatch):
    """Bits counted over blocks of many sets are those of a plain majority."""
    monkeypatch.setattr(overlap, "BLOCKS", 3)
    rng = np.random.default_rng(6)
    sets = [np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64)) for n in (1, 2, 63, 64, 65, 500, 1, 128, 20_000)]
    got = overlap.long_simhashes(sets, 5)
    seeds = np.random.default_rng(11).integers(0, 1 << 63, 5, dtype=np.uint64)
    for s, bits in zip(sets, got):
        mixed = (s[:, None] ^ seeds) * np.uint64(overlap.MIX)
        mixed ^= mixed >> np.uint64(32)
        mixed *= np.uint64(0xD6E8FEB86659FD93)
        mixed ^= mixed >> np.uint64(29)
        each = np.unpackbits(mixed.view(np.uint8), axis=1, bitorder="little")
        assert (bits == (2 * each.sum(axis=0, dtype=np.int64) + each[0] > len(s))).all()


def test_groups_are_confirmed_across_batches(spark, monkeypatch):
    """Groups and blocks of groups that begin in one batch and end in another are confirmed whole."""
    monkeypatch.setattr(overlap, "BLOCK", 60)
    rng = random.Random(8)
    texts = []
    for _ in range(12):
        words = [f"w{rng.randrange(5000)}" for _ in range(60)]
        for copy in range(5):
            texts.append(" ".join(words[:-1] + [f"x{copy}"]))
    texts += [" ".join(f"y{rng.randrange(5000)}" for _ in range(60)) for _ in range(20)]
    docs = documents(spark, texts)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, 7)
    try:
        kept = sorted(r["doc_id"] for r in simhash.one_of_each(docs).collect())
    finally:
        spark.conf.set(key, before)
    assert kept == [*range(0, 60, 5), *range(60, 80)]


def test_components(spark):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(40)] + [(100, 100), (7, 5)] + [(200 + rng.randrange(30), 200 + rng.randrange(30)) for _ in range(60)]
    want = {}
    for a, b in links:
        want.setdefault(a, a), want.setdefault(b, b)
    for _ in range(len(want)):
        for a, b in links:
            want[a] = want[b] = min(want[a], want[b])
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    want.pop(100)
    assert got == want


# 9


def test_bpe_of_odd_texts(spark):
    docs = documents(spark, [*ODD_TEXTS, ODD_TEXTS[5], "lost"], [*range(len(ODD_TEXTS)), 5, None])
    tokenizer = Tokenizer.from_file(WORD)
    found = {}
    for row in bpe.encoded(docs, WORD, parts=3).collect():
        class Block:
            docs, positions = bytes(row["docs"]), bytes(row["positions"])
            table = row["table"]
        found |= {i: ids.tolist() for i, ids in bpe.texts_of(Block)}
    assert found == {i: tokenizer.encode(t or "", add_special_tokens=False).ids for i, t in enumerate(ODD_TEXTS)}
    pieces = bpe.Pieces(WORD)
    assert all(pieces.decode(np.array(ids, int)) == tokenizer.decode(ids, skip_special_tokens=False) for ids in found.values())
    assert bpe.round_trip(empty(spark), WORD).count() == 0
    assert bpe.round_trip(docs, WORD).filter("doc_id = 5").count() == 2
