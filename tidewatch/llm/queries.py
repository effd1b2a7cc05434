"""One query per operator, each over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewatch.llm import (
    bpe, decontaminate, licenses, pq, preference, repair, rollups, rules, search, simhash, spelling, toxicity, warc,
)
from tidewatch.llm.registry import ORACLES, QUERIES, query, table
from tidewatch.llm.storage import shared_folder, staged

__all__ = ["ORACLES", "QUERIES"]


@query("op1_decontaminate", r"""
WITH d AS (SELECT doc_id, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM
           (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents
            WHERE doc_id IS NOT NULL AND text IS NOT NULL)),
ds AS (SELECT DISTINCT doc_id, concat_ws(' ', w, b, c, d, e) AS s FROM
       (SELECT *, lead(w, 1) OVER v AS b, lead(w, 2) OVER v AS c, lead(w, 3) OVER v AS d, lead(w, 4) OVER v AS e
        FROM d WINDOW v AS (PARTITION BY doc_id ORDER BY i)) WHERE e IS NOT NULL),
i AS (SELECT item_id, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM
      (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM benchmark)),
si AS (SELECT DISTINCT item_id, concat_ws(' ', w, b, c, d, e) AS s FROM
       (SELECT *, lead(w, 1) OVER v AS b, lead(w, 2) OVER v AS c, lead(w, 3) OVER v AS d, lead(w, 4) OVER v AS e
        FROM i WINDOW v AS (PARTITION BY item_id ORDER BY i)) WHERE e IS NOT NULL),
q AS (SELECT item_id, count(*) AS q FROM si GROUP BY 1)
SELECT doc_id, item_id, count(*) AS shared, any_value(q) AS item_shingles, count(*) / any_value(q)::DOUBLE AS containment
FROM si JOIN ds USING (s) JOIN q USING (item_id) GROUP BY 1, 2 HAVING count(*) >= 0.8 * any_value(q) - 1e-9
""")
def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item."""
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: The two ways of counting tokens in the rollup query.
PIECES = r"\p{L}+|\p{N}+|[^\s\p{L}\p{N}]+"
WHITE = r"[^ \t\n\r]+"


def _counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        "doc_id", "source", "lang", F.sha2(text, 256).alias("digest"),
        F.regexp_count(text, F.lit(WHITE)).cast("long").alias("white"),
        F.regexp_count(text, F.lit(PIECES)).cast("long").alias("pieces"),
    )


def _image(tokenizer: str, count) -> object:
    return F.struct("source", "lang", F.lit(tokenizer).alias("tokenizer"), count.alias("n_tokens")).cast(rollups.IMAGE)


@query("op5_token_rollup", r"""
WITH d AS (SELECT doc_id, source, lang, coalesce(text, '') AS t FROM documents),
k AS (SELECT min(doc_id) AS doc_id FROM d GROUP BY t),
c AS (SELECT source, lang, len(regexp_extract_all(t, '[^ \t\n\r]+')) AS white,
      len(regexp_extract_all(t, '\p{L}+|\p{N}+|[^\s\p{L}\p{N}]+')) + 1 AS pieces FROM d SEMI JOIN k USING (doc_id))
SELECT source, lang, 'white-1' AS tokenizer, count(*) AS n_docs, sum(white)::BIGINT AS n_tokens FROM c GROUP BY ALL
UNION ALL SELECT source, lang, 'pieces-2', count(*), sum(pieces)::BIGINT FROM c GROUP BY ALL
""")
def op5_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after four batches: inserts by two tokenizers, exact copies deleted, counts revised.

    The second tokenizer's counts are revised to include an end id.  The batch of deletes arrives
    twice, and one batch is sent again after the last.
    """
    counted = staged(_counted(spark, sf_dir), "counted")
    first = counted.groupBy("digest").agg(F.min("doc_id").alias("first"))
    marked = counted.join(first, "digest")
    none = F.lit(None).cast(rollups.IMAGE)

    def changes(df: DataFrame, tokenizer: str, before, after) -> DataFrame:
        return df.select(F.concat(F.lit(f"{tokenizer}/"), "doc_id").alias("change_id"), before.alias("before"), after.alias("after"))

    white, pieces = _image("white-1", F.col("white")), _image("pieces-1", F.col("pieces"))
    revised = _image("pieces-2", F.col("pieces") + 1)
    copies, kept = marked.filter("doc_id > first"), marked.filter("doc_id = first")
    store = shared_folder(spark, "rollup")
    inserts = changes(counted, "white-1", none, white)
    deletes = changes(copies, "white-1", white, none).unionByName(changes(copies, "pieces-1", pieces, none))
    rollups.commit(store, "1-white", inserts)
    rollups.commit(store, "2-pieces", changes(counted, "pieces-1", none, pieces))
    rollups.commit(store, "3-copies", deletes)
    rollups.commit(store, "3-copies", deletes)
    rollups.commit(store, "4-end-ids", changes(kept, "pieces-1", pieces, revised))
    rollups.commit(store, "1-white", inserts)
    return rollups.totals(spark, store)


@query("op6_preference", r"""
WITH t AS (SELECT conv_id AS pair_id, turn, min(row(coalesce(role, ''), coalesce(text, ''))) AS said FROM conversations
           WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY ALL),
a AS (SELECT pair_id, min(row((pair_id % 1009 * 31 + turn % 1009 * 17) % 101, turn))[2] AS turn, arg_max(said[2], turn) AS answer
      FROM t WHERE said[1] = 'assistant' GROUP BY 1),
w AS (SELECT a.pair_id, a.turn, coalesce(o.answer, '') AS wrong FROM a LEFT JOIN a o ON o.pair_id = xor(a.pair_id, 1)),
b AS (SELECT t.pair_id, t.turn, said AS cs, row(said[1], coalesce(wrong, said[2])) AS rs FROM t LEFT JOIN w USING (pair_id, turn)),
m AS (SELECT pair_id, min(turn) AS cut FROM b WHERE cs IS DISTINCT FROM rs GROUP BY 1),
p AS (SELECT pair_id, 'prompt' AS part, turn, cs AS said FROM b LEFT JOIN m USING (pair_id) WHERE cut IS NULL OR turn < cut
      UNION ALL SELECT pair_id, 'chosen', turn, cs FROM b JOIN m USING (pair_id) WHERE turn >= cut
      UNION ALL SELECT pair_id, 'rejected', turn, rs FROM b JOIN m USING (pair_id) WHERE turn >= cut),
o AS (SELECT pair_id, part, turn, said[1] AS role, '<|' || said[1] || '|>' || chr(10) || said[2] || chr(10) AS segment FROM p)
SELECT *, CASE WHEN part <> 'prompt' AND role = 'assistant' THEN length(role) + 5 ELSE length(segment) END AS loss_from,
       length(segment) AS loss_to FROM o
""")
def op6_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation against itself with one answer, at differing depths, out of another conversation."""
    chosen, rejected = preference.branched_answers(table(spark, sf_dir, "conversations"))
    return preference.preference_rows(chosen, rejected)


def remainder(n: int):
    """crc32 of the doc_id's decimal text, modulo ``n``."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


@query("op7_quality")
def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learnt from three of four folds."""
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    stats = staged(rules.text_statistics(docs), "statistics")
    model = rules.fit_labelled(stats, labels, remainder(4) != 2)
    return stats.withColumn("score", model.score()).select(
        "doc_id", (remainder(4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted")
    )


@query("op8_simhash")
def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query("op10_toxicity")
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learnt from four of five folds."""
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"))
    model = toxicity.fit(docs, labels, remainder(5) != 0)
    return toxicity.scored(docs, model).select(
        "doc_id", (remainder(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


@query("op9_bpe")
def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every document, as digests."""
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op2_warc", r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages WHERE page_id IS NOT NULL),
f AS (SELECT h, max(page_id) AS first FROM p GROUP BY 1),
d AS (SELECT h, replace(unhex(sha1(h))::BIT::VARCHAR, ' ', '') AS bits FROM f),
e AS (SELECT h, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      1 + (substr(bits, i * 5 + 1, 5)::BIT::INTEGER), 1)), '') AS digest FROM d)
SELECT page_id, strlen(h)::BIGINT AS payload_bytes, digest AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM p JOIN f USING (h) JOIN e USING (h)
""")
def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written as a WARC record in ZIP packages, and what the packages say when read back."""
    rows = warc.roles(table(spark, sf_dir, "pages"))
    packages = warc.write_packages(rows, shared_folder(spark, "warc"))
    return warc.read_packages(packages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op3_token_shards")
def op3_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as ids in compressed shards, and what the shards hold when read back."""
    path = shared_folder(spark, "shards")
    repair.write_shards(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return repair.read_documents(spark, path)


@query("op4_embedding_dedup", r"""
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id IS NOT NULL),
n AS (SELECT vec_id, list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))) AS u FROM v),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.vec_id <> b.vec_id AND list_dot_product(a.u, b.u) >= 0.9),
r AS (SELECT vec_id, vec_id AS reached FROM v UNION SELECT r.vec_id, l.b FROM r JOIN l ON r.reached = l.a),
c AS (SELECT vec_id, min(reached) AS component_id FROM r GROUP BY 1),
k AS (SELECT a AS vec_id, count(*) AS n_links FROM l GROUP BY 1)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN k USING (vec_id)
""")
def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings at a cosine of 0.9 or more."""
    return pq.near_duplicates(table(spark, sf_dir, "embeddings"))


@query("op11_spelling")
def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near words, form and root of every frequent word; one in 199 runs of a document loses a letter."""
    words = spelling.word_counts(table(spark, sf_dir, "documents"), thinned=199)
    return spelling.variants(words).select("word", "form", "root", "n", "n_near", "form_n")


@query("op12_search", r"""
WITH e AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents WHERE doc_id IS NOT NULL),
l AS (SELECT doc_id, count(*) AS n FROM e GROUP BY 1),
c AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM l),
i AS (SELECT item_id, min(text) AS text FROM benchmark WHERE item_id IS NOT NULL GROUP BY 1),
q AS (SELECT item_id, term, count(*) AS q FROM (SELECT item_id,
      unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM i) GROUP BY ALL),
p AS (SELECT doc_id, term, count(*) AS tf FROM e SEMI JOIN q USING (term) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p, c GROUP BY 1),
s AS (SELECT item_id, doc_id, sum(q * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // terms))))::BIGINT AS score
      FROM q JOIN p USING (term) JOIN w USING (term) JOIN l USING (doc_id), c GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10
""")
def op12_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every benchmark item."""
    return search.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _scan_sql() -> str:
    """Every block and template by counting shared words, without any filter."""
    sets = [(number, licenses.size_class(licenses.words_of(text)), label, set(licenses.words_of(text))) for number, (label, text) in enumerate(licenses.TEMPLATES)]
    words = ", ".join(
        f"({number}, {size}, '{label}', '{word}', {len(own)}, {licenses.needed(list(own), licenses.THRESHOLD)})"
        for number, size, label, own in sets for word in sorted(own)
    )
    phrases = " UNION ALL ".join(
        f"SELECT r, i, '{label}' AS label FROM v WHERE " + " AND ".join(f"{c} = '{w}'" for c, w in zip(("w", "w1", "w2"), licenses.words_of(phrase)))
        for phrase, label in licenses.PHRASES
    )
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
u AS (SELECT r, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS i FROM d),
v AS (SELECT r, i, w, lead(w, 1) OVER o AS w1, lead(w, 2) OVER o AS w2 FROM u WINDOW o AS (PARTITION BY r ORDER BY i)),
b AS ({phrases}),
base AS (SELECT r, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list(DISTINCT label) AS base FROM b GROUP BY r),
t(template, c, label, w, size, need) AS (VALUES {words}),
h AS (SELECT r, i, template, c, label, w, size, need FROM u JOIN t USING (w)),
k AS (SELECT *, i // c AS block FROM h UNION ALL SELECT *, i // c - 1 FROM h WHERE i >= c),
m AS (SELECT r, label, count(DISTINCT w) / size::DOUBLE AS share FROM k GROUP BY r, template, block, label, size, need HAVING count(DISTINCT w) >= need),
a AS (SELECT r, list(DISTINCT label) AS added, max(share) AS share FROM m GROUP BY r)
SELECT doc_id, len(ws) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
       coalesce(array_to_string(list_sort(base), ','), '') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(coalesce(base, []), coalesce(added, [])))), ',') AS labels,
       CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(share, 0.0) END::DOUBLE AS score
FROM d LEFT JOIN base USING (r) LEFT JOIN a USING (r)"""


@query("op13_licenses", _scan_sql())
def op13_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and notices of every document."""
    return licenses.scan(table(spark, sf_dir, "documents"))
