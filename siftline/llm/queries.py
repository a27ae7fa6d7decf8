"""The operators' registered queries, over whole tables with production settings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.llm import decontamination, grid_join, lattice, license_scan, packing, prefix_trie, quality, simhash, spelling, token_counts, token_files, toxicity, warc
from siftline.llm.storage import importable, shared_root

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(function):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            importable(spark)
            return function(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return function

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    """A public vocabulary file; the operators take any path."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op7_token_files")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_root(spark)
    token_files.write_token_files(table(spark, sf_dir, "documents"), path, vocabulary("word_bpe_49k.json"), end_id=1)
    # Digests first: the ids stay where they are read.
    return token_files.with_starts(token_files.id_digests(token_files.read_token_files(spark, path)), path)


@query("op10_packing")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_digests(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), capacity=2048, end_id=0)


@query("op8_simhash")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, distance=2)
    digits = F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint")
    return found.select("doc_id", digits, "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


OP1_SQL = r"""
WITH l AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id),
d AS (
  SELECT source, lang, CASE WHEN l.quality = 0 THEN replace(coalesce(text, ''), '|', ' ') ELSE coalesce(text, '') END AS text
  FROM documents LEFT JOIN l USING (doc_id) WHERE coalesce(l.toxic, 0) <> 1
),
c AS (
  SELECT source, lang, 'words-1' AS tokenizer, length(text) AS chars,
    len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS n FROM d
  UNION ALL
  SELECT source, lang, 'word-parts-1', length(text),
    len(regexp_extract_all(text, '[A-Za-z\x{80}-\x{10FFFF}]+|[0-9]|[^A-Za-z0-9\x{80}-\x{10FFFF}\x20\x09-\x0D]+')) FROM d
)
SELECT source, lang, tokenizer, count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_tokens, sum(chars)::BIGINT AS n_chars
FROM c GROUP BY ALL
"""


@query("op1_token_rollup", OP1_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents arrive; those labelled poor are revised (table bars out), the
    toxic ones deleted; the last batch is delivered twice."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    marks = labels.groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    feed = docs.select("doc_id", "source", "lang", "text", F.lit(0).alias("seq"), F.lit("upsert").alias("op"))
    rollup = token_counts.Rollup(spark, shared_root(spark))
    rollup.commit(0, feed)
    poor = feed.join(marks.filter("quality = 0").select("doc_id"), "doc_id").withColumn("text", F.replace("text", F.lit("|"), F.lit(" ")))
    rollup.commit(1, poor)
    toxic = marks.filter("toxic = 1").select("doc_id", F.lit(None).cast("string").alias("source"), F.lit(None).cast("string").alias("lang"), F.lit(None).cast("string").alias("text"), F.lit(0).alias("seq"), F.lit("delete").alias("op"))
    for _ in range(2):
        rollup.commit(2, toxic)
    return rollup.totals()


OP9_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS raw FROM pages),
d AS (SELECT page_id, octet_length(raw)::BIGINT AS payload_bytes, sha1(raw) AS payload_digest FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS kept FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id <> kept THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id <> kept THEN kept END AS refers_to
FROM m
"""


@query("op9_warc", OP9_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


OP2_SQL = """
WITH RECURSIVE e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.v, b.v) >= 0.93
),
r AS (SELECT vec_id, vec_id AS reached FROM e UNION SELECT r.vec_id, l.b FROM r JOIN l ON r.reached = l.a),
c AS (SELECT vec_id, min(reached) AS component_id FROM r GROUP BY vec_id),
n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM c LEFT JOIN n USING (vec_id)
"""


@query("op2_grid_join", OP2_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid_join.similar_vectors(table(spark, sf_dir, "embeddings"), threshold=0.93)


@query("op3_lattice_scores")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.score_texts(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"), lattice.seventh())


@query("op6_quality")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = quality.statistics_table(table(spark, sf_dir, "documents"))
    return quality.scores(stats, quality.fit(stats, table(spark, sf_dir, "labels")))


@query("op4_toxicity")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.scores(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


@query("op5_decontamination")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_hash")


def _crc32(bytes_sql: str) -> str:
    """CRC-32 of a list of byte values, in SQL."""
    bit = "list_reduce(list_prepend(xor(a, b), range(8)), lambda r, i: xor(r >> 1, (r & 1) * 3988292384))"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {bytes_sql}), lambda a, b: {bit}), 4294967295)"


OP11_SQL = f"""
WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos,
    coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
),
c AS (SELECT conv_id, {_crc32("list_transform(string_split(conv_id::VARCHAR, ''), lambda x: unicode(x)::BIGINT)")} % 9 AS h FROM (SELECT DISTINCT conv_id FROM t)),
r AS (
  SELECT c.conv_id, 0 AS part, pos, role, text FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 5 WHERE pos < h
  UNION ALL SELECT c.conv_id, 1, pos, role, text FROM c JOIN t USING (conv_id) WHERE pos >= h
),
s AS (
  SELECT c.conv_id, coalesce(list({{'r': role, 't': text}} ORDER BY part, pos) FILTER (role IS NOT NULL), []) AS seq
  FROM c LEFT JOIN r USING (conv_id) GROUP BY c.conv_id
),
p AS (SELECT conv_id, seq, unnest(range(0, len(seq) + 1)) AS depth FROM s),
n AS (
  SELECT seq[1:depth] AS path, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
    coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (depth = len(seq)), '') AS ends,
    CASE WHEN depth = 0 THEN 0 ELSE octet_length(encode(any_value(seq[depth].t))) END AS bytes
  FROM p GROUP BY 1, 2
),
k AS (SELECT path[1:depth - 1] AS path, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
m AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k USING (path)),
u AS (SELECT path, unnest(range(0, depth + 1)) AS j, n_children, (n_convs - 1) * bytes AS saved FROM m),
b AS (SELECT path[1:j] AS path, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved) AS saved_tokens FROM u GROUP BY 1)
SELECT m.conv_id, m.depth, up.conv_id AS parent_conv_id, m.n_convs, m.n_children::BIGINT AS n_children, b.n_leaves,
  b.saved_tokens::BIGINT AS saved_tokens, sha256(m.ends) AS ends_sha256
FROM m JOIN b USING (path) LEFT JOIN m up ON m.depth > 0 AND up.path = m.path[1:m.depth - 1]
"""


@query("op11_prefix_trie", OP11_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = prefix_trie.with_shared_openings(table(spark, sf_dir, "conversations"), group=5, most=9)
    return prefix_trie.digests(prefix_trie.prefix_trie(turns))


@query("op12_license_scan")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


_UTF8 = "flatten(list_transform(string_split(d || ':' || run, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [195, unicode(x)::BIGINT - 64] END))"
OP13_SQL = rf"""
WITH RECURSIVE l AS (
  SELECT d, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
  FROM (SELECT coalesce(doc_id::VARCHAR, '') AS d, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{{C0}}-\x{{FF}}]{{7,}}')) AS run FROM documents)
),
h AS (SELECT run, {_crc32(_UTF8)} AS h FROM l),
o AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word FROM h),
w AS (SELECT word, count(*) AS n FROM o WHERE length(word) >= 7 GROUP BY word HAVING count(*) >= 2),
x AS (SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS cut FROM (SELECT word, unnest(range(1, length(word) + 1))::INT AS i FROM w)),
e AS (SELECT DISTINCT x.word AS a, w.word AS b FROM x JOIN w ON x.cut = w.word),
near AS (
  SELECT a.word AS a, b.word AS b FROM x a JOIN x b ON a.i = b.i AND a.cut = b.cut AND a.word <> b.word
  UNION ALL SELECT a, b FROM e UNION ALL SELECT b, a FROM e
),
best AS (
  SELECT a AS word, w.word AS form, w.n AS form_n, count(*) OVER (PARTITION BY a) AS n_near, row_number() OVER (PARTITION BY a ORDER BY w.n DESC, w.word) AS nth
  FROM near JOIN w ON near.b = w.word
),
f AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 10 * w.n THEN form END AS form, CASE WHEN form_n >= 10 * w.n THEN form_n END AS form_n
  FROM w LEFT JOIN best ON w.word = best.word AND nth = 1
),
r AS (SELECT word, word AS root FROM f UNION ALL SELECT r.word, f.form FROM r JOIN f ON r.root = f.word WHERE f.form IS NOT NULL),
z AS (SELECT r.word, r.root FROM r JOIN f ON r.root = f.word WHERE f.form IS NULL)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN z USING (word)
"""


@query("op13_spelling", OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))
