"""The registered queries of this subpackage and, where SQL can state them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flagloom.llm import (chosenpath, collocations, crf, kmtree, mixing, ordermin, pieces, quality, simhash, substring, toolcalls, vptree, warc)
from flagloom.llm.common import read

Query = Callable[[SparkSession, str], DataFrame]


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and pass of the mixture at 90 % of the greatest entropy, four passes at most."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix_sources(docs).select("doc_id", "source", "mix_pass", "mix_order", "mix_weight")


#: Tools of the exchanges that are read off the conversations.
TOOL_SCHEMAS = """SELECT * FROM VALUES
  ('search', 'query', 'string', true), ('search', 'limit', 'integer', false),
  ('summarise', 'text', 'string', true), ('summarise', 'ratio', 'number', true),
  ('translate', 'text', 'string', true), ('translate', 'formal', 'boolean', false)
  AS t (tool, param, type, required)"""


def tool_traffic(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results read off a conversations table, which has none of its own.

    Every assistant turn calls a tool with its whole text as an argument; the
    user turn after it is the result. Arithmetic on the ids puts in each fault the operator
    must find: a parent that may not exist, a wrong type, a missing or an
    unknown parameter, broken JSON, an unknown tool, a result of another id.
    """
    c = conversations.select("conv_id", "turn", "role", "text")
    mark = (F.col("conv_id") * 7 + F.col("turn") * 3) % 20
    n = F.col("conv_id") % 4
    label = lambda turn: F.concat_ws("-", F.lit("call"), F.col("conv_id").cast("string"), turn.cast("string"))
    tool = (F.when(n == 0, "summarise").when(n == 1, "translate")
            .when((n == 2) | (F.col("conv_id") % 12 != 3), "search").otherwise("browse"))
    quoted = F.regexp_extract(F.to_json(F.struct(F.col("text").alias("t"))), r"(?s)^\{\"t\":(.*)\}$", 1)
    value = F.when(F.col("text").isNull(), F.lit("null")).otherwise(quoted)
    main = F.when(tool == "search", F.lit("query")).otherwise(F.lit("text"))
    side = (F.when(tool == "search", F.concat(F.lit('"limit":'), F.col("turn").cast("string")))
            .when(tool == "summarise", F.concat(F.lit('"ratio":0.'), (F.col("turn") + 1).cast("string")))
            .otherwise(F.lit('"formal":true')))
    side = F.when(mark == 1, F.lit('"limit":"ten"')).when(mark == 2, F.lit('"depth":2')).otherwise(side)
    body = F.when(mark == 3, side).otherwise(F.concat(side, F.lit(', "'), main, F.lit('" : '), value))
    arguments = F.when(mark == 4, F.concat(F.lit("{"), body)).otherwise(F.concat(F.lit("{"), body, F.lit("}")))
    calls = c.where(F.col("role") == "assistant").select(
        "conv_id", label(F.col("turn")).alias("call_id"), F.col("turn").alias("seq"), tool.alias("tool"),
        arguments.alias("arguments"),
        F.when((F.col("turn") > 2) & ((F.col("conv_id") + F.col("turn")) % 5 != 0), label(F.col("turn") - 2)).alias("parent_id"))
    results = c.where((F.col("role") == "user") & (F.col("turn") > 0)).select(
        "conv_id", F.when(mark == 5, F.concat(label(F.col("turn") - 1), F.lit("x")))
        .otherwise(label(F.col("turn") - 1)).alias("call_id"), F.col("turn").alias("seq"), F.col("text").alias("content"))
    return calls, results


def op2_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every exchange of the conversations, linked, ordered, checked and as canonical JSON."""
    calls, results = tool_traffic(read(spark, sf_dir, "conversations"))
    return toolcalls.link_tool_calls(calls, results, spark.sql(TOOL_SCHEMAS))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; a fifth of the ids is held out of the fit."""
    docs = read(spark, sf_dir, "documents").withColumn(
        "held_out", F.crc32(F.col("doc_id").cast("string")) % 5 == 0)
    # a null id has no checksum: such rows are not learned from and count as held out
    docs = docs.withColumn("held_out", F.coalesce("held_out", F.lit(True)))
    model = crf.fit(docs.where("NOT held_out"))
    return crf.identify(docs, model, keep=("doc_id", "held_out"))


def op4_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document (3-word shingles, 3 bits)."""
    return simhash.near_duplicates(read(spark, sf_dir, "documents"), shingle=3, max_bits=3)


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected grade and tail probability of every document."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, quality.grades_of_labels(read(spark, sf_dir, "labels")))
    return quality.grade(docs, model).select("doc_id", "expected_grade", "tail_prob", "accepted")


#: The public tokenizer where the caller names no other.
PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def op6_sentencepiece(spark: SparkSession, sf_dir: str, model: str = PIECE_MODEL) -> DataFrame:
    """Piece ids of every document, and whether decoding gives the text back."""
    return pieces.encode(read(spark, sf_dir, "documents"), pieces.load_model(model))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words left in every document after repeated 50-word windows are cut."""
    return (substring.drop_repeats(read(spark, sf_dir, "documents"), window=50)
            .select(F.col("_id").alias("doc_id"), "n_words", "n_removed", "kept_sha256"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page through WARC archives and the splittable reader."""
    return warc.round_trip(read(spark, sf_dir, "pages"), least_bytes=1000)


def op9_kmeans_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten nearest vectors found for every hundredth vector id."""
    return kmtree.search(read(spark, sf_dir, "embeddings"), every=100, k=10)


def op10_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order MinHash of every document and of its edited text."""
    return ordermin.order_minhash(read(spark, sf_dir, "documents"))


def op11_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size and component of every document (5-word shingles, Jaccard similarity 0.85)."""
    return chosenpath.near_duplicates(read(spark, sf_dir, "documents"), shingle=5, percent=85)


def op12_vptree_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forty clusters of every embedding of 64 components after five rounds, in exact integers."""
    return vptree.cluster(read(spark, sf_dir, "embeddings"), size=64, k=40, rounds=5, scale=256, salt="2")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2,000 best surviving phrases of two or three words of every language."""
    return collocations.mine(read(spark, sf_dir, "documents"), top=2000, least=10, absorb=50)


QUERIES: dict[str, Query] = {
    "op1_source_mixing": op1_source_mixing,
    "op2_tool_calls": op2_tool_calls,
    "op3_language_id": op3_language_id,
    "op4_simhash_dedup": op4_simhash_dedup,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_sentencepiece": op6_sentencepiece,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_warc": op8_warc,
    "op9_kmeans_tree": op9_kmeans_tree,
    "op10_order_minhash": op10_order_minhash,
    "op11_chosen_path": op11_chosen_path,
    "op12_vptree_kmeans": op12_vptree_kmeans,
    "op13_collocations": op13_collocations,
}

#: The same traffic and its exchanges; in canonical JSON the side parameter's name comes before the main one's.
_OP2 = r"""
WITH RECURSIVE c AS (SELECT conv_id, turn, role, text, (conv_id * 7 + turn * 3) % 20 AS mark, conv_id % 4 AS n FROM conversations),
a AS (SELECT conv_id, 'call-' || conv_id || '-' || turn AS call_id, turn AS seq, text, mark,
        CASE WHEN n = 0 THEN 'summarise' WHEN n = 1 THEN 'translate' WHEN n = 2 OR conv_id % 12 <> 3 THEN 'search' ELSE 'browse' END AS tool,
        CASE WHEN turn > 2 AND (conv_id + turn) % 5 <> 0 THEN 'call-' || conv_id || '-' || (turn - 2) END AS parent_id
      FROM c WHERE role = 'assistant'),
b AS (SELECT *, CASE WHEN tool = 'search' THEN 'query' ELSE 'text' END AS main,
        CASE WHEN mark = 1 THEN '"limit":"ten"' WHEN mark = 2 THEN '"depth":2' WHEN tool = 'search' THEN '"limit":' || seq
             WHEN tool = 'summarise' THEN '"ratio":0.' || regexp_replace(CAST(seq + 1 AS VARCHAR), '0+$', '')
             ELSE '"formal":true' END AS side FROM a),
j AS (SELECT *, CASE WHEN mark <> 4 THEN '{' || side || CASE WHEN mark = 3 THEN ''
        ELSE ',"' || main || '":' || coalesce(CAST(to_json(text) AS VARCHAR), 'null') END || '}' END AS args,
      CASE WHEN mark = 4 OR tool = 'browse' THEN [] ELSE list_sort(list_filter([
        CASE WHEN mark = 3 THEN 'missing:' || main END,
        CASE WHEN mark IN (1, 2) AND tool = 'summarise' THEN 'missing:ratio' END,
        CASE WHEN mark = 1 AND tool = 'search' THEN 'type:limit' END,
        CASE WHEN mark <> 3 AND text IS NULL THEN 'type:' || main END,
        CASE WHEN mark = 1 AND tool <> 'search' THEN 'unknown:limit' END,
        CASE WHEN mark = 2 THEN 'unknown:depth' END], lambda x: x IS NOT NULL)) END AS errors FROM b),
up AS (SELECT j.conv_id, j.call_id, p.call_id AS up FROM j LEFT JOIN j p ON p.conv_id = j.conv_id AND p.call_id = j.parent_id),
lv AS (SELECT conv_id, call_id, 0 AS level FROM up WHERE up IS NULL
       UNION ALL SELECT up.conv_id, up.call_id, lv.level + 1 FROM up JOIN lv ON lv.conv_id = up.conv_id AND lv.call_id = up.up),
r AS (SELECT conv_id, 'call-' || conv_id || '-' || (turn - 1) || CASE WHEN mark = 5 THEN 'x' ELSE '' END AS call_id, turn, text
      FROM c WHERE role = 'user' AND turn > 0),
g AS (SELECT conv_id, call_id, count(*) AS n_results, min(turn) AS seq, arg_min(text, turn) AS content FROM r GROUP BY 1, 2),
x AS (SELECT j.conv_id, j.call_id, j.seq, j.tool, CAST(lv.level AS BIGINT) AS level, coalesce(g.n_results, 0) AS n_results,
        CASE WHEN parent_id IS NOT NULL AND lv.level = 0 THEN 'unknown_parent' WHEN args IS NULL THEN 'bad_json'
             WHEN tool = 'browse' THEN 'unknown_tool' WHEN len(errors) > 0 THEN 'invalid' WHEN g.conv_id IS NULL THEN 'no_result'
             ELSE 'ok' END AS status, errors, args, parent_id, content
      FROM j JOIN lv ON lv.conv_id = j.conv_id AND lv.call_id = j.call_id
      LEFT JOIN g ON g.conv_id = j.conv_id AND g.call_id = j.call_id
      UNION ALL
      SELECT g.conv_id, g.call_id, g.seq, NULL, NULL, g.n_results, 'orphan_result', [], NULL, NULL, content
      FROM g ANTI JOIN j ON j.conv_id = g.conv_id AND j.call_id = g.call_id)
SELECT conv_id, call_id, seq, tool, level, n_results, status, errors,
  '{"arguments":' || coalesce(args, 'null') || ',"call_id":' || to_json(call_id) || ',"conv_id":' || conv_id || ',"parent_id":'
  || coalesce(CAST(to_json(parent_id) AS VARCHAR), 'null') || ',"result":' || coalesce(CAST(to_json(content) AS VARCHAR), 'null')
  || ',"tool":' || coalesce(CAST(to_json(tool) AS VARCHAR), 'null') || '}' AS record
FROM x
"""

#: Windows as joined texts; chr(31) is no separator, so words are cut by the contract's pattern.
_OP7 = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT doc_id, words, unnest(generate_series(1, len(words) - 49)) AS i FROM w WHERE len(words) >= 50),
h AS (SELECT doc_id, i, md5(array_to_string(words[i:i + 49], ' ')) AS h FROM s),
m AS (SELECT h, min(doc_id) AS least FROM h GROUP BY h),
bad AS (SELECT doc_id, i FROM h JOIN m USING (h) WHERE doc_id > least),
gone AS (SELECT DISTINCT doc_id, i + k AS p FROM bad, (SELECT unnest(generate_series(0, 49)) AS k)),
g AS (SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id),
e AS (SELECT w.doc_id, words, coalesce(ps, []) AS ps FROM w LEFT JOIN g USING (doc_id)),
p AS (SELECT doc_id, words, unnest(generate_series(1, len(words))) AS p FROM w),
k AS (SELECT p.doc_id, string_agg(words[p.p], ' ' ORDER BY p.p) AS kept
      FROM p ANTI JOIN gone ON gone.doc_id = p.doc_id AND gone.p = p.p GROUP BY p.doc_id)
SELECT e.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(ps) AS BIGINT) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM e LEFT JOIN k ON k.doc_id = e.doc_id
"""

_OP8 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS n, sha1(html) AS sha FROM p),
m AS (SELECT sha, n, max(page_id) AS holder FROM d WHERE n >= 1000 GROUP BY sha, n)
SELECT d.page_id, d.n AS payload_bytes, d.sha AS payload_digest,
       CASE WHEN m.holder IS NOT NULL AND m.holder IS DISTINCT FROM d.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN m.holder IS DISTINCT FROM d.page_id THEN m.holder END AS refers_to
FROM d LEFT JOIN m ON m.sha = d.sha AND m.n = d.n
"""

#: Pairs by a shared shingle (every linked pair has one), components by walking the links from every document.
_OP11 = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(words[i:i + 4], ' ') AS s
      FROM (SELECT doc_id, words, unnest(generate_series(1, greatest(len(words) - 4, 1))) AS i FROM w WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
r AS (SELECT doc_id AS d, doc_id AS reached FROM documents UNION SELECT r.d, l.b FROM r JOIN l ON l.a = r.reached),
c AS (SELECT d, min(reached) AS component_id FROM r GROUP BY d)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, w.doc_id = component_id AS kept
FROM w LEFT JOIN n USING (doc_id) JOIN c ON c.d = w.doc_id
"""


def _op12(size: int = 64, k: int = 40, rounds: int = 5, scale: int = 256, salt: str = "2") -> str:
    """Rounds of assignment to the nearest centroid and exact floored means, one after the other."""
    parts = [f"""kept AS (SELECT row_number() OVER () AS r, vec_id, embedding AS e FROM embeddings
      WHERE len(embedding) = {size} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {size}),
v AS (SELECT r, d, CAST(floor({scale} * CAST(e[d] AS DOUBLE)) AS HUGEINT) AS x
      FROM (SELECT r, e, unnest(generate_series(1, {size})) AS d FROM kept)),
c0 AS (SELECT rank AS c, d, x FROM v JOIN (SELECT r, row_number() OVER (ORDER BY sha256('{salt}:' || vec_id)) - 1 AS rank
      FROM kept) USING (r) WHERE rank < {k})"""]
    for i in range(rounds + 1):
        parts.append(f"""a{i} AS (SELECT r, min(dist * {k} + c) AS best FROM (SELECT r, c, sum((v.x - m.x) * (v.x - m.x)) AS dist
      FROM v JOIN c{i} m ON m.d = v.d GROUP BY r, c) GROUP BY r),
b{i} AS (SELECT r, best % {k} AS c, (best - best % {k}) // {k} AS dist FROM a{i})""")
        if i < rounds:
            parts.append(f"""m{i} AS (SELECT c, d, sum(x)::HUGEINT AS s, count(*)::HUGEINT AS n FROM v JOIN b{i} USING (r) GROUP BY c, d),
c{i + 1} AS (SELECT c{i}.c, c{i}.d, coalesce((s - ((s % n) + n) % n) // n, c{i}.x) AS x
      FROM c{i} LEFT JOIN m{i} m ON m.c = c{i}.c AND m.d = c{i}.d)""")
    return f"""WITH {", ".join(p + "" for p in parts)},
h AS (SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY d)) AS sha FROM c{rounds} GROUP BY c),
t AS (SELECT c, sum(dist) AS inertia FROM b{rounds} GROUP BY c)
SELECT vec_id, CAST(b.c AS INTEGER) AS cluster, CAST(dist AS BIGINT) AS distance, CAST(t.inertia AS BIGINT) AS cluster_inertia,
  CAST((SELECT sum(inertia) FROM t) AS BIGINT) AS inertia, sha AS centroid_sha256
FROM b{rounds} b JOIN kept USING (r) JOIN h ON h.c = b.c JOIN t ON t.c = b.c"""


#: Every phrase of two and three words counted, then scored, dropped and ranked.
_OP13 = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
q AS (SELECT lang, row_number() OVER () AS id, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
e AS (SELECT lang, id, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM q),
o AS (SELECT lang, w, lead(w, 1) OVER x AS w2, lead(w, 2) OVER x AS w3 FROM e WINDOW x AS (PARTITION BY id ORDER BY i)),
f AS (SELECT lang, phrase, CAST(count(*) AS HUGEINT) AS f FROM (
      SELECT lang, w AS phrase FROM o UNION ALL SELECT lang, w || ' ' || w2 FROM o WHERE w2 IS NOT NULL
      UNION ALL SELECT lang, w || ' ' || w2 || ' ' || w3 FROM o WHERE w3 IS NOT NULL) GROUP BY lang, phrase),
t AS (SELECT lang, CAST(count(*) AS BIGINT) AS n FROM o GROUP BY lang),
c AS (SELECT lang, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE f >= 10 AND phrase LIKE '% %'),
x AS (SELECT lang, phrase, a, w, 1 AS k, w[1] AS first, array_to_string(w[2:], ' ') AS rest FROM c
      UNION ALL SELECT lang, phrase, a, w, 2, array_to_string(w[1:2], ' '), w[3] FROM c WHERE len(w) = 3),
k AS (SELECT x.*, l.f AS l, r.f AS r, (1000000 * a * a) // (l.f * r.f) AS score FROM x
      JOIN f l ON l.lang = x.lang AND l.phrase = x.first JOIN f r ON r.lang = x.lang AND r.phrase = x.rest),
b AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
i AS (SELECT DISTINCT s.lang, s.phrase FROM b s JOIN (
      SELECT lang, a, array_to_string(w[1:2], ' ') AS part FROM b WHERE len(w) = 3
      UNION ALL SELECT lang, a, array_to_string(w[2:3], ' ') FROM b WHERE len(w) = 3) g
      ON g.lang = s.lang AND g.part = s.phrase WHERE len(s.w) = 2 AND 100 * g.a >= 50 * s.a),
d AS (SELECT b.* FROM b ANTI JOIN i ON i.lang = b.lang AND i.phrase = b.phrase)
SELECT d.lang, CAST(row_number() OVER (PARTITION BY d.lang ORDER BY score DESC, a DESC, encode(phrase)) AS BIGINT) AS rank, phrase,
  CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, n, CAST(score AS BIGINT) AS score
FROM d JOIN t ON t.lang = d.lang QUALIFY rank <= 2000
"""

ORACLE: dict[str, str] = {
    "op2_tool_calls": _OP2,
    "op7_substring_dedup": _OP7,
    "op8_warc": _OP8,
    "op11_chosen_path": _OP11,
    "op12_vptree_kmeans": _op12(),
    "op13_collocations": _OP13,
}
