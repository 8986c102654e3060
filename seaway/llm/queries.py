"""The numbered operators as queries over the given tables: each maps columns to its operator and the results back."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seaway.llm import fingerprints, language, mixing, near_copies, neighbours, pieces, plan_repair, plan_trie, private, quality, repetition, token_files, toxicity
from seaway.llm.digests import digest_ordered, digest_runs
from seaway.llm.texts import remainder
from seaway.session import cut, ensure_checkpoint_dir

RELAX = 1.4  # of the searches: see the README for recall
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def oracle(name: str, sql: str) -> None:
    ORACLES[name] = sql


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def plans_of(docs: DataFrame) -> DataFrame:
    """Documents as passage plans, with ``held_out`` left to the caller."""
    return docs.select(F.col("doc_id").alias("route_id"), F.col("text").alias("plan_text"))


def learnable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of the rows that may be learned from."""
    labels = table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "route_id")
    return labels.filter(remainder("route_id", 3) != 1)


@query
def op1_quality_nbsvm(spark: SparkSession, sf_dir: str) -> DataFrame:
    plans = plans_of(table(spark, sf_dir, "documents"))
    model = quality.fit_quality(plans, learnable(spark, sf_dir))
    x = quality.score_quality(plans, model)
    return x.select(F.col("route_id").alias("doc_id"), (remainder("route_id", 3) == 1).alias("held_out"), F.col("quality_score").alias("score"), F.col("is_good").cast("int").alias("predicted"))


@query
def op2_wavelet_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/token-files-{uuid.uuid4().hex}"
    token_files.write_token_files(plans_of(table(spark, sf_dir, "documents")), path, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return token_files.read_token_files(spark, path).withColumnRenamed("route_id", "doc_id")


@query
def op3_language_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    plans = plans_of(docs)
    model = language.fit_language(docs.filter(remainder("doc_id", 4) != 2).select(F.col("doc_id").alias("route_id"), F.col("text").alias("plan_text"), "lang"))
    x = language.predict_language(plans, model)
    return x.select(F.col("route_id").alias("doc_id"), (remainder("route_id", 4) == 2).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_rejected").alias("rejected"))


@query
def op4_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = fingerprints.edited_fingerprints(plans_of(table(spark, sf_dir, "documents")))
    return x.withColumnRenamed("route_id", "doc_id")


@query
def op5_sentencepiece_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    model = pieces.load_pieces(public_tokenizers.path("piece_bpe_32k.model"))
    x = pieces.decode_pieces(pieces.encode_pieces(plans_of(table(spark, sf_dir, "documents")), model), model)
    exact = F.col("decoded_text") == F.coalesce("plan_text", F.lit(""))
    return x.select(F.col("route_id").alias("doc_id"), F.size("piece_ids").cast("long").alias("n_pieces"), exact.alias("exact"), "piece_ids")


@query
def op6_toxicity_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    plans = plans_of(table(spark, sf_dir, "documents"))
    model = toxicity.fit_toxicity(plans, learnable(spark, sf_dir))
    x = toxicity.score_toxicity(plans, model)
    return x.select(F.col("route_id").alias("doc_id"), (remainder("route_id", 3) == 1).alias("held_out"), F.col("toxicity").alias("score"), F.col("is_toxic").cast("int").alias("predicted"))


@query
def op7_vantage_point_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("node_id"), F.col("embedding").alias("position"))
    x = neighbours.nearest(nodes, nodes.filter(F.pmod("node_id", F.lit(20)) == 0), k=20, relax=RELAX)
    return x.select("query_id", "rank", F.col("node_id").alias("vec_id"), "score")


@query
def op8_private_feistel(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = private.pseudonymise(plans_of(table(spark, sf_dir, "documents")))
    return x.select(F.col("route_id").alias("doc_id"), F.col("plan_text").alias("text"), F.array_join("private_kinds", ",").alias("kinds"))


@query
def op9_near_copies_hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = near_copies.near_copies(plans_of(table(spark, sf_dir, "documents")), words=2, percent=80)
    return x.withColumnRenamed("route_id", "doc_id")


oracle("op9_near_copies_hamming", """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN w
             ELSE list_sort(list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) END AS s FROM w),
c AS (SELECT s, min(doc_id) AS id, len(s) AS n FROM s WHERE len(s) > 0 GROUP BY s),
e AS (SELECT id, n, unnest(s) AS g FROM c),
p AS (SELECT a.id AS a, b.id AS b FROM e a JOIN e b ON a.g = b.g AND a.id < b.id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
      GROUP BY a.id, b.id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
l AS (SELECT a, b FROM p UNION SELECT b, a FROM p),
r AS (SELECT id AS a, id AS b FROM c UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
m AS (SELECT a AS id, min(b) AS m FROM r GROUP BY a)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, coalesce(m.m, s.doc_id) AS component_id, s.doc_id = coalesce(m.m, s.doc_id) AS kept
FROM s LEFT JOIN c ON s.s = c.s LEFT JOIN m ON m.id = c.id
""")


@query
def op10_mixing_exponential(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    plans = docs.select(F.col("doc_id").alias("route_id"), F.col("text").alias("plan_text"), "source")
    narrow = cut(mixing.measure(plans).drop("plan_text"))
    x = mixing.take(narrow, mixing.quotas(narrow))
    return x.select(F.col("route_id").alias("doc_id"), "size", "source_size", "target", "taken")


oracle("op10_mixing_exponential", """
WITH m AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
         CASE WHEN length(coalesce(text, '')) > 0
              THEN 0.05e0 + 0.95e0 * (CAST(length(translate(text, '0123456789#$%&*!|=<>@^~_{}[]\\', '')) AS DOUBLE) / CAST(length(text) AS DOUBLE)) ELSE 0.05e0 END AS w,
         (CAST(CAST('0x' || substr(md5('mix|' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) AS DOUBLE) + 0.5e0) / 4503599627370496e0 AS u
  FROM documents),
k AS (SELECT doc_id, source, size, -ln(u) / w AS k FROM m),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS s, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS r FROM k GROUP BY source),
l AS (SELECT *, CASE r % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w, 2e0 * s AS f, 2e0 * s / (CASE r % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END) AS lev FROM s),
c AS (SELECT *, (1.5e0 * CAST(sum(s) OVER () AS DOUBLE) - coalesce(sum(f) OVER b, 0e0)) / CAST(sum(w) OVER () - coalesce(sum(w) OVER b, 0) AS DOUBLE) AS tr
      FROM l WINDOW b AS (ORDER BY lev, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
a AS (SELECT arg_min(tr, lev) AS tr FROM c WHERE tr < lev),
t AS (SELECT source, s, CASE WHEN a.tr IS NULL THEN f ELSE least(f, a.tr * w) END AS target FROM c LEFT JOIN a ON TRUE),
q AS (SELECT *, CASE WHEN s > 0 THEN CAST(floor(target / s) AS BIGINT) ELSE 0 END AS e FROM t),
p AS (SELECT k.doc_id, k.size, q.s AS source_size, q.target, q.e, CAST(round(q.target) AS BIGINT) - q.e * q.s AS budget,
             coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.k, k.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM k JOIN q ON k.source IS NOT DISTINCT FROM q.source)
SELECT doc_id, size, source_size, target, CAST(e * size + greatest(0, least(size, budget - before)) AS BIGINT) AS taken FROM p
""")


TURNS = plan_repair.Grammar(
    steps={(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}, accept=frozenset({0, 3}),
    names={"u": "user", "a": "assistant"}, adjacent=frozenset({"su", "ua", "au"}), closing=".!?")
NOTHING = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"  # SHA-256 of no bytes


def turns_of(conversations: DataFrame) -> DataFrame:
    """Conversations as plan lines."""
    return conversations.select(F.col("conv_id").alias("route_id"), F.col("turn").alias("wp_index"), F.col("role").alias("name"), F.col("text").alias("line"))


@query
def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = turns_of(table(spark, sf_dir, "conversations"))
    routes = turns.filter("route_id is not null").select("route_id").distinct()
    own_turns = F.crc32(F.col("route_id").cast("string").cast("binary")) % 9
    grafts = routes.select("route_id", (F.col("route_id") - F.col("route_id") % 5).alias("donor_id"), own_turns.alias("n_steps"))
    steps = plan_trie.graft_steps(cut(plan_trie.plan_steps(turns)), grafts)
    trie = plan_trie.plan_trie(steps, routes)
    ends = digest_ordered(trie.ends.select("node", "bucket", F.array_join(F.col("route_ids").cast("array<string>"), ",").alias("ids")), "node", ["bucket"], "ids", ",")
    x = trie.nodes.join(ends, "node", "left")
    return x.select(
        F.col("route_id").alias("conv_id"), "depth", F.col("parent_route_id").alias("parent_conv_id"), F.col("n_routes").alias("n_convs"), "n_children", "n_leaves",
        F.col("saved_bytes").alias("saved_tokens"), F.coalesce("sha256", F.lit(NOTHING)).alias("ends_sha256"))


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows of conversations after the faults that the contract of op12 prescribes."""
    blank = F.lit(" ")
    x = conversations.select("conv_id", "turn", F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"))
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    x = x.withColumn("_c", F.crc32(key.cast("binary")) % 20).filter("_c <> 0")
    x = x.withColumns({
        "text": F.when(F.col("_c") == 1, F.lit("")).when(F.col("_c") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")),
        "role": F.when(F.col("_c") == 4, F.lit("user")).otherwise(F.col("role"))})
    return x.withColumn("_copy", F.explode(F.when(F.col("_c") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))).drop("_c", "_copy")


@query
def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    found = plan_repair.repair_plans(turns_of(damaged(conversations)), TURNS, routes=conversations.select(F.col("conv_id").alias("route_id")))
    texts = digest_runs(found.lines.select("route_id", F.concat("name", F.lit(":"), "line").alias("_t")), "route_id", "_t", "\n").withColumnRenamed("route_id", "_id")
    x = found.reports.join(texts, F.col("route_id").eqNullSafe(F.col("_id")), "left")
    return x.select(
        F.col("route_id").alias("conv_id"), "gaps", "blank", F.col("repeated").alias("duplicate"), F.col("cut_short").alias("truncated"), "illegal", "cost", "audit",
        F.coalesce("sha256", F.lit(NOTHING)).alias("repaired_sha256"))


@query
def op13_repetition_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = repetition.repetition(plans_of(table(spark, sf_dir, "documents")))
    return x.select(
        F.col("route_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "covered_chars", "longest_repeat", "n_repeats")


CRC = """
WITH RECURSIVE ct(i, k, c) AS (
  SELECT i, 0, i FROM (SELECT unnest(range(256)) AS i) r
  UNION ALL SELECT i, k + 1, CASE WHEN (c & 1) = 1 THEN xor(c >> 1, CAST(3988292384 AS BIGINT)) ELSE c >> 1 END FROM ct WHERE k < 8),
cb AS (SELECT i, c FROM ct WHERE k = 8),
ck AS ({keys}),
cr(s, k, c) AS (
  SELECT s, 0, CAST(4294967295 AS BIGINT) FROM ck
  UNION ALL SELECT s, k + 1, xor(cr.c >> 8, cb.c) FROM cr JOIN cb ON cb.i = (xor(cr.c, CAST(ascii(substr(s, k + 1, 1)) AS BIGINT)) & 255) WHERE k < length(s)),
crc AS (SELECT s, xor(c, CAST(4294967295 AS BIGINT)) AS crc FROM cr WHERE k = length(s)),
"""

oracle("op11_conversation_trie", CRC.format(keys="SELECT DISTINCT CAST(conv_id AS VARCHAR) AS s FROM conversations WHERE conv_id IS NOT NULL") + """
own AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(text, ''))) AS n,
               md5(coalesce(role, '')) || md5(coalesce(text, '')) AS m, strlen(coalesce(text, '')) AS b FROM conversations WHERE conv_id IS NOT NULL),
len AS (SELECT conv_id, max(n) AS c FROM own GROUP BY conv_id),
h AS (SELECT len.conv_id, crc % 9 AS h, len.conv_id - len.conv_id % 5 AS base FROM len JOIN crc ON crc.s = CAST(len.conv_id AS VARCHAR)),
reb AS (SELECT h.conv_id, o.n AS d, o.m, o.b FROM h JOIN own o ON o.conv_id = h.base AND o.n <= h.h
        UNION ALL SELECT o.conv_id, o.n - h.h + least(h.h, coalesce(l.c, 0)), o.m, o.b FROM own o JOIN h ON o.conv_id = h.conv_id AND o.n > h.h LEFT JOIN len l ON l.conv_id = h.base),
path AS (SELECT conv_id, d, b, md5(string_agg(m, '') OVER (PARTITION BY conv_id ORDER BY d)) AS p FROM reb UNION ALL SELECT conv_id, 0, 0, '' FROM len),
last AS (SELECT conv_id, max(d) AS d FROM path GROUP BY conv_id),
node AS (SELECT p, min(conv_id) AS conv_id, min(d) AS d, count(*) AS n, min(b) AS b FROM path GROUP BY p),
up AS (SELECT n.p, q.p AS pp FROM node n JOIN path q ON q.conv_id = n.conv_id AND q.d = n.d - 1),
kids AS (SELECT pp AS p, count(*) AS k FROM up GROUP BY pp),
below AS (SELECT a.p, sum((x.n - 1) * x.b) AS saved, sum(CASE WHEN k.k IS NULL THEN 1 ELSE 0 END) AS leaves
          FROM node x JOIN path a ON a.conv_id = x.conv_id AND a.d <= x.d LEFT JOIN kids k ON k.p = x.p GROUP BY a.p),
ends AS (SELECT p.p, sha256(string_agg(CAST(p.conv_id AS VARCHAR), ',' ORDER BY p.conv_id)) AS e FROM path p JOIN last l ON l.conv_id = p.conv_id AND l.d = p.d GROUP BY p.p)
SELECT n.conv_id, CAST(n.d AS BIGINT) AS depth, u.conv_id AS parent_conv_id, CAST(n.n AS BIGINT) AS n_convs, CAST(coalesce(k.k, 0) AS BIGINT) AS n_children,
       CAST(b.leaves AS BIGINT) AS n_leaves, CAST(b.saved AS BIGINT) AS saved_tokens, coalesce(e.e, sha256('')) AS ends_sha256
FROM node n JOIN below b ON b.p = n.p LEFT JOIN kids k ON k.p = n.p LEFT JOIN up ON up.p = n.p LEFT JOIN node u ON u.p = up.pp LEFT JOIN ends e ON e.p = n.p
""")

WAY = lambda state, cost, edit: f"{{'c': {state}.c + {cost}, 'a': {state}.a || '{edit}'}}"
LEAST = lambda *ways: f"list_min([{', '.join(ways)}])"
KEEP = lambda state, letter: f"CASE WHEN live AND letter = '{letter}' THEN {WAY(state, 'late', 'K')} ELSE far END"
RENAME = lambda state: f"CASE WHEN live THEN {WAY(state, '2 + late', 'R')} ELSE far END"

oracle("op12_conversation_repair", CRC.format(keys="SELECT DISTINCT coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS s FROM conversations") + f"""
raw AS (SELECT conv_id, turn, crc % 20 AS k, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text
        FROM conversations JOIN crc ON crc.s = coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')),
dam AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
               unnest(CASE WHEN k = 3 THEN [1, 2] ELSE [1] END) AS copy FROM raw WHERE k <> 0),
ord AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS i, trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t FROM dam),
ft AS (SELECT *, CASE WHEN t = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd'
              WHEN right(t, 1) NOT IN ('.', '!', '?') THEN 't' ELSE 'o' END AS f, left(role, 1) AS letter, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS prev FROM ord),
ids AS (SELECT DISTINCT conv_id FROM conversations),
sums AS (SELECT ids.conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (f = 'b') AS blank, count(*) FILTER (f = 'd') AS duplicate,
                count(*) FILTER (f = 't') AS truncated, count(*) FILTER (i > 1 AND (prev || letter) NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n
         FROM ids LEFT JOIN ft ON ft.conv_id IS NOT DISTINCT FROM ids.conv_id GROUP BY ids.conv_id),
dp(conv_id, i, far, q0, q1, q2, q3) AS (
  SELECT conv_id, CAST(0 AS BIGINT), {{'c': CAST(1000000000 AS BIGINT), 'a': '~'}}, {{'c': CAST(0 AS BIGINT), 'a': ''}}, {{'c': CAST(1000000000 AS BIGINT), 'a': '~'}},
         {{'c': CAST(2 AS BIGINT), 'a': 'I'}}, {{'c': CAST(4 AS BIGINT), 'a': 'II'}} FROM ids
  UNION ALL
  SELECT conv_id, i, far, n0, n1, m2, {LEAST('n3', WAY('m2', 2, 'I'))} FROM (
    SELECT conv_id, i, far, n0, n1, n3, {LEAST('n2', WAY('n0', 2, 'I'), WAY('n1', 2, 'I'), WAY('n3', 2, 'I'))} AS m2 FROM (
      SELECT conv_id, i, far, {WAY('q0', 3, 'D')} AS n0, {LEAST(WAY('q1', 3, 'D'), KEEP('q0', 's'))} AS n1,
             {LEAST(WAY('q2', 3, 'D'), *(KEEP(q, 'u') for q in ('q0', 'q1', 'q3')), *(RENAME(q) for q in ('q0', 'q1', 'q3')))} AS n2,
             {LEAST(WAY('q3', 3, 'D'), KEEP('q2', 'a'), RENAME('q2'))} AS n3
      FROM (SELECT dp.*, dp.i + 1 AS i2, ft.letter, ft.f IN ('o', 't') AS live, CASE WHEN ft.f = 't' THEN 1 ELSE 0 END AS late
            FROM dp JOIN ft ON ft.conv_id IS NOT DISTINCT FROM dp.conv_id AND ft.i = dp.i + 1) s0(conv_id, i0, far, q0, q1, q2, q3, i, letter, live, late)) s1) s2),
best AS (SELECT s.*, least(dp.q0, dp.q3) AS b FROM sums s JOIN dp ON dp.conv_id IS NOT DISTINCT FROM s.conv_id AND dp.i = coalesce(s.n, 0)),
ed AS (SELECT conv_id, k, substr(a, k, 1) AS e, length(replace(substr(a, 1, k), 'I', '')) AS i, length(replace(substr(a, 1, k), 'D', '')) AS j, length(replace(a, 'D', '')) % 2 AS odd
       FROM (SELECT conv_id, b.a AS a, unnest(range(1, length(b.a) + 1)) AS k FROM best) z),
txt AS (SELECT ed.conv_id, string_agg(CASE WHEN e = 'K' THEN role WHEN (j - odd) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN e = 'I' THEN '' ELSE text END, chr(10) ORDER BY k) AS t
        FROM ed LEFT JOIN ft ON ft.conv_id IS NOT DISTINCT FROM ed.conv_id AND ft.i = ed.i AND e <> 'I' WHERE e <> 'D' GROUP BY ed.conv_id)
SELECT b.conv_id, CAST(gaps AS BIGINT) AS gaps, blank, duplicate, truncated, illegal, CAST(b.b.c AS BIGINT) AS cost, b.b.a AS audit, sha256(coalesce(t, '')) AS repaired_sha256
FROM best b LEFT JOIN txt ON txt.conv_id IS NOT DISTINCT FROM b.conv_id
""")
