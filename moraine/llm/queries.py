"""The registered queries of the text operators, and the SQL that some of them must equal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ship
from . import bpe, codes, exactdup, langid, mixing, neardup, pii, rules, secretscan, substrings, tokenfile, toxicity, trie


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluates the rules anew, whatever ledgers there are, and leaves one for ``quality_rule_ablations``."""
    led = rules.apply_policy(rules.keep_ledger(_docs(spark, sf_dir)), "v1")
    base = rules.fails(F.col("fail_bits"), rules.mask_of(*rules.POLICIES["base"]))
    return led.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), "kept", "fail_bits")


def quality_rule_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of the policy does to the corpus, from the ledger alone: the one that
    ``op1_quality_rules`` left, if the files are still the same."""
    return rules.ablations(rules.kept_ledger(_docs(spark, sf_dir)), "v1")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    learned = docs.filter(~langid.held_out(F.col("doc_id")))
    found = langid.predict(docs, langid.train(learned))
    return found.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op3_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(_docs(spark, sf_dir), tokenizer_path())


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup.near_components(_docs(spark, sf_dir), percent=85)
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "kept")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exactdup.exact_groups(_docs(spark, sf_dir), hash_all=True)
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_docs(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op7_repeated_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.repeated_spans(_docs(spark, sf_dir))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    found = secretscan.scan(docs, secretscan.train(docs))
    base = F.filter("spans", lambda x: x["kind"] < 3)
    count = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long")
    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(secretscan.spans_string(base), 256).alias("base_sha256"),
        secretscan.spans_string(F.col("spans")).alias("spans"),
    )


def op9_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key is a fixed one here, so that reruns agree; a user passes one from a secret store."""
    found = pii.pseudonymise(_docs(spark, sf_dir), key=b"key of the registered query")
    return found.select("doc_id", "text", F.size("spans").cast("long").alias("n_values"), F.array_join(F.transform("spans", lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",").alias("spans"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.token_ranges(_docs(spark, sf_dir), tokenizer_path())


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.train(docs, labels.filter(~toxicity.held_out(F.col("doc_id"))))
    found = toxicity.score(docs, model)
    return found.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "n_hits")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    found, books = codes.compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return found.select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(codes.digest(books)).alias("codebooks_sha256"))


def queries() -> dict:
    found = [op1_quality_rules, op2_language_id, op3_bpe_round_trip, op4_near_dedup, op5_exact_dedup, op6_mixing, op7_repeated_substrings, op8_secret_scan, op9_pseudonyms, op10_token_files, op11_toxicity, op12_prefix_trie, op13_vector_codes, quality_rule_ablations]
    return {f.__name__: f for f in found}


_SPACES = r"[\x20\x09-\x0D]+"

ORACLE = {
    "op5_exact_dedup": rf"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '{_SPACES}', ' ', 'g')) AS sha FROM documents),
g AS (SELECT sha, min(doc_id) AS keep_id, count(*) AS n FROM t GROUP BY 1)
SELECT doc_id, keep_id, n AS group_size, doc_id = keep_id AS kept, sha AS text_sha256 FROM t JOIN g USING (sha)""",
    "op1_quality_rules": rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, list_filter(regexp_split_to_array(coalesce(text, ''), '{_SPACES}'), lambda x: x <> '') AS w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
win AS (SELECT doc_id, i, list_slice(w, i, i + 7) AS g FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 7)) AS i FROM t)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win) WHERE n > 1),
cov AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM twice, generate_series(0, 7) s(o) GROUP BY 1),
stut AS (SELECT doc_id, count(*) AS n FROM (SELECT doc_id, w, unnest(generate_series(2, len(w))) AS i FROM t) WHERE w[i] = w[i - 1] GROUP BY 1),
m AS (SELECT t.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(list_aggregate(w, 'string_agg', '')) AS BIGINT) AS wc, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
  length(text) - length(regexp_replace(text, '\p{{Lu}}', '', 'g')) AS caps, CAST(len(l) AS BIGINT) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words, coalesce(stut.n, 0) AS stutter
  FROM t LEFT JOIN cov USING (doc_id) LEFT JOIN stut USING (doc_id)),
b AS (SELECT *, coalesce(wc, 0) AS word_chars, (n_words < 20) AS r0, (100 * n_repeat_words > 30 * n_words) AS r1, (100 * n_symbols > 20 * n_words) AS r2, (100 * caps > 40 * coalesce(wc, 0)) AS r3, (100 * stutter > 30 * n_words) AS r4,
  (100 * n_dup_lines > 60 * n_lines) AS r5, (coalesce(wc, 0) < 2 * n_words OR coalesce(wc, 0) > 20 * n_words) AS r6 FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, r0 OR r1 AS base_failed, NOT (r0 OR r1 OR r2 OR r3 OR r4 OR r5 OR r6) AS kept,
  CAST(r0::INT + 2 * r1::INT + 4 * r2::INT + 8 * r3::INT + 16 * r4::INT + 32 * r5::INT + 64 * r6::INT AS BIGINT) AS fail_bits FROM b""",
    "op6_mixing": rf"""
WITH t AS (SELECT doc_id, source, CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '{_SPACES}'), lambda x: x <> '')) AS BIGINT) AS size,
  CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS place FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS ss, row_number() OVER (ORDER BY source NULLS LAST) AS k FROM t GROUP BY 1),
w AS (SELECT source, ss, CAST([5, 2, 1][(k - 1) % 3 + 1] AS DOUBLE) AS w, 2.0::DOUBLE * ss AS cap FROM s),
o AS (SELECT *, cap / w AS r, row_number() OVER (ORDER BY cap / w, source NULLS LAST) AS j FROM w),
v AS (SELECT *, (1.5::DOUBLE * (SELECT sum(ss) FROM s) - coalesce((SELECT sum(cap) FROM o p WHERE p.j < o.j), 0)) / (SELECT sum(w) FROM o p WHERE p.j >= o.j) AS level FROM o),
x AS (SELECT arg_min(level, j) AS level FROM v WHERE level <= r),
g AS (SELECT o.source, ss, least(cap, coalesce(x.level * w, cap)) AS target FROM o LEFT JOIN x ON true),
p AS (SELECT *, CAST(CASE WHEN ss > 0 THEN floor(target / ss) ELSE 0 END AS BIGINT) AS whole FROM g),
c AS (SELECT t.source, place, CAST(sum(size) AS DOUBLE) AS words FROM t GROUP BY 1, 2),
u AS (SELECT c.source, place, words, sum(words) OVER (PARTITION BY c.source ORDER BY place) AS upto, greatest(0, p.target - p.whole * p.ss) AS budget FROM c JOIN p ON p.source IS NOT DISTINCT FROM c.source WHERE ss > 0),
f AS (SELECT source, min(place) AS first, arg_min(upto, place) AS upto, arg_min(words, place) AS words, any_value(budget) AS budget FROM u WHERE upto > budget GROUP BY 1),
e AS (SELECT source, CASE WHEN upto - budget < budget - (upto - words) THEN first + 1 ELSE first END AS cut FROM f)
SELECT t.doc_id, t.size, p.ss AS source_size, p.target AS target, CAST((p.whole + CASE WHEN t.place < coalesce(e.cut, 0) THEN 1 ELSE 0 END) * t.size AS BIGINT) AS taken
FROM t JOIN p ON p.source IS NOT DISTINCT FROM t.source LEFT JOIN e ON e.source IS NOT DISTINCT FROM t.source""",
}

ORACLE["quality_rule_ablations"] = f"""
SELECT rule, count(*) FILTER (fail_bits & m <> 0) AS n_failed, count(*) FILTER (fail_bits = m) AS n_failed_alone, count(*) FILTER (fail_bits & (127 - m) = 0) AS n_kept_without, count(*) FILTER (fail_bits = 0) AS n_kept
FROM ({ORACLE['op1_quality_rules']}) l, (VALUES ('few_words', 1), ('repeated_windows', 2), ('symbols', 4), ('capitals', 8), ('stutter', 16), ('repeated_lines', 32), ('word_length', 64)) r(rule, m) GROUP BY rule"""

# crc32 bit by bit over the digits of the id; a node is the list of its turns, as text
ORACLE["op12_prefix_trie"] = rf"""
WITH own AS (SELECT conv_id AS c, list(struct_pack(r := coalesce(role, ''), t := coalesce(text, '')) ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS l FROM conversations WHERE conv_id IS NOT NULL GROUP BY 1),
bits AS (SELECT c, l, list_transform(generate_series(0, 8 * length(CAST(c AS VARCHAR)) - 1), lambda i: CAST((ascii(substr(CAST(c AS VARCHAR), i // 8 + 1, 1)) >> (i % 8)) & 1 AS BIGINT)) AS b FROM own),
crc AS (SELECT c, l, xor(list_reduce(list_concat([4294967295::BIGINT], b), lambda x, y: xor(x >> 1, (xor(x, y) & 1) * 3988292384)), 4294967295) % 4 AS h FROM bits),
conv AS MATERIALIZED (SELECT k.c, list_concat(list_slice(coalesce(o.l, []), 1, h), list_slice(k.l, h + 1, len(k.l))) AS l FROM crc k LEFT JOIN own o ON o.c = k.c - k.c % 20),
steps AS MATERIALIZED (SELECT c, d, len(l) AS n, md5(CAST(list_transform(list_slice(l, 1, d), lambda x: md5(x.r) || md5(x.t)) AS VARCHAR)) AS p, CASE WHEN d > 0 THEN md5(CAST(list_transform(list_slice(l, 1, d - 1), lambda x: md5(x.r) || md5(x.t)) AS VARCHAR)) END AS up,
  CASE WHEN d > 0 THEN CAST(len(list_filter(regexp_split_to_array(l[d].t, '{_SPACES}'), lambda x: x <> '')) AS BIGINT) ELSE 0 END AS words FROM conv, unnest(generate_series(0, len(l))) g(d)),
node AS MATERIALIZED (SELECT p, d, any_value(up) AS up, min(c) AS conv_id, count(*) AS n_convs, any_value(words) AS words, sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (d = n), '')) AS ends FROM steps GROUP BY 1, 2),
kids AS (SELECT up AS p, count(*) AS k FROM node WHERE d > 0 GROUP BY 1),
full_node AS (SELECT node.*, coalesce(k, 0) AS k FROM node LEFT JOIN kids USING (p)),
below AS (SELECT DISTINCT a.p AS top, b.p AS p FROM steps a JOIN steps b ON a.c = b.c AND a.d <= b.d),
sums AS (SELECT top AS p, CAST(count(*) FILTER (k = 0) AS BIGINT) AS n_leaves, CAST(sum((n_convs - 1) * words) AS BIGINT) AS saved FROM below JOIN full_node USING (p) GROUP BY 1)
SELECT f.conv_id, CAST(f.d AS BIGINT) AS depth, u.conv_id AS parent_conv_id, f.n_convs, f.k AS n_children, n_leaves, saved AS saved_tokens, f.ends AS ends_sha256 FROM full_node f JOIN sums USING (p) LEFT JOIN node u ON u.p = f.up"""


def _vector_codes_sql() -> str:
    """The rounds of k-means one after another, each as a table of assignments and one of entries."""
    near = """a{r} AS MATERIALIZED (SELECT id, part, v, arg_min(k, d * 16 + k) AS k, min(d) AS d FROM
(SELECT p.id, p.part, p.v, c.k, list_sum(list_transform(list_zip(p.v, c.v), lambda x: CAST(x[1] - x[2] AS HUGEINT) * (x[1] - x[2]))) AS d FROM p JOIN c{r} c USING (part)) GROUP BY 1, 2, 3)"""
    mean = """c{n} AS MATERIALIZED (SELECT c.part, c.k, coalesce(m.v, c.v) AS v FROM c{r} c LEFT JOIN
(SELECT part, k, list(CAST(CAST(floor((s - ((s % n) + n) % n) / n) AS HUGEINT) AS BIGINT) ORDER BY i) AS v FROM
(SELECT part, k, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM (SELECT part, k, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{r}) GROUP BY 1, 2, 3) GROUP BY 1, 2) m USING (part, k))"""
    rounds = ",\n".join(near.format(r=r) + ",\n" + mean.format(r=r, n=r + 1) for r in range(6))
    return f"""
WITH q AS (SELECT vec_id AS id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT id, part, list_slice(q, part * (len(q) // 8) + 1, (part + 1) * (len(q) // 8)) AS v FROM q, generate_series(0, 7) g(part)),
c0 AS MATERIALIZED (SELECT part, CAST(row_number() OVER (PARTITION BY part ORDER BY id) - 1 AS BIGINT) AS k, v FROM p QUALIFY row_number() OVER (PARTITION BY part ORDER BY id) <= 16),
{rounds},
{near.format(r=6)},
e AS (SELECT id, string_agg(printf('%02x', k), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a6 GROUP BY 1),
b AS (SELECT sha256(coalesce(string_agg(array_to_string(v, ','), ',' ORDER BY part, k), '')) AS sha FROM c6)
SELECT id AS vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, sha AS codebooks_sha256 FROM e JOIN q USING (id), b"""


ORACLE["op13_vector_codes"] = _vector_codes_sql()


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
