"""The corpus operators applied with production parameters to whole tables."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.common import crc_bucket
from tallyloom.llm.decontaminate import find_contaminated
from tallyloom.llm.embedding_dedup import embedding_duplicates
from tallyloom.llm.exact_dedup import exact_dedup
from tallyloom.llm.language_id import fit_languages, identify_languages
from tallyloom.llm.license_scan import TEMPLATES, scan_licenses
from tallyloom.llm.near_dedup import near_duplicates
from tallyloom.llm.packing import pack_documents
from tallyloom.llm.periodic_runs import find_runs
from tallyloom.llm.secret_scan import scan_secrets, written
from tallyloom.llm.spelling import count_words, spelling_variants
from tallyloom.llm.token_count import count_tokens
from tallyloom.llm.toxicity import fit_toxicity, score_toxicity
from tallyloom.llm.url_filter import RULE_SCHEMA, filter_urls
from tallyloom.scratch import cut

URL_RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]
TOKEN_LIMIT = 4096


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"), digest_all=True)


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row with a null id is neither held out nor learned from."""
    docs = table(spark, sf_dir, "documents")
    model = fit_languages(docs, crc_bucket(F.col("doc_id"), 4) != 2)
    held_out = F.coalesce(crc_bucket(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out")
    return identify_languages(docs, model).select("doc_id", held_out, "lang_pred", "score", "rejected")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return counted.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda x: x["kind"] != "learned")
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(written(base), 256).alias("base_sha256"),
        written(F.col("spans")).alias("spans"),
    )


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumn("containment", F.col("n_shared") / F.col("n_item"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, RULE_SCHEMA)
    return filter_urls(table(spark, sf_dir, "pages"), rules)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row with a null id is neither held out nor learned from."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit_toxicity(docs, labels, lambda doc_id: crc_bucket(doc_id, 5) != 0)
    held_out = F.coalesce(crc_bucket(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out")
    return score_toxicity(docs, model).select("doc_id", held_out, "score", "predicted")


def planted_runs(docs: DataFrame) -> DataFrame:
    """Documents as op11's contract has them: every tenth, by the crc32 of its id,
    goes on with words of its own, repeated."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    chosen = docs.withColumn("_words", F.when(h % 10 == 0, words)).withColumn("_n", F.size("_words"))
    a = F.try_mod(g, F.col("_n"))
    rest = F.col("_n") - a
    p = 1 + F.floor(rest / (3 + g % 8))
    unit = F.slice("_words", (a + 1).cast("int"), p.cast("int"))
    again = F.slice(F.flatten(F.array_repeat(unit, F.ceil(rest / p).cast("int"))), 1, rest.cast("int"))
    changed = F.array_join(F.concat(F.slice("_words", 1, a.cast("int")), again), " ")
    return chosen.withColumn("text", F.when(F.col("_n") > 0, changed).otherwise(F.col("text"))).drop("_words", "_n")


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row with a null id is not changed."""
    found = find_runs(planted_runs(table(spark, sf_dir, "documents").select("doc_id", "text")))
    # In order of start and period, so of equal exponents the first stays.
    more = lambda best, x: F.when(x["length"] * best["period"] > best["length"] * x["period"], x).otherwise(best)
    found = found.withColumn("best", F.aggregate("runs", F.get("runs", F.lit(0)), more))
    line = lambda x: F.concat(F.concat_ws(",", x["start"], x["length"], x["period"]), F.lit("\n"))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def planted_typos(doc_id: int | None) -> Callable[[str], str]:
    """Of op12's contract: what becomes of a document's words."""
    begun = zlib.crc32(f"{doc_id}:".encode())

    def change(word: str) -> str:
        h = zlib.crc32(word.encode(), begun)
        if h % 199 or doc_id is None:
            return word
        place = h % len(word)
        return word[:place] + word[place + 1 :]

    return change


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of a row with a null id are not changed."""
    words = count_words(table(spark, sf_dir, "documents"), change=planted_typos)
    return spelling_variants(cut(words, "spelling-words"))


def op13_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_duplicates(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        op1_exact_dedup, op2_license_scan, op3_language_id, op4_token_counts, op5_secret_scan,
        op6_decontamination, op7_best_fit_packing, op8_near_dedup, op9_url_filter, op10_toxicity,
        op11_periodic_runs, op12_spelling_variants, op13_embedding_dedup,
    )
    return {f.__name__: f for f in every}


_OP1 = """
WITH n AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents
)
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY t) AS keep_id,
       count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept,
       sha256(t) AS text_sha256
FROM n
"""

_OP9 = """
WITH rules(action, host, path) AS (
  VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'),
         ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')
), rest AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages
), parts AS (
  SELECT page_id,
         translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path
  FROM rest
), fits AS (
  SELECT p.page_id, p.host, p.path, q.action, q.host || q.path AS rule,
         row_number() OVER (PARTITION BY p.page_id ORDER BY length(q.host || q.path) DESC NULLS LAST) AS k
  FROM parts p LEFT JOIN rules q
    ON (p.host = q.host OR p.host LIKE '%.' || q.host) AND starts_with(p.path, q.path)
)
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM fits WHERE k = 1
"""


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP2 = f"""
WITH templates(template, license, raw) AS (
  VALUES {", ".join("({}, '{}', '{}')".format(i, n, t.replace("'", "''")) for i, (n, t) in enumerate(TEMPLATES))}
), tw AS (
  SELECT template, license, string_split(trim(regexp_replace({_LOWER.format("raw")}, '[^a-z0-9]+', ' ', 'g')), ' ') AS w FROM templates
), tb AS (
  SELECT DISTINCT template, license, w[i] || ' ' || w[i + 1] AS pair FROM (SELECT *, unnest(range(1, len(w))) AS i FROM tw)
), ts AS (
  SELECT template, license, count(*) AS t FROM tb GROUP BY ALL
), l AS (
  SELECT doc_id, generate_subscripts(parts, 1) AS line, unnest(parts) AS raw
  FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents)
), lw AS (
  SELECT doc_id, line, string_split(trim(regexp_replace({_LOWER.format("raw")}, '[^a-z0-9]+', ' ', 'g')), ' ') AS w FROM l
), lb AS (
  SELECT DISTINCT doc_id, line, w[i] || ' ' || w[i + 1] AS pair FROM (SELECT *, unnest(range(1, len(w))) AS i FROM lw)
), ls AS (
  SELECT doc_id, line, count(*) AS m FROM lb GROUP BY ALL
), c AS (
  SELECT doc_id, line, template, license, count(*) AS shared FROM lb JOIN tb USING (pair) GROUP BY ALL
), d AS (
  SELECT *, 2.0::DOUBLE * shared / (m + t) AS dice FROM c JOIN ls USING (doc_id, line) JOIN ts USING (template, license)
  WHERE 200 * shared >= 80 * (m + t)
)
SELECT doc_id, line::INTEGER AS line, license, template::INTEGER AS template, shared, dice FROM d
QUALIFY row_number() OVER (PARTITION BY doc_id, line ORDER BY dice DESC, template) = 1
"""

_OP6 = f"""
WITH t AS (
  SELECT 'd' AS side, doc_id AS id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark
), w AS (
  SELECT side, id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') AS w FROM t
), s AS (
  SELECT DISTINCT side, id, array_to_string(w[i:i + 4], ' ') AS s
  FROM (SELECT *, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM w WHERE len(w) > 0)
), n AS (
  SELECT id, count(*) AS n_item FROM s WHERE side = 'b' GROUP BY id
), c AS (
  SELECT d.id AS doc_id, b.id AS item_id, count(*) AS n_shared
  FROM s d JOIN s b ON d.s = b.s AND d.side = 'd' AND b.side = 'b' GROUP BY ALL
)
SELECT doc_id, item_id, n_item, n_shared, n_shared / n_item AS containment
FROM c JOIN n ON n.id = item_id WHERE 100 * n_shared >= 80 * n_item
"""


_OP13 = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
), u AS (
  SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS norm FROM v
  WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.95
), reach(id, other) AS (
  SELECT vec_id, vec_id FROM v UNION SELECT r.id, l.b FROM reach r JOIN links l ON r.other = l.a
), comp AS (
  SELECT id, min(other) AS component_id FROM reach GROUP BY id
), n AS (
  SELECT a, count(*) AS n_links FROM links GROUP BY a
)
SELECT v.vec_id, coalesce(n_links, 0) AS n_links, component_id, v.vec_id = component_id AS kept
FROM v JOIN comp ON comp.id = v.vec_id LEFT JOIN n ON n.a = v.vec_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_dedup": _OP1, "op2_license_scan": _OP2, "op6_decontamination": _OP6, "op9_url_filter": _OP9, "op13_embedding_dedup": _OP13}
