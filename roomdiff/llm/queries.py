"""Each operator applied to its whole table, and the SQL it must agree with where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roomdiff.functions.stage import new_folder
from roomdiff.llm import decontaminate, fim, licenses, lines, minhash, negatives, pages, pieces, quality, rules, secret_scan, toxicity, warc

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return keep


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def ratings(labels: DataFrame) -> DataFrame:
    """Graded ratings from the quality label alone, toxic or not: 0 poor, 2 well written. The labels tell no grade between them."""
    return labels.select("doc_id", F.when(F.col("quality") == 0, 0).when(F.col("quality") == 1, 2).alias("grade"))


@query("op1_quality_classifier")
def op1(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    model = quality.train(docs, ratings(table(spark, sf, "labels")))
    return quality.rate(docs, model)


@query("op10_toxicity")
def op10(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return toxicity.rate(docs, toxicity.train(docs, table(spark, sf, "labels")))


# Texts as words for SQL: A-Z lowered only, words between space and tab to carriage return, or runs without ASCII separators.
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
PLAIN_WORDS = rf"regexp_extract_all({LOWER}, '[^\x20\x09-\x0D]+')"
TEST_WORDS = rf"regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


@query("op2_decontamination", rf"""
WITH item AS (SELECT item_id, {TEST_WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS win
        FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM item WHERE len(w) > 0)),
doc AS (SELECT doc_id, {TEST_WORDS} AS w FROM documents),
spot AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS win
       FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM doc, (SELECT DISTINCT k FROM win) WHERE len(w) >= k)),
hit AS (SELECT doc_id, spot.k, i, item_id FROM spot JOIN win USING (win)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + k)) AS p FROM hit) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated, coalesce(items, '') AS items
FROM doc LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
""")
def op2(spark: SparkSession, sf: str) -> DataFrame:
    found = decontaminate.scan(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return found.withColumn("items", F.array_join("items", ","))


@query("op3_sentencepiece")
def op3(spark: SparkSession, sf: str) -> DataFrame:
    return pieces.encode(table(spark, sf, "documents"))


def license_sql() -> str:
    names = sorted(licenses.SENTENCES, key=lambda s: (-len(s), s))
    start = "^(" + "|".join(names) + ")( |$)"
    known = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in licenses.SENTENCES.items()) + "}"
    steps, found = ["s AS (SELECT doc_id, ids, ' ' || array_to_string(ids, '  ') || ' ' AS r0 FROM doc)"], []
    for k, (ids, name) in enumerate(licenses.RULES):
        run = " " + "  ".join(ids) + " "
        found.append(f"CASE WHEN contains(r{k}, '{run}') THEN '{name}' END")
        steps.append(f"s{k} AS (SELECT *, replace(r{k}, '{run}', ' | ') AS r{k + 1} FROM {f's{k - 1}' if k else 's'})")
    return rf"""
WITH said AS (SELECT doc_id, list_transform(regexp_split_to_array(coalesce(text, ''), '[.;:!?]+([ \t\n\r\f]|$)|\n'),
                                            lambda x: trim(lower(regexp_replace(x, '[^A-Za-z0-9]+', ' ', 'g')))) AS said FROM documents),
doc AS (SELECT doc_id, list_transform(list_filter(said, lambda x: regexp_matches(x, '{start}')), lambda x: {known}[regexp_extract(x, '{start}', 1)]) AS ids FROM said),
{", ".join(steps)},
named AS (SELECT doc_id, ids, list_filter([{", ".join(found)}], lambda x: x IS NOT NULL) AS n FROM s{len(licenses.RULES) - 1})
SELECT doc_id, coalesce(array_to_string(ids, ','), '') AS sentence_ids,
       coalesce(array_to_string(list_filter(n, lambda x, i: list_position(n, x) = i), ','), '') AS licenses, len(ids) AS n_known FROM named
"""


@query("op4_license_scan", license_sql())
def op4(spark: SparkSession, sf: str) -> DataFrame:
    return licenses.scan(table(spark, sf, "documents"))


def secret_sql() -> str:
    """Places of matches: the lengths of the parts between matches and of the matches before, added up."""
    one = []
    for k, r in enumerate(secret_scan.RULES):
        pattern = r.pattern.replace("'", "''")
        group = f"regexp_extract(m, '{pattern}', {r.group})"
        one.append(f"""SELECT doc_id, '{r.kind}' AS kind, {k} AS k, a, a + length(m) AS b FROM (
            SELECT doc_id, m[i] AS m, list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS a
            FROM (SELECT doc_id, m, p, unnest(range(1, len(m) + 1)) AS i
                  FROM (SELECT doc_id, regexp_extract_all(text, '{pattern}') AS m, regexp_split_to_array(text, '{pattern}') AS p FROM documents WHERE text IS NOT NULL)))
            WHERE length({group}) >= {r.least}""")
    return f"""
WITH span AS ({" UNION ALL ".join(one)}),
doc AS (SELECT doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex, count(*) AS n_spans,
        string_agg(kind || ':' || CAST(a AS BIGINT) || ':' || CAST(b AS BIGINT), ',' ORDER BY a, k) FILTER (k < {len(secret_scan.BASE)}) AS base,
        string_agg(kind || ':' || CAST(a AS BIGINT) || ':' || CAST(b AS BIGINT), ',' ORDER BY a, k) AS spans FROM span GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
       coalesce(spans, '') AS spans, coalesce(n_spans, 0) AS n_spans FROM documents d LEFT JOIN doc USING (doc_id)
"""


@query("op5_secret_scan", secret_sql())
def op5(spark: SparkSession, sf: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf, "documents"))


@query("op6_html_extraction")
def op6(spark: SparkSession, sf: str) -> DataFrame:
    return pages.extract(table(spark, sf, "pages"))


@query("op7_quality_rules")
def op7(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return rules.judge(docs, rules.train(docs, table(spark, sf, "labels")))


@query("op8_minhash", rf"""
WITH RECURSIVE doc AS (SELECT doc_id, {PLAIN_WORDS} AS w FROM documents),
sets AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) >= 2 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])
                                                     WHEN len(w) = 1 THEN w ELSE [] END)) AS s FROM doc),
node AS (SELECT min(doc_id) AS node, s, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY s),
part AS (SELECT node, n, unnest(s) AS x FROM node),
same AS (SELECT a.node AS u, b.node AS v, a.n AS n, b.n AS m, count(*) AS k FROM part a JOIN part b USING (x) WHERE a.node < b.node GROUP BY ALL),
link AS (SELECT u, v FROM same WHERE 100 * k >= 80 * (n + m - k)),
edge AS (SELECT u, v FROM link UNION SELECT v, u FROM link UNION SELECT node, node FROM node),
reach AS (SELECT node AS a, node AS b FROM node UNION SELECT reach.a, edge.v FROM reach JOIN edge ON reach.b = edge.u),
comp AS (SELECT a AS node, min(b) AS c FROM reach GROUP BY a),
found AS (SELECT sets.doc_id, len(sets.s) AS n_shingles, coalesce(comp.c, sets.doc_id) AS component_id
          FROM sets LEFT JOIN node ON sets.s = node.s LEFT JOIN comp USING (node))
SELECT doc_id, n_shingles, component_id, doc_id = component_id AS kept FROM found
""")
def op8(spark: SparkSession, sf: str) -> DataFrame:
    return minhash.components(table(spark, sf, "documents"), n=2, percent=80)


@query("op9_line_dedup", f"""
WITH part AS (SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents WHERE text IS NOT NULL),
line AS (SELECT doc_id, source, text, line, i, trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS t FROM part),
wide AS (SELECT t, min(doc_id) AS first FROM line WHERE t <> '' AND source IS NOT NULL AND doc_id IS NOT NULL GROUP BY t HAVING count(DISTINCT source) >= {lines.SITES}),
judged AS (SELECT line.*, wide.t IS NOT NULL AND doc_id <> first AS gone FROM line LEFT JOIN wide USING (t)),
doc AS (SELECT doc_id, text, count(*) FILTER (t <> '') AS n_lines, count(*) FILTER (gone) AS n_removed,
        coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT coalesce(gone, false)), '') AS clean FROM judged GROUP BY doc_id, text)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, clean AS text FROM documents d LEFT JOIN doc USING (doc_id)
""")
def op9(spark: SparkSession, sf: str) -> DataFrame:
    found = lines.cleaned(table(spark, sf, "documents"))
    return found.select("doc_id", F.col("__lines").alias("n_lines"), F.col("__gone").alias("n_removed"), "text")


@query("op13_fill_in_middle", r"""
WITH doc AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || CAST(doc_id AS VARCHAR)) AS h FROM documents),
drawn AS (SELECT doc_id, t, u, len(u) AS n, CAST('0x' || h[1:8] AS BIGINT) AS a, CAST('0x' || h[9:16] AS BIGINT) AS b, CAST('0x' || h[17:24] AS BIGINT) AS c,
                 CAST('0x' || h[25:32] AS BIGINT) AS d FROM doc),
form AS (SELECT doc_id, t, u, n, least(a % (n + 1), b % (n + 1)) AS i, greatest(a % (n + 1), b % (n + 1)) AS j,
                CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR c % 100 >= 100 THEN 'plain' WHEN d % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM drawn),
part AS (SELECT doc_id, t, n, form, coalesce(array_to_string(u[1:i], ''), '') AS p, coalesce(array_to_string(u[i + 1:j], ''), '') AS m, coalesce(array_to_string(u[j + 1:], ''), '') AS s FROM form)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256 FROM part
""")
def op13(spark: SparkSession, sf: str) -> DataFrame:
    made = fim.transform(table(spark, sf, "documents"))
    back = fim.restore(made.withColumn("output_sha256", F.sha2("output", 256)))
    return back.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", F.sha2("output", 256).alias("restored_sha256"))


@query("op11_warc", """
WITH page AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
sized AS (SELECT page_id, octet_length(payload) AS n, sha1(payload) AS digest FROM page),
top AS (SELECT n, digest, max(page_id) AS first FROM sized WHERE n >= 1000 GROUP BY n, digest)
SELECT page_id, n AS payload_bytes, digest AS payload_digest, CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to FROM sized LEFT JOIN top USING (n, digest)
""")
def op11(spark: SparkSession, sf: str) -> DataFrame:
    folder = new_folder(spark, "warc")
    warc.write(table(spark, sf, "pages"), folder)
    found = warc.resolved(warc.read(spark, folder, keep=False))
    return found.select(F.col("id").cast("bigint").alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"), F.col("kind").alias("record_type"),
                        F.col("refers").cast("bigint").alias("refers_to"))


@query("op12_hard_negatives", """
WITH sound AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                      list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
               WHERE label IS NOT NULL AND vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
score AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, CAST(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i])) AS BIGINT) AS s
          FROM sound a, sound b WHERE a.vec_id % 100 = 0),
positive AS (SELECT a, b, s FROM score WHERE same AND a <> b QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 5)
SELECT p.a AS anchor_id, p.b AS positive_id, CAST(row_number() OVER (PARTITION BY p.a, p.b ORDER BY n.s DESC, n.b) AS INTEGER) AS rank, n.b AS negative_id,
       p.s AS positive_score, n.s AS negative_score
FROM positive p JOIN score n ON p.a = n.a AND NOT n.same AND 80 * p.s <= 100 * n.s AND 100 * n.s <= 100 * p.s
QUALIFY row_number() OVER (PARTITION BY p.a, p.b ORDER BY n.s DESC, n.b) <= 5
""")
def op12(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "embeddings").select("vec_id", "embedding", "label")
    rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return negatives.mine(rows, rows.filter("vec_id % 100 = 0"))
