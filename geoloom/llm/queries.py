"""The queries of the corpus operators and, where SQL can say the same, that SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bpe import round_trip
from .common import documents
from .divergence import divergence
from .exact_dedup import exact_dedup
from .license_scan import scan_licenses
from .line_dedup import dedup_lines
from .mixing import mix
from .packing import pack
from .pii import find_personal_data
from .quality_rules import quality_rules
from .sharding import shard_documents
from .simhash import near_duplicates
from .spelling import spelling_variants
from .weak_labels import score_quality


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_pii": lambda spark, sf_dir: find_personal_data(documents(spark, sf_dir)),
        "op2_bpe": lambda spark, sf_dir: round_trip(documents(spark, sf_dir)),
        "op3_sharding": lambda spark, sf_dir: shard_documents(documents(spark, sf_dir)),
        "op4_mixing": lambda spark, sf_dir: mix(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")),
        "op5_exact_dedup": lambda spark, sf_dir: exact_dedup(documents(spark, sf_dir)),
        "op6_license_scan": lambda spark, sf_dir: scan_licenses(documents(spark, sf_dir)),
        "op7_line_dedup": lambda spark, sf_dir: dedup_lines(documents(spark, sf_dir), digest_only=True),
        "op8_quality_rules": lambda spark, sf_dir: quality_rules(documents(spark, sf_dir)),
        "op9_weak_labels": lambda spark, sf_dir: score_quality(documents(spark, sf_dir)),
        "op10_simhash": lambda spark, sf_dir: near_duplicates(documents(spark, sf_dir)),
        "op11_divergence": lambda spark, sf_dir: divergence(documents(spark, sf_dir)),
        "op12_packing": lambda spark, sf_dir: pack(documents(spark, sf_dir)),
        "op13_spelling": lambda spark, sf_dir: spelling_variants(documents(spark, sf_dir)),
    }


SPACE = r"[\x20\x09-\x0D]"

OP5_SQL = rf"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '{SPACE}', '', 'g') AS s FROM documents),
     k AS (SELECT doc_id, s, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY s) AS group_size
           FROM t WINDOW w AS (PARTITION BY s ORDER BY n DESC, doc_id))
SELECT doc_id, keep_id, group_size, keep_id = doc_id AS kept, sha256(s) AS text_sha256 FROM k
"""

OP7_SQL = r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
     k AS (SELECT *, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
     r AS (SELECT key, min(doc_id) AS first_id FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1),
     m AS (SELECT k.*, r.first_id IS NOT NULL AND r.first_id < k.doc_id AS lost FROM k LEFT JOIN r ON k.key = r.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE lost) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT lost), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""


OP11_SQL = r"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
     g AS (SELECT DISTINCT lang, source FROM d),
     o AS (SELECT lang, source, unnest(ws) AS term FROM d),
     v AS (SELECT lang, term FROM (SELECT lang, unnest(list_distinct(ws)) AS term FROM d) GROUP BY lang, term HAVING count(*) >= 3),
     c AS (SELECT lang, source, term, count(*) AS n FROM o JOIN v USING (lang, term) GROUP BY ALL),
     z AS (SELECT lang, count(*) AS terms FROM v GROUP BY lang),
     a AS (SELECT g.lang, g.source, v.term, coalesce(c.n, 0) AS n FROM g JOIN v USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = v.term),
     p AS (SELECT a.*, CAST(1 + (1000000000::HUGEINT * (n + 1)) // (sum(n) OVER (PARTITION BY lang, source) + terms) AS BIGINT) AS p FROM a JOIN z USING (lang)),
     q AS (SELECT lang, term, CAST(1 + (1000000000::HUGEINT * (n + 1)) // (sum(n) OVER (PARTITION BY lang) + terms) AS BIGINT) AS q FROM (SELECT lang, term, sum(n) AS n FROM a GROUP BY lang, term) JOIN z USING (lang)),
     s AS (SELECT x.lang, x.source, y.source AS item, sum(((x.p - y.p) * (x.p - y.p)) // y.p) AS value FROM p x JOIN p y ON y.lang = x.lang AND y.term = x.term AND y.source <> x.source GROUP BY ALL),
     r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value FROM g a JOIN g b ON b.lang = a.lang AND b.source <> a.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
           UNION ALL SELECT p.lang, p.source, 'term', p.term, CAST(((p - q) * (p - q)) // q AS BIGINT) FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
SELECT * FROM (SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM r) WHERE part = 'pair' OR rank <= 200
"""


def oracle_sql() -> dict[str, str]:
    return {"op5_exact_dedup": OP5_SQL, "op7_line_dedup": OP7_SQL, "op11_divergence": OP11_SQL}
