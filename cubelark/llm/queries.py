"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cubelark.llm import automata, fingerprints, jaccard, language, nearest, packing, pieces, suffixes, warc, webtrust
from cubelark.llm.common import table


#: Vocabulary, ranks and pattern of the tokenizer of op4.
BYTE_BPE = (public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.digests(table(spark, sf_dir, "documents"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), BYTE_BPE)


def op5_automaton_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return automata.digests(table(spark, sf_dir, "documents"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.clustered(table(spark, sf_dir, "documents"), jaccard.Rule(words=3, num=90, den=100))


def jaccard_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The join of op6 with the number of links of each row; classes are numbered by hashes, which SQL doesn't have."""
    return jaccard.counted(table(spark, sf_dir, "documents"), jaccard.Rule(words=3, num=90, den=100)).drop("class_id")


#: Verdict, host and path of the contract's rules.
URL_RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = webtrust.judge(table(spark, sf_dir, "pages"), URL_RULES)
    return judged.withColumn("trust", F.round("trust", 9)).withColumn("distrust", F.round("distrust", 9))


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op9_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as WARC records against a replica in which the last byte of every 97th payload is another one."""
    pages = table(spark, sf_dir, "pages")
    html = F.coalesce("html", F.lit(""))
    damaged = F.when((F.col("page_id") % 97 == 0) & (html != ""), F.concat(F.expr("left(html, length(html) - 1)"), F.lit("#"))).otherwise(html)
    ours = pages.select("page_id", warc.record(F.col("url"), html).alias("record"))
    theirs = pages.select("page_id", warc.record(F.col("url"), damaged).alias("record"))
    return warc.audit(ours, theirs, "page_id", "record")


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {
    "op1_fingerprints": op1_fingerprints,
    "op2_language_id": op2_language_id,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_automaton_dedup": op5_automaton_dedup,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_url_filter": op7_url_filter,
    "op8_exact_top_k": op8_exact_top_k,
    "op9_warc_fixity": op9_warc_fixity,
    "op10_sentencepiece": op10_sentencepiece,
    "jaccard_links": jaccard_links,
}

def _rounds(name: str, edges: str, seeds: str) -> str:
    """Common table expressions of all rounds of propagation; the last is ``name``."""
    out = [f"{name}_0 AS MATERIALIZED (SELECT host, w / (SELECT sum(w) FROM {seeds}) AS rank FROM {seeds})"]
    last = webtrust.rounds()
    for i in range(1, last + 1):
        out.append(f"""{name}_{i} AS MATERIALIZED (SELECT host, sum(rank) AS rank FROM (
            SELECT dst AS host, rank * share * {webtrust.DAMPING} AS rank FROM {edges} JOIN {name}_{i - 1} ON src = host
            UNION ALL SELECT host, rank * (1 - {webtrust.DAMPING}) FROM {name}_0) GROUP BY host)""")
    return ", ".join([*out, f"{name} AS (SELECT host, rank / sum(rank) OVER () AS rank FROM {name}_{last})"])


_RULE = "CASE " + " ".join(
    f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h + p}'" for _, h, p in sorted(URL_RULES, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
) + " END"
_VERDICT = "CASE " + " ".join(f"WHEN rule = '{h + p}' THEN '{v}'" for v, h, p in URL_RULES) + " END"
_UPPER, _LOWER = webtrust.UPPER, webtrust.LOWER
_TAIL = "CASE WHEN contains({0}, '://') THEN substr({0}, position('://' IN {0}) + 3) END"
_HOST = f"coalesce(translate(regexp_extract({_TAIL}, '(?s)^([^/?#]*)', 1), '{_UPPER}', '{_LOWER}'), '')"
_PATH = f"coalesce(regexp_extract({_TAIL}, '(?s)^[^/?#]*([^?#]*)', 1), '')"
_LINK = "(?i)<a\\b[^>]*?\\bhref\\s*=\\s*[\"'']?(?:[a-z][a-z0-9+.-]*:)?//([^\"''\\s>/?#]*)"

_LINKS = rf"""
        WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        s AS (
            SELECT DISTINCT doc_id, array_to_string(ws[i:i + 2], ' ') AS x FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM d WHERE len(ws) >= 3)
            UNION ALL SELECT doc_id, array_to_string(ws, ' ') FROM d WHERE len(ws) BETWEEN 1 AND 2
        ), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
        links AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 90 * (x.n + y.n - o)),
        both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
        reached AS (SELECT doc_id, doc_id AS other FROM d UNION SELECT doc_id, b FROM reached JOIN both_ways ON other = a)"""

ORACLE_SQL: dict[str, str] = {
    "op3_suffix_dedup": """
        WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS h FROM documents),
        b AS (SELECT doc_id, unnest(range(octet_length(h))) AS i, h FROM d),
        w AS (SELECT doc_id, i, md5_number(h[i + 1:i + 100]) AS s FROM b WHERE i + 100 <= octet_length(h)),
        f AS (SELECT s, min(doc_id * 4294967296 + i) AS first FROM w GROUP BY s HAVING count(*) > 1),
        r AS (SELECT doc_id, i FROM w JOIN f ON w.s = f.s WHERE doc_id * 4294967296 + i > first),
        e AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM r),
        n AS (SELECT doc_id, i, sum(CASE WHEN before >= i - 100 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM e),
        spans AS (SELECT doc_id, span, min(i) AS lo, max(i) + 100 AS hi FROM n GROUP BY doc_id, span),
        gaps AS (
            SELECT doc_id, lo AS hi, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS lo FROM spans
            UNION ALL SELECT doc_id, octet_length(any_value(h)), coalesce(max(hi), 0) FROM d LEFT JOIN spans USING (doc_id) GROUP BY doc_id
        ),
        kept AS (SELECT doc_id, sha256(unhex(coalesce(string_agg(hex(h[lo + 1:gaps.hi]), '' ORDER BY lo), ''))) AS kept_sha256 FROM gaps JOIN d USING (doc_id) GROUP BY doc_id),
        a AS (SELECT doc_id, sum(hi - lo) AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id)
        SELECT d.doc_id, CAST(octet_length(h) AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, kept_sha256
        FROM d JOIN kept USING (doc_id) LEFT JOIN a ON d.doc_id = a.doc_id
    """,
    "op5_automaton_dedup": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        k AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM d WHERE len(ws) >= 13)),
        f AS (SELECT s, min(doc_id) AS first FROM k GROUP BY s),
        gone AS (SELECT DISTINCT doc_id, i + j AS i FROM k JOIN f ON k.s = f.s, range(13) t(j) WHERE first < doc_id),
        words AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM d),
        a AS (
            SELECT words.doc_id, count(gone.i) AS n_removed, string_agg(word, ' ' ORDER BY words.i) FILTER (WHERE gone.i IS NULL) AS kept
            FROM words LEFT JOIN gone ON words.doc_id = gone.doc_id AND words.i = gone.i GROUP BY words.doc_id
        )
        SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
        FROM d LEFT JOIN a ON d.doc_id = a.doc_id
    """,
    "op6_jaccard_join": f"""
        {_LINKS}
        SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id
        FROM d LEFT JOIN n ON d.doc_id = n.doc_id JOIN (SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id) c ON c.doc_id = d.doc_id
    """,
    "jaccard_links": f"""
        {_LINKS}
        SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, coalesce(n_links, 0) AS n_links
        FROM d LEFT JOIN n ON d.doc_id = n.doc_id JOIN (SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id) c ON c.doc_id = d.doc_id
        LEFT JOIN (SELECT a AS doc_id, count(*) AS n_links FROM both_ways GROUP BY a) l ON l.doc_id = d.doc_id
    """,
    "op7_url_filter": f"""
        WITH p AS (SELECT page_id, coalesce(html, '') AS html, {_HOST.format('url')} AS host, {_PATH.format('url')} AS path FROM pages),
        q AS (SELECT *, {_RULE} AS rule FROM p), v AS (SELECT *, {_VERDICT} AS ruled FROM q),
        found AS (SELECT host AS src, unnest(regexp_extract_all(html, '{_LINK}', 1)) AS link FROM v WHERE host <> ''),
        parents AS (SELECT DISTINCT host, regexp_extract(host, '^[^.]+\\.(.+\\..+)$', 1) AS parent FROM v WHERE host <> ''),
        every AS (
            SELECT src, translate(link, '{_UPPER}', '{_LOWER}') AS dst FROM found
            UNION ALL SELECT host, parent FROM parents WHERE parent <> '' UNION ALL SELECT parent, host FROM parents WHERE parent <> ''
        ), edges AS (SELECT src, dst, count(*) AS n FROM every WHERE dst <> '' AND src <> dst GROUP BY src, dst),
        ahead AS (SELECT src, dst, n / sum(n) OVER (PARTITION BY src) AS share FROM edges),
        back AS (SELECT dst AS src, src AS dst, n / sum(n) OVER (PARTITION BY dst) AS share FROM edges),
        good AS (SELECT host, count(*) AS w FROM v WHERE ruled = 'allow' AND host <> '' GROUP BY host),
        bad AS (SELECT host, count(*) AS w FROM v WHERE ruled = 'block' AND host <> '' GROUP BY host),
        {_rounds('trusted', 'ahead', 'good')}, {_rounds('distrusted', 'back', 'bad')}
        SELECT page_id, v.host, path, rule, coalesce(ruled, CASE WHEN coalesce(d.rank, 0) > {webtrust.THRESHOLD} * coalesce(t.rank, 0) THEN 'block' ELSE 'allow' END) AS verdict,
            round(coalesce(t.rank, 0), 9) AS trust, round(coalesce(d.rank, 0), 9) AS distrust
        FROM v LEFT JOIN trusted t ON t.host = v.host LEFT JOIN distrusted d ON d.host = v.host
    """,
    "op9_warc_fixity": """
        WITH damaged AS (
            SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html,
                CASE WHEN page_id % 97 = 0 AND coalesce(html, '') <> '' THEN left(html, length(html) - 1) || '#' ELSE coalesce(html, '') END AS other
            FROM pages
        ), records AS (
            SELECT page_id, CAST(floor(page_id / 4096) AS BIGINT) AS archive,
                chr(13) || chr(10) AS e,
                'WARC/1.1' || e || 'WARC-Type: resource' || e || 'WARC-Target-URI: ' || url || e || 'Content-Type: text/html' || e || 'Content-Length: ' AS head,
                head || strlen(html) || e || e || html || e || e AS ours,
                head || strlen(other) || e || e || other || e || e AS theirs
            FROM damaged
        )
        SELECT archive, page_id,
            CAST(sum(strlen(ours)) OVER (PARTITION BY archive ORDER BY page_id) - strlen(ours) AS BIGINT) AS start,
            CAST(strlen(ours) AS BIGINT) AS length, sha256(ours) AS digest, sha256(theirs) AS replica_digest,
            CASE WHEN ours = theirs THEN 'ok' ELSE 'corrupt' END AS verdict
        FROM records
    """,
    "op8_exact_top_k": """
        WITH v AS (
            SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * 64)) AS e
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))
        ), scored AS (
            SELECT q.row, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
            FROM v q JOIN v c ON q.row <> c.row AND len(q.e) = len(c.e) WHERE q.vec_id % 20 = 0
        ), ranked AS (
            SELECT *, CAST(row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
        )
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
    """,
}
