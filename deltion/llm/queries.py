"""The registered queries `opN_<name>` and the SQL they are compared with."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deltion.llm import bpe, centroids, decontaminate, host_quality, language, manifest, mixture, simhash, suffix_dedup, token_counts, toxicity, url_filter, warc
from deltion.llm.shared import settle, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


@query
def op1_warc_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a WARC record in Zstandard archives, read back with all checks."""
    pages = warc.with_record_types(table(spark, sf_dir, "pages"))
    archives = settle(warc.write_archives(pages), "archives")
    records = warc.read_archives(archives, payload=False)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "error")


SQL["op1_warc_zstd"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
h AS (SELECT page_id, strlen(body)::BIGINT AS payload_bytes, sha1(body) AS hex FROM p),
f AS (SELECT hex, min(page_id) AS first_id FROM h GROUP BY hex)
SELECT page_id, payload_bytes,
    array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(hex, (1 + 5 * (i // 4))::INT, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INT, 1)), '') AS payload_digest,
    CASE WHEN page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN page_id > first_id THEN first_id END AS refers_to, NULL::VARCHAR AS error
FROM h JOIN f USING (hex)
"""

RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


@query
def op2_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict of the rules on every page's url."""
    rules = spark.createDataFrame(RULES, "verdict string, host string, path string")
    return url_filter.apply_rules(table(spark, sf_dir, "pages"), rules)


SQL["op2_url_rules"] = """
WITH r(verdict, h, p) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
a AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
n AS (SELECT row_number() OVER () AS row_id, * FROM b),
m AS (SELECT row_id, arg_max(struct_pack(rule := h || p, verdict := verdict), length(h || p)) AS best
    FROM n JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY row_id)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.verdict, 'allow') AS verdict FROM n LEFT JOIN m USING (row_id)
"""


@query
def op3_simhash_gray(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash of three-word shingles of every document, and the group that links of two bits make."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, distance=2)


@query
def op4_token_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Histogram of the encoded lengths of all documents, with its suffix sums."""
    histogram = token_counts.length_histogram(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return token_counts.suffix_sums(settle(histogram, "lengths"))


@query
def op5_benchmark_lsa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, near exactly or paraphrased with its answer."""
    return decontaminate.find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op6_host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base rules and host verdicts (the source is the host) for every document."""
    return host_quality.judge(table(spark, sf_dir, "documents"))


SQL["op6_host_quality"] = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT r, unnest(range(1, len(ws) - 1)) AS i, unnest(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || chr(1) || ws[i + 1] || chr(1) || ws[i + 2])) AS gram FROM w WHERE len(ws) > 2),
c AS (SELECT r, i, count(*) OVER (PARTITION BY r, gram) AS n FROM g),
p AS (SELECT r, count(DISTINCT i + k) AS n FROM c, (VALUES (0), (1), (2)) AS o(k) WHERE n > 1 GROUP BY r),
a AS (SELECT r, doc_id, source, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(p.n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN p USING (r)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM a),
h AS (SELECT source, count(*) AS n, count(*) FILTER (WHERE base_failed) AS f FROM b GROUP BY source),
m AS (SELECT sum(f) / sum(n) AS mean, sum(f * f / n) / sum(n) - (sum(f) / sum(n)) ** 2 - sum(f) / sum(n) * (1 - sum(f) / sum(n)) * count(*) / sum(n) AS var FROM h),
x AS (SELECT mean, CASE WHEN var > 0 THEN least(greatest(mean * (1 - mean) / var - 1, 1), 1e6) ELSE 1e6 END AS weight FROM m),
v AS (SELECT source AS host, n AS host_docs, f AS host_failures, round((f + mean * weight) / (n + weight), 6) AS host_rate FROM h, x)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND host_rate <= 0.5 AS kept, host, host_docs, host_failures, host_rate
FROM b JOIN v ON b.source IS NOT DISTINCT FROM v.host
"""


@query
def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document loses to runs of 100 bytes that also start earlier."""
    docs = table(spark, sf_dir, "documents")
    return suffix_dedup.removal_report(docs, suffix_dedup.repeated_spans(docs, length=100))


@query
def op8_toxic_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every whole text, learned from the labels that are not held out."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score_documents(docs, model)


@query
def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole text, learned from the documents that are not held out."""
    docs = table(spark, sf_dir, "documents")
    return language.predict(docs, language.fit(docs))


@query
def op10_bpe_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of `documents` encoded by word-end BPE and decoded again."""
    return bpe.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op11_sainte_lague(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of every document the mix of sources by the weights 5, 2, 1 takes."""
    mixed = mixture.mix(table(spark, sf_dir, "documents"), weights=[5, 2, 1])
    return mixed.select("doc_id", "source", "size", "source_size", "target", "taken")


SQL["op11_sainte_lague"] = r"""
WITH d AS (SELECT doc_id, source, md5(text) AS digest, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
c AS (SELECT *, row_number() OVER (PARTITION BY doc_id, source, digest, size) - 1 AS copy FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS sid FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][(sid % 3 + 1)::INT] AS weight, 3 * source_size AS most FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY most / weight, sid) AS i FROM w),
l AS (SELECT max((all_ - stopped) / open) AS level FROM (
    SELECT (SELECT sum(source_size) FROM o)::DOUBLE AS all_, coalesce((SELECT sum(most) FROM o AS b WHERE b.i < a.i), 0)::DOUBLE AS stopped, (SELECT sum(weight) FROM o AS b WHERE b.i >= a.i)::DOUBLE AS open FROM o AS a)),
t AS (SELECT w.*, least(most::DOUBLE, weight * level) AS target FROM w, l),
q AS (SELECT sid, target, unnest(range((target / nullif((SELECT sum(target) FROM t), 0) * n)::BIGINT + (SELECT count(*) FROM t) + 1)) AS k, n FROM t, (SELECT floor(sum(source_size) / 32.0 + 0.5)::BIGINT AS n FROM t)),
q1 AS (SELECT sid, count(*) AS quota FROM (SELECT sid, n, row_number() OVER (ORDER BY target / (2 * k + 1) DESC, sid) AS place FROM q WHERE target > 0) WHERE place <= n GROUP BY sid),
p AS (SELECT c.*, sid, source_size, target, copy // greatest(1, 16384 // greatest(size, 1)) AS piece FROM c JOIN t ON c.source IS NOT DISTINCT FROM t.source),
u AS (SELECT *, md5(concat_ws(':', 'mix', coalesce(doc_id::VARCHAR, '-'), sid, coalesce(digest, '-'), piece)) AS place FROM p),
v AS (SELECT *, ('0x' || substr(place, 1, 12))::BIGINT % greatest(1, (source_size + 65535) // 65536) AS shard FROM u),
h AS (SELECT sid, shard // 1024 AS section, shard, sum(size)::BIGINT AS words, greatest(1, (2 * sum(size) + 32) // 64)::BIGINT AS blocks FROM v WHERE size > 0 GROUP BY ALL),
e AS (SELECT sid, section, sum(words) AS words FROM h GROUP BY ALL),
eq AS (SELECT e.*, quota, unnest(range((words / sum(words) OVER (PARTITION BY sid) * quota)::BIGINT + count(*) OVER (PARTITION BY sid) + 1)) AS k FROM e JOIN q1 USING (sid)),
e1 AS (SELECT sid, section, count(*) AS quota FROM (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY words / (2 * k + 1) DESC, section) AS place FROM eq) WHERE place <= quota GROUP BY ALL),
hq AS (SELECT h.*, quota, unnest(range((words / sum(words) OVER (PARTITION BY sid, section) * quota)::BIGINT + count(*) OVER (PARTITION BY sid, section) + 1)) AS k FROM h JOIN e1 USING (sid, section)),
h1 AS (SELECT sid, shard, least(count(*) FILTER (WHERE place <= quota), 3 * any_value(blocks)) AS quota FROM (SELECT *, row_number() OVER (PARTITION BY sid, section ORDER BY words / (2 * k + 1) DESC, shard) AS place FROM hq) GROUP BY ALL),
b AS (SELECT *, md5(concat_ws(':', 'mix', sid, shard, j)) AS hash FROM (SELECT sid, shard, words, blocks, coalesce(quota, 0) AS quota, unnest(range(blocks)) AS j FROM h LEFT JOIN h1 USING (sid, shard))),
b1 AS (SELECT sid, shard, j, j * words // blocks AS low, (j + 1) * words // blocks AS high, quota // blocks + CASE WHEN row_number() OVER (PARTITION BY sid, shard ORDER BY hash) <= quota % blocks THEN 1 ELSE 0 END AS times FROM b),
x AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY sid, shard ORDER BY place, doc_id, piece, copy ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM v WHERE size > 0),
y AS (SELECT x.doc_id, x.sid, x.digest, x.copy, sum((least(start + size, high) - greatest(start, low)) * times)::BIGINT AS taken FROM x JOIN b1 ON x.sid = b1.sid AND x.shard = b1.shard AND low < start + size AND high > start GROUP BY ALL)
SELECT v.doc_id, v.source, v.size, v.source_size, v.target, coalesce(taken, 0)::BIGINT AS taken
FROM v LEFT JOIN y ON v.sid = y.sid AND v.doc_id IS NOT DISTINCT FROM y.doc_id AND v.digest IS NOT DISTINCT FROM y.digest AND v.copy = y.copy
"""


@query
def op12_ns_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Integer k-means of all vectors of 64 components: 40 centroids, 5 rounds and a last assignment."""
    state, history, _ = centroids.cluster(table(spark, sf_dir, "embeddings"), k=40, rounds=5, dims=64, scale=256, seed="2")
    return centroids.report(state, history[-1])


def kmeans_sql(k: int, rounds: int, dims: int) -> str:
    """Every vector against every centroid in every round."""
    steps = [f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
    WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || coalesce(vec_id::VARCHAR, '')), v) - 1 AS c, v AS m FROM v QUALIFY c < {k})"""]
    for t in range(rounds + 1):
        steps.append(f"""a{t} AS MATERIALIZED (SELECT r, min(struct_pack(d := list_sum(list_transform(list_zip(v, m), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT, c := c)) AS best FROM v, c{t} GROUP BY r)""")
        if t < rounds:
            steps.append(f"""n{t} AS (SELECT best.c AS c, i, floor(sum(v[i])::DOUBLE / count(*))::BIGINT AS x FROM (SELECT r, v, unnest(range(1, {dims + 1})) AS i FROM v) JOIN a{t} USING (r) GROUP BY ALL),
c{t + 1} AS MATERIALIZED (SELECT c{t}.c AS c, coalesce(any_value(f.m), any_value(c{t}.m)) AS m FROM c{t} LEFT JOIN (SELECT c, list(x ORDER BY i) AS m FROM n{t} GROUP BY c) AS f ON f.c = c{t}.c GROUP BY ALL)""")
    return ",\n".join(steps) + f"""
SELECT vec_id, best.c::INT AS cluster, best.d AS distance, (sum(best.d) OVER (PARTITION BY best.c))::BIGINT AS cluster_inertia, (sum(best.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(m, ',')) AS centroid_sha256
FROM v JOIN a{rounds} USING (r) JOIN c{rounds} ON best.c = c{rounds}.c
"""


SQL["op12_ns_bounds"] = kmeans_sql(40, 5, 64)


@query
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots, proof and its check for every document; the texts of a fifth of them are lower-cased to see it fail."""
    out = manifest.manifest(
        table(spark, sf_dir, "documents"), ["doc_id", "source", "lang", "n_chars", "text"], tampered=manifest.lower_ascii, tamper_where=F.crc32(F.col("doc_id").cast("string")) % 5 == 0,
    )
    return out.select("doc_id", "source", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def merkle_sql(levels: int) -> str:
    """The tree of each source and the tree over them, for up to 16 ** levels rows of a source and sources."""
    sha = "sha256({})"
    field = lambda c: f"coalesce(strlen(({c})::VARCHAR) || ':' || ({c})::VARCHAR, '-')"
    leaf = lambda text: sha.format(" || ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars", text)))
    bits = "list_reduce(list_prepend(xor(crc, byte), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))"
    crc = f"xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda crc, byte: {bits}), 4294967295)"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    steps = [f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, {leaf("text")} AS h, CASE WHEN {crc} % 5 = 0 THEN {leaf(lower)} ELSE {leaf("text")} END AS t FROM documents),
t0 AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, h) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM d),
n0 AS (SELECT source, pos, n, h FROM t0)"""]

    def climb(name: str, key: str, k: int) -> str:
        return f"""{name}{k + 1} AS MATERIALIZED (SELECT {key}, pos // 16 AS pos, (any_value(n) + 15) // 16 AS n, CASE WHEN any_value(n) > 1 THEN sha256(string_agg(h, '' ORDER BY pos)) ELSE any_value(h) END AS h FROM {name}{k} GROUP BY {key}, pos // 16)"""

    steps += [climb("n", "source", k) for k in range(levels)]
    steps.append(f"s0 AS (SELECT 0 AS tree, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS n, h, source FROM n{levels})")
    steps += [climb("s", "tree", k) for k in range(levels)]

    def walk(before: str, nodes: str, k: int, same: str, name: str, at: str) -> str:
        side = lambda op: f"(SELECT coalesce(string_agg(h, '' ORDER BY o.pos), '') FROM {nodes}{k} AS o WHERE {same} AND o.pos // 16 = ({at} // {16 ** k}) // 16 AND o.pos {op} {at} // {16 ** k})"
        alone = f"(SELECT any_value(n) FROM {nodes}{k} AS o WHERE {same}) = 1"
        return f"""{name}{k + 1} AS MATERIALIZED (SELECT p.* EXCLUDE (l, g, alone) REPLACE (CASE WHEN alone THEN f ELSE sha256(l || f || g) END AS f, proof || l || g AS proof) FROM (SELECT *, {side('<')} AS l, {side('>')} AS g, {alone} AS alone FROM {before} AS p) AS p)"""

    steps.append("w0 AS (SELECT r, doc_id, t0.source, t0.h AS leaf, t0.pos, t AS f, '' AS proof, s0.pos AS place FROM t0 JOIN s0 ON t0.source IS NOT DISTINCT FROM s0.source)")
    steps += [walk(f"w{k}", "n", k, "o.source IS NOT DISTINCT FROM p.source", "w", "p.pos") for k in range(levels)]
    steps.append(f"x0 AS (SELECT * FROM w{levels})")
    steps += [walk(f"x{k}", "s", k, "true", "x", "p.place") for k in range(levels)]
    return ",\n".join(steps) + f"""
SELECT doc_id, x.source, leaf, s.h AS subroot, e.h AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = e.h AS verified
FROM x{levels} AS x JOIN s0 AS s ON x.source IS NOT DISTINCT FROM s.source, s{levels} AS e
"""


SQL["op13_merkle_manifest"] = merkle_sql(4)
