"""The queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

import string
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthline.llm import conversations, decontaminate, langid, licenses, neighbours, simhash, spotsigs, substring_dedup, suffix_dedup, urlfilter, whitening
from hearthline.llm.common import table
from hearthline.llm.packing import pack_documents
from hearthline.llm.tokens import count_tokens

TOKENIZER = "byte_bpe_50k.json"

# Verdict, host and path of the hand-written URL rules.
URL_RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]


def op1_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.edited_likeness(table(spark, sf_dir, "documents"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(suffix_dedup.remove_repeats(table(spark, sf_dir, "documents")))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    learned = langid.dictionaries(docs.filter(~langid.in_fold("doc_id")))
    return langid.identify(docs, learned).withColumn("held_out", langid.in_fold("doc_id"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(simhash.near_duplicates(table(spark, sf_dir, "documents")))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digest(substring_dedup.remove_repeats(table(spark, sf_dir, "documents")))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).withColumn("templates", F.array_join(F.col("templates").cast("array<string>"), ","))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(table(spark, sf_dir, "embeddings"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.digest(conversations.prefix_trie(table(spark, sf_dir, "conversations")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_spotsigs": op1_spotsigs,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_language_id": op3_language_id,
    "op4_token_counts": op4_token_counts,
    "op5_url_filter": op5_url_filter,
    "op6_packing": op6_packing,
    "op7_simhash": op7_simhash,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_license_scan": op9_license_scan,
    "op10_decontamination": op10_decontamination,
    "op11_whitening": op11_whitening,
    "op12_nearest_neighbours": op12_nearest_neighbours,
    "op13_prefix_trie": op13_prefix_trie,
}

UPPER, LOWER = string.ascii_uppercase, string.ascii_lowercase
ALNUM = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

# Strings by their digests; a window starts at each byte, in hexadecimal at each second digit. Texts are cut
# into overlapping pieces first, since a place far into a string is slow to reach.
OP2_SQL = """WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
q AS (SELECT r, 500 * j AS base, substr(h, 1000 * j + 1, 1798) AS part FROM d, unnest(range(CAST((length(h) // 2 - 400) // 500 + 1 AS BIGINT))) AS u(j) WHERE length(h) >= 800),
w AS (SELECT r, base + k AS k, md5(substr(part, 2 * k + 1, 800)) AS g FROM q, unnest(range(CAST(length(part) // 2 - 399 AS BIGINT))) AS u(k)),
t AS (SELECT g FROM w GROUP BY g HAVING count(*) > 1), s AS (SELECT r, k FROM w SEMI JOIN t USING (g)),
i AS (SELECT r, k, sum(fresh) OVER (PARTITION BY r ORDER BY k) AS island FROM (SELECT r, k, CASE WHEN k > lag(k) OVER (PARTITION BY r ORDER BY k) + 400 THEN 1 ELSE 0 END AS fresh FROM s)),
c AS (SELECT r, min(k) AS first, max(k) + 400 AS last FROM i GROUP BY r, island),
e AS (SELECT r, first, last, lag(last, 1, 0) OVER (PARTITION BY r ORDER BY first) AS before FROM c),
p AS (SELECT r, sum(last - first) AS n_removed, count(*) AS n_spans, max(last) AS tail, string_agg(substr(h, 2 * before + 1, 2 * (first - before)), '' ORDER BY first) AS kept FROM e JOIN d USING (r) GROUP BY r)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
sha256(unhex(CASE WHEN kept IS NULL THEN h ELSE concat(kept, substr(h, 2 * tail + 1)) END)) AS kept_sha256 FROM d LEFT JOIN p USING (r)"""

OP8_SQL = """WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
g AS (SELECT r, k, array_to_string(w[k:k + 34], ' ') AS g FROM d, unnest(range(1, CAST(len(w) - 33 AS BIGINT))) AS u(k) WHERE len(w) >= 35),
t AS (SELECT g FROM g GROUP BY g HAVING count(*) > 1), c AS (SELECT DISTINCT r, p FROM (SELECT r, unnest(range(k, k + 35)) AS p FROM g SEMI JOIN t USING (g))),
x AS (SELECT r, unnest(w) AS word, unnest(range(1, CAST(len(w) + 1 AS BIGINT))) AS p FROM d SEMI JOIN c USING (r)),
kept AS (SELECT r, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS words FROM x ANTI JOIN c USING (r, p) GROUP BY r), hit AS (SELECT r, count(*) AS n FROM c GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(hit.n, 0) AS n_removed, sha256(CASE WHEN hit.r IS NULL THEN array_to_string(w, ' ') ELSE coalesce(words, '') END) AS kept_sha256 FROM d LEFT JOIN hit USING (r) LEFT JOIN kept USING (r)"""

OP10_SQL = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {ALNUM} AS w FROM documents), b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {ALNUM} AS w FROM benchmark),
i AS (SELECT item_id, least(10, len(w)) AS n, array_to_string(w[k:k + least(10, len(w)) - 1], ' ') AS g FROM b, unnest(range(1, CAST(len(w) - least(10, len(w)) + 2 AS BIGINT))) AS u(k) WHERE len(w) > 0),
m AS (SELECT DISTINCT n FROM i), g AS (SELECT r, k, n, array_to_string(w[k:k + n - 1], ' ') AS g FROM d, m, unnest(range(1, CAST(len(w) - n + 2 AS BIGINT))) AS u(k) WHERE len(w) >= n),
h AS (SELECT r, k, n, item_id FROM g JOIN i USING (n, g)), c AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(k, k + n)) AS p FROM h) GROUP BY r),
f AS (SELECT r, list_sort(list(DISTINCT item_id) FILTER (item_id IS NOT NULL)) AS items FROM h GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, CAST(coalesce(len(items), 0) AS BIGINT) AS n_items, sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, c.r IS NOT NULL AS contaminated FROM d LEFT JOIN c USING (r) LEFT JOIN f USING (r)"""

# A node is the list of its turns' digests. CRC-32 runs over the bits of each digit of the id.
OP13_SQL = """WITH o AS (SELECT conv_id AS c, md5(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))) AS g, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS w,
row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, '')) AS p FROM conversations WHERE conv_id IS NOT NULL),
l AS (SELECT c, list({'g': g, 'w': w} ORDER BY p) AS ts FROM o GROUP BY c),
h AS (SELECT c, ts, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(range(1, length(CAST(c AS VARCHAR)) + 1), lambda i: [CAST(ascii(substr(CAST(c AS VARCHAR), i, 1)) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, (a & 1) * 3988292384) END), 4294967295) % 4 AS h FROM l),
r AS (SELECT h.c, list_concat(coalesce(s.ts, [])[1:CAST(h.h AS BIGINT)], h.ts[CAST(h.h AS BIGINT) + 1:]) AS ts FROM h LEFT JOIN l AS s ON s.c = h.c - h.c % 20),
m AS (SELECT c, d, list_transform(ts[1:d], lambda x: x.g) AS k, coalesce(ts[d].w, 0) AS w, d = len(ts) AS ends FROM r, unnest(range(CAST(len(ts) + 1 AS BIGINT))) AS u(d)),
n AS (SELECT k, d, min(c) AS c, count(*) AS n, max(w) AS w, coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (ends), '') AS e FROM m GROUP BY k, d),
f AS (SELECT k[1:d - 1] AS k, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1),
x AS (SELECT n.*, coalesce(f.n_children, 0) AS n_children FROM n LEFT JOIN f USING (k)),
t AS (SELECT k[1:a] AS k, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((n - 1) * w) AS saved FROM x, unnest(range(CAST(d + 1 AS BIGINT))) AS u(a) GROUP BY 1)
SELECT x.c AS conv_id, x.d AS depth, q.c AS parent_conv_id, x.n AS n_convs, x.n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(x.e) AS ends_sha256 FROM x JOIN t USING (k) LEFT JOIN n AS q ON x.d > 0 AND q.k = x.k[1:x.d - 1]"""

#: The other operators hash, compress, mine or tokenise, which SQL cannot express.
ORACLE_SQL: dict[str, str] = {"op2_suffix_dedup": OP2_SQL, "op8_substring_dedup": OP8_SQL, "op10_decontamination": OP10_SQL, "op13_prefix_trie": OP13_SQL}
