"""The registered queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, decontamination, exact_dedup, language_id, license_scan, ngram_join, pii, url_filter, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(_table(spark, sf_dir, "documents"))


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], rows.schema)
    return chat.chat_digests(rows.unionByName(extra), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii(_table(spark, sf_dir, "documents").select("doc_id", "text"), key="gridloom example key")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_verdicts(_table(spark, sf_dir, "pages"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.warc_round_trip(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "ts", "capture", "position")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination_report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_id(_table(spark, sf_dir, "documents"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_ngram_jaccard_join, op2_chat_formatting, op3_pii, op4_bpe, op5_url_filter, op6_warc, op7_exact_dedup, op8_decontamination, op9_language_id, op10_license_scan)
}

_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""



def _escaped(column: str) -> str:
    """chat.escape in SQL."""
    out = f"replace({column}, '\\', '\\\\')"
    for c in chat.CONTROLS:
        out = f"replace({out}, '{c}', '{c[0]}\\{c[1:]}')"
    return out


_SPACE = r"\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
#: The words of the chat tokenizer. Of white space before a word all but the last character stands alone: a mark cuts it off.
_CHAT_WORDS = rf"""list_filter(regexp_extract_all(regexp_replace(s, '([{_SPACE}]+)([{_SPACE}][^{_SPACE}])', '\1' || chr(1) || '\2', 'g'),
  '''(?:[sdmt]|ll|ve|re)| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}\x01]+|[{_SPACE}]+|\x01'), lambda x: x <> chr(1))"""

def _license_sql() -> str:
    """The whole scan in SQL: every document's words, the same index, and every place that two anchors agree on."""
    rows = [(t, p, w, label, p in license_scan.key_places(passage.split(" "), key.split(" "))) for t, (label, passage, key) in enumerate(license_scan.TEMPLATES) for p, w in enumerate(passage.split(" "))]
    tpl = ", ".join(f"({t}, {p}, '{w}', '{label}', {must})" for t, p, w, label, must in rows)
    phrases = ", ".join(f"({len(p.split(' '))}, '{p}', '{label}')" for p, label in license_scan.BASE.items())
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
tpl AS (SELECT * FROM (VALUES {tpl}) v(t, p, w, label, must)),
phrase AS (SELECT * FROM (VALUES {phrases}) v(n, s, label)),
base AS (SELECT rid, label, i FROM (SELECT rid, w, label, n, s, unnest(range(0, len(w) - n + 1)) AS i FROM d, phrase) WHERE array_to_string(w[i + 1:i + n], ' ') = s),
wp AS (SELECT rid, i - 1 AS i, w[i] AS w FROM (SELECT rid, w, unnest(range(1, len(w) + 1)) AS i FROM d) WHERE w[i] IN (SELECT w FROM tpl)),
df AS (SELECT w, count(DISTINCT rid) AS n FROM wp GROUP BY w),
word AS (SELECT t, w, coalesce(n, 0) AS n, ln((1 + (SELECT count(*) FROM d)) / (1 + coalesce(n, 0))::DOUBLE) + 1 AS idf FROM (SELECT DISTINCT t, w FROM tpl) LEFT JOIN df USING (w)),
total AS (SELECT t, sum(idf) AS total FROM tpl JOIN word USING (t, w) GROUP BY t),
rare AS (SELECT t, w, n FROM word QUALIFY row_number() OVER (PARTITION BY t ORDER BY n, w) <= {license_scan.RARE}),
held AS (SELECT DISTINCT rid, t, wp.w, n FROM wp JOIN rare ON rare.w = wp.w),
gate AS (SELECT rid FROM held GROUP BY rid HAVING count(DISTINCT w) > 1),
anchor AS (SELECT rid, t, w FROM held WHERE rid IN (SELECT rid FROM gate) QUALIFY row_number() OVER (PARTITION BY rid, t ORDER BY n, w) <= {license_scan.ANCHORS}),
place AS (SELECT a.rid, a.t, wp.i - tpl.p AS o FROM anchor a JOIN wp ON wp.rid = a.rid AND wp.w = a.w JOIN tpl ON tpl.t = a.t AND tpl.w = a.w GROUP BY ALL HAVING count(DISTINCT a.w) > 1),
found AS (SELECT pl.rid, pl.t, any_value(label) AS label, round(sum(CASE WHEN wp.w IS NOT NULL THEN idf / total ELSE 0 END), 6) AS share, bool_and(wp.w IS NOT NULL OR NOT must) AS whole
  FROM place pl JOIN tpl ON tpl.t = pl.t JOIN word ON word.t = pl.t AND word.w = tpl.w JOIN total ON total.t = pl.t LEFT JOIN wp ON wp.rid = pl.rid AND wp.i = pl.o + tpl.p AND wp.w = tpl.w GROUP BY pl.rid, pl.t, pl.o),
lab AS (SELECT rid, string_agg(label, ',' ORDER BY label) AS labels FROM (SELECT rid, label FROM base UNION SELECT rid, label FROM found WHERE whole AND share >= {license_scan.SHARE}) GROUP BY rid),
bs AS (SELECT rid, count(*) AS n, min(i) AS a, max(i) AS z, (SELECT string_agg(x, ',' ORDER BY x) FROM unnest(list(DISTINCT label)) u(x)) AS labels FROM base GROUP BY rid),
sc AS (SELECT rid, least(1, max(share)) AS score FROM found GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(bs.n, 0)::BIGINT AS n_base, bs.a::BIGINT AS first_word, bs.z::BIGINT AS last_word, coalesce(bs.labels, '') AS base_labels, coalesce(lab.labels, '') AS labels,
  CASE WHEN bs.n > 0 THEN 1 ELSE coalesce(sc.score, 0) END::DOUBLE AS score
FROM d LEFT JOIN bs USING (rid) LEFT JOIN lab USING (rid) LEFT JOIN sc USING (rid)"""


ORACLES: dict[str, str] = {
    "op1_ngram_jaccard_join": rf"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+4], ' ') AS sh FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM pairs JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 5 * c >= 4 * (na.n + nb.n - c)),
e AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
r AS (SELECT doc_id, doc_id AS o FROM d UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.o = e.a),
c AS (SELECT doc_id, min(o) AS class_id FROM r GROUP BY doc_id),
k AS (SELECT a AS doc_id, count(*) AS n_links FROM e GROUP BY a)
SELECT c.doc_id, class_id, coalesce(n_links, 0)::BIGINT AS n_links, coalesce(n.n, 0)::BIGINT AS n_shingles FROM c LEFT JOIN k USING (doc_id) LEFT JOIN n USING (doc_id)""",
    # tokens are counted by byte-pair merging in SQL: the words of all segments, and in each step the pair of least rank
    "op2_chat_formatting": rf"""
WITH RECURSIVE c0 AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')) v),
c AS (SELECT *, row_number() OVER (ORDER BY conv_id, turn, role, text) AS rid, {_escaped("role")} AS r, {_escaped("text")} AS t FROM c0),
seg AS (SELECT DISTINCT unnest([r, t]) AS s FROM c),
cut AS (SELECT s, unnest({_CHAT_WORDS}) AS word FROM seg),
vocab AS (SELECT lower(hex(from_base64(v[1]))) AS h, v[2]::INT AS rank FROM (SELECT string_split(line, ' ') AS v FROM read_csv('{public_tokenizers.path("byte_bpe_50k.tiktoken")}', columns = {{'line': 'VARCHAR'}}, header = false, delim = chr(9), quote = '', escape = '', auto_detect = false) WHERE line <> '')),
words AS (SELECT DISTINCT word, lower(hex(encode(word))) AS h FROM cut),
bpe AS (SELECT word, regexp_extract_all(h, '..') AS ps FROM words WHERE h NOT IN (SELECT h FROM vocab)
  UNION ALL SELECT word, list_concat(list_append(ps[:best.j - 1], ps[best.j] || ps[best.j + 1]), ps[best.j + 2:]) FROM (
    SELECT b.word, b.ps, min({{'rank': v.rank, 'j': j.j}}) AS best FROM bpe b, unnest(range(1, len(b.ps))) j(j) JOIN vocab v ON v.h = b.ps[j.j] || b.ps[j.j + 1] GROUP BY ALL)),
sizes AS (SELECT w.word, coalesce(min(len(ps)), 1) AS n FROM words w LEFT JOIN bpe USING (word) GROUP BY w.word),
counts AS (SELECT seg.s, coalesce(sum(n), 0)::BIGINT AS n FROM seg LEFT JOIN cut USING (s) LEFT JOIN sizes USING (word) GROUP BY seg.s),
k AS (SELECT c.*, kr.n AS nr, kt.n AS nt, 1 + coalesce(sum(3 + kr.n + kt.n) OVER (PARTITION BY conv_id ORDER BY rid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 2 + kr.n AS pos
  FROM c JOIN counts kr ON kr.s = r JOIN counts kt ON kt.s = t),
a AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY rid) AS said,
  coalesce(string_agg(text, '' ORDER BY rid) FILTER (role = 'assistant'), '') AS loss,
  3 + sum(20 + length(r) + length(t)) AS chars, 1 + sum(3 + nr + nt) AS n_tokens, coalesce(sum(nt) FILTER (role = 'assistant'), 0) AS loss_tokens,
  coalesce(string_agg(pos::BIGINT || '-' || (pos + nt)::BIGINT || ';', '' ORDER BY rid) FILTER (role = 'assistant' AND nt > 0), '') AS mask FROM k GROUP BY conv_id)
SELECT conv_id::BIGINT AS conv_id, n_turns, sha256(said) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, chars::BIGINT AS formatted_chars,
  n_tokens::BIGINT AS n_tokens, loss_tokens::BIGINT AS loss_tokens, sha256(mask) AS mask_sha256 FROM a""",
    "op6_warc": r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h, replace(replace(replace(replace(coalesce(url, ''), chr(9), '%09'), chr(10), '%0A'), chr(13), '%0D'), ' ', '%20') AS url,
  strftime(TIMESTAMP '2024-01-01' + to_seconds(coalesce(page_id, 0)), '%Y-%m-%dT%H:%M:%SZ') AS ts FROM pages),
k AS (SELECT *, lower(url) AS lo, regexp_extract(lower(url), '(?s)^.*?://([^/?#]*)', 1) AS host FROM p),
u AS (SELECT *, CASE WHEN host = '' THEN lo ELSE array_to_string(list_reverse(string_split(host, '.')), ',') || ')' || regexp_extract(lo, '(?s)^.*?://[^/?#]*(.*)$', 1) END AS url_key FROM k),
g AS (SELECT h, max(page_id) AS top FROM p WHERE strlen(h) >= 1000 GROUP BY h)
SELECT u.page_id, strlen(u.h)::BIGINT AS payload_bytes, sha1(u.h) AS payload_digest,
  CASE WHEN g.top IS NULL OR g.top = u.page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN g.top <> u.page_id THEN g.top END AS refers_to, url_key, ts,
  row_number() OVER (PARTITION BY url_key ORDER BY ts, u.page_id NULLS FIRST) - 1 AS capture, row_number() OVER (ORDER BY url_key, ts, u.page_id NULLS FIRST) - 1 AS position
FROM u LEFT JOIN g ON u.h = g.h""",
    "op7_exact_dedup": r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS c, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t FROM documents),
g AS (SELECT *, count(*) OVER (PARTITION BY t) AS group_size, first_value(doc_id) OVER (PARTITION BY t ORDER BY c DESC, doc_id) AS keep_id FROM d)
SELECT doc_id, keep_id, group_size::BIGINT AS group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM g""",
    "op8_decontamination": rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, len(w[i:i+9]) AS n, array_to_string(w[i:i+9], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
places AS (SELECT doc_id, n, i, array_to_string(w[i:i+n-1], ' ') AS s FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes)),
occ AS (SELECT q.doc_id, q.i, q.n, win.item_id FROM places q JOIN win ON q.n = win.n AND q.s = win.s),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM occ) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS k FROM occ) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)""",
    "op10_license_scan": _license_sql(),
}
