"""The registered queries of this subpackage, and their SQL for DuckDB where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wayleave.llm.chat import CONTROL, END, START, chat_digests
from wayleave.llm.collocations import collocations
from wayleave.llm.decontaminate import decontaminate
from wayleave.llm.exact_dedup import exact_dedup
from wayleave.llm.html_text import extract
from wayleave.llm.licenses import license_scan
from wayleave.llm.merkle import lower_cased, merkle_manifest, one_in_five
from wayleave.llm.mixing import mix_sources
from wayleave.llm.near_dedup import near_duplicates
from wayleave.llm.pii import personal_data
from wayleave.llm.quality import quality_scores
from wayleave.llm.shared import table
from wayleave.llm.substring_dedup import substring_dedup
from wayleave.llm.warc import round_trip


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-7, 0, "user", tricky), (-7, 1, "assistant", tricky)], "conv_id long, turn long, role string, text string")
    return chat_digests(turns.unionByName(own)).drop("n_chunks")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "pages")).drop("payload", "url")


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=4, percent=80).drop("row_hash")


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("row_hash")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"), least=100, longest=5, top=2000)


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"), window=20)


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_manifest(table(spark, sf_dir, "documents"), tampered=lower_cased(one_in_five()))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat_format": op1_chat_format,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_pii": op3_pii,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_mixing": op5_mixing,
    "op6_warc": op6_warc,
    "op7_near_dedup": op7_near_dedup,
    "op8_html_extraction": op8_html_extraction,
    "op9_license_scan": op9_license_scan,
    "op10_decontamination": op10_decontamination,
    "op11_collocations": op11_collocations,
    "op12_substring_dedup": op12_substring_dedup,
    "op13_merkle_manifest": op13_merkle_manifest,
}

def _escaped(c: str, role: bool = False) -> str:
    """The text's escaping in SQL."""
    out = f"replace({c}, '\\', '\\\\')"
    if role:
        out = f"replace({out}, chr(10), '\\' || chr(10))"
    for control in CONTROL:
        out = f"replace({out}, '{control}', '{control[0]}\\{control[1:]}')"
    return out


LOWER_AZ = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ALNUM_WORDS = rf"regexp_extract_all({LOWER_AZ}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: Unsigned crc32 of the decimal doc_id, bit by bit.
CRC = """xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
  lambda acc, b: list_reduce(list_prepend(xor(acc, b), range(8)), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, CAST(3988292384 AS BIGINT)) ELSE x >> 1 END)))"""


def _leaf(text: str) -> str:
    values = [f"CAST({c} AS VARCHAR)" for c in ("doc_id", "source", "lang", "n_chars", text)]
    return "sha256(" + " || ".join(f"CASE WHEN {v} IS NULL THEN '-' ELSE strlen({v}) || ':' || {v} END" for v in values) + ")"


ORACLE_SQL: dict[str, str] = {
    "op2_exact_dedup": r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t)
""",
    "op1_chat_format": rf"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS LAST, role, text) AS said,
  coalesce(string_agg(text, '' ORDER BY turn NULLS LAST, role, text) FILTER (role = 'assistant'), '') AS loss,
  sum(length('{START}') + length({_escaped("role", True)}) + 1 + length({_escaped("text")}) + length('{END}') + 1) AS formatted_chars FROM t GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, CAST(formatted_chars AS BIGINT) AS formatted_chars FROM g
""",
    "op6_warc": r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) || '0' AS h, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS last FROM pages)
SELECT page_id, strlen(html) AS payload_bytes,
  list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((16*(instr('0123456789abcdef', substr(h, CAST(5*i//4 + 1 AS BIGINT), 1)) - 1) + instr('0123456789abcdef', substr(h, CAST(5*i//4 + 2 AS BIGINT), 1)) - 1) >> CAST(3 - (5*i)%4 AS INTEGER)) & 31 AS BIGINT) + 1, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to
FROM p
""",
    "op7_near_dedup": rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({LOWER_AZ}, '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')] ELSE list_distinct(list_transform(range(1, len(ws)-2), lambda i: array_to_string(ws[i:i+3], ' '))) END AS sh FROM w),
x AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS h FROM s),
e AS (SELECT a.doc_id AS u, b.doc_id AS v FROM x a JOIN x b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100*count(*) >= 80*(a.n + b.n - count(*))),
sym AS (SELECT u, v FROM e UNION ALL SELECT v, u FROM e),
r AS (SELECT doc_id, doc_id AS x FROM documents UNION SELECT r.doc_id, sym.v FROM r JOIN sym ON sym.u = r.x)
SELECT s.doc_id, len(sh) AS n_shingles, c.component_id, c.component_id = s.doc_id AS kept FROM s JOIN (SELECT doc_id, min(x) AS component_id FROM r GROUP BY doc_id) c USING (doc_id)
""",
    "op10_decontamination": rf"""
WITH d AS (SELECT doc_id, {ALNUM_WORDS} AS ws FROM documents),
i AS (SELECT item_id, {ALNUM_WORDS} AS ws FROM benchmark),
iw AS (SELECT DISTINCT item_id, n, array_to_string(ws[s:s+n-1], ' ') AS k FROM (SELECT item_id, ws, least(13, len(ws)) AS n, unnest(range(1, len(ws) - least(13, len(ws)) + 2)) AS s FROM i WHERE len(ws) > 0)),
dw AS (SELECT doc_id, n, s, array_to_string(ws[s:s+n-1], ' ') AS k FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM iw) WHERE len(ws) >= n)),
m AS (SELECT doc_id, item_id, s, dw.n FROM dw JOIN iw ON dw.n = iw.n AND dw.k = iw.k),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM m) GROUP BY doc_id),
named AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS l FROM m GROUP BY doc_id)
SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(l, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20*coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
""",
    "op11_collocations": rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({LOWER_AZ}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
n AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM w GROUP BY lang),
g AS (SELECT lang, k, x, count(*) AS f FROM (SELECT lang, k, ws[s:s+k-1] AS x FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS s FROM w, (SELECT unnest(range(1, 6)) AS k) WHERE len(ws) >= k)) GROUP BY ALL),
c AS (SELECT *, array_to_string(x, ' ') AS phrase FROM g WHERE k >= 2 AND f >= 100),
t AS (SELECT c.lang AS lang, phrase, c.f AS a, n.n AS n, j, l.f AS l, r.f AS r, CAST(1000*CAST(c.f AS HUGEINT)*n.n // (CAST(l.f AS HUGEINT)*r.f) AS BIGINT) AS score
  FROM (SELECT *, unnest(range(1, k)) AS j FROM c) AS c JOIN n ON n.lang = c.lang JOIN g AS l ON l.lang = c.lang AND l.x = c.x[:j] JOIN g AS r ON r.lang = c.lang AND r.x = c.x[j+1:]),
b AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
s AS (SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.lang = b.lang AND len(c.phrase) > len(b.phrase) AND contains(' ' || c.phrase || ' ', ' ' || b.phrase || ' ') AND 100*c.f >= 100*b.a))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM s QUALIFY rank <= 2000
""",
    "op12_substring_dedup": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
k AS (SELECT doc_id, s, array_to_string(ws[s:s+19], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS s FROM d WHERE len(ws) >= 20)),
w AS (SELECT doc_id, s FROM k QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, s) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS p FROM w),
stay AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t FROM (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM d) ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, len(ws) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id) USING (doc_id) LEFT JOIN stay USING (doc_id)
""",
    "op13_merkle_manifest": rf"""
WITH RECURSIVE d AS (SELECT doc_id, CASE WHEN source IS NULL THEN '-' ELSE '=' || source END AS g, {_leaf("text")} AS leaf,
  CASE WHEN {CRC} % 5 = 0 THEN {_leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} ELSE {_leaf("text")} END AS changed FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM d),
t AS (SELECT g, 0 AS v, i, n, leaf AS h FROM r UNION ALL SELECT g, v + 1, i // 16, (n + 15) // 16, sha256(string_agg(h, '' ORDER BY i)) FROM t WHERE n > 1 GROUP BY g, v, n, i // 16),
tops AS (SELECT g, h, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n FROM t WHERE n = 1),
u AS (SELECT 0 AS v, i, n, h FROM tops UNION ALL SELECT v + 1, i // 16, (n + 15) // 16, sha256(string_agg(h, '' ORDER BY i)) FROM u WHERE n > 1 GROUP BY v, n, i // 16),
tw AS (SELECT g, v, i, n, coalesce(string_agg(h, '') OVER (PARTITION BY g, v, i // 16 ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
  coalesce(string_agg(h, '') OVER (PARTITION BY g, v, i // 16 ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS behind FROM t),
uw AS (SELECT v, i, n, coalesce(string_agg(h, '') OVER (PARTITION BY v, i // 16 ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
  coalesce(string_agg(h, '') OVER (PARTITION BY v, i // 16 ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS behind FROM u),
f AS (SELECT doc_id, leaf, g, i AS place, 0 AS v, i, n, changed AS h, '' AS proof FROM r
  UNION ALL SELECT doc_id, leaf, f.g, place, f.v + 1, f.i // 16, (f.n + 15) // 16, sha256(before || h || behind), proof || before || behind FROM f JOIN tw ON f.g = tw.g AND f.v = tw.v AND f.i = tw.i WHERE f.n > 1),
e AS (SELECT doc_id, leaf, f.g, place, tops.h AS subroot, 0 AS v, tops.i, tops.n, f.h, proof FROM f JOIN tops USING (g) WHERE f.n = 1
  UNION ALL SELECT doc_id, leaf, g, place, subroot, e.v + 1, e.i // 16, (e.n + 15) // 16, sha256(before || h || behind), proof || before || behind FROM e JOIN uw ON e.v = uw.v AND e.i = uw.i WHERE e.n > 1)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, e.h AS folded_root, e.h = root AS verified FROM e, (SELECT h AS root FROM u WHERE n = 1) WHERE e.n = 1
""",
}
