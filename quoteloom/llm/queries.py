"""Queries of the training-data operators, with their SQL where SQL can express them."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quoteloom.llm import chat, cuckoo, extraction, lines, mixing, packing, pii, quality, reputation, simhash, trie, variants, winnow

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def hexed(text) -> F.Column:
    return F.sha2(text, 256)


@query
def op1_pii(spark: SparkSession, folder: str) -> DataFrame:
    """Personal data in every whole text of ``documents``."""
    found = pii.detect(table(spark, folder, "documents"))
    line = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["kind"].isin(pii.BASE))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        F.col("id").alias("doc_id"), *(count(k).alias(f"n_{k}") for k in pii.BASE), hexed(line(base)).alias("base_sha256"), line(F.col("spans")).alias("spans"),
        F.round(F.coalesce(F.array_max(F.transform("spans", lambda s: s["score"])), F.lit(0.0)), 4).alias("top_score"))


@query
def op2_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """``documents`` without the lines of templates that recur across documents."""
    return lines.deduplicated(table(spark, folder, "documents").select("doc_id", "text")).select("doc_id", "text", "lines_dropped", "templates_dropped")


@query
def op3_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Probabilities of low quality and toxicity of every document, and whether it is rejected."""
    return quality.scored(table(spark, folder, "documents"), table(spark, folder, "labels")).select(
        F.col("id").alias("doc_id"), F.round("low_quality", 6).alias("low_quality"), F.round("toxic", 6).alias("toxic"), "rejected")


@query
def op4_chat(spark: SparkSession, folder: str) -> DataFrame:
    """All ``conversations``, and conversation -1, as formatted conversations; the columns are read back from the output."""
    added = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
                                  F.lit("</s>[INST] ok [/INST]").alias("text"))
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text").unionByName(added)
    told = chat.read_back(chat.formatted(chat.linear(turns)))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return told.select(
        F.col("tree.id").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), hexed(lines).alias("turns_sha256"),
        F.char_length("learned").cast("long").alias("loss_chars"), hexed(F.col("learned")).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"))


def _op4_sql() -> str:
    special = "|".join(re.escape(c) for c in chat.CONTROL)
    size = lambda x: f"length({x}) + length({x}) - length(replace({x}, '\\', '')) + len(regexp_extract_all({x}, '{special}'))"
    marks = len(chat.TURN) + len(chat.TEXT) + len(chat.END)
    return f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
c AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
  coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS learned, sum({marks} + {size("role")} + {size("text")}) AS body FROM t GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(learned) AS loss_chars, sha256(learned) AS loss_sha256,
  (body + {len(chat.OPEN) + len(chat.CLOSE)})::BIGINT AS formatted_chars FROM c"""


SQL["op4_chat"] = _op4_sql()


@query
def op5_simhash(spark: SparkSession, folder: str) -> DataFrame:
    """Near-duplicate components of ``documents``: three-word shingles, two bits."""
    return simhash.near_duplicates(table(spark, folder, "documents")).select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op6_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Benchmark windows of 13 words in every document."""
    found = winnow.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    ids = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    return found.select(
        F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), hexed(F.array_join(ids, ",")).alias("items_sha256"),
        winnow.contaminated(F.col("n_words"), F.col("n_hit")).alias("contaminated"))


_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
SQL["op6_decontamination"] = f"""
WITH dw AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
iw AS (SELECT item_id, {_WORDS} AS ws FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(ws), 13) AS n, array_to_string(ws[p : p + least(len(ws), 13) - 1], ' ') AS w
  FROM (SELECT item_id, ws, unnest(range(1, len(ws) - least(len(ws), 13) + 2)) AS p FROM iw WHERE len(ws) > 0)),
pos AS (SELECT doc_id, n, p, array_to_string(ws[p : p + n - 1], ' ') AS w
  FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS p FROM dw, (SELECT DISTINCT n FROM win) WHERE len(ws) >= n)),
hit AS (SELECT doc_id, item_id, p, n FROM pos JOIN win USING (n, w)),
places AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(p, p + n)) AS q FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM hit GROUP BY doc_id)
SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM dw LEFT JOIN places USING (doc_id) LEFT JOIN its USING (doc_id)"""


@query
def op7_packing(spark: SparkSession, folder: str) -> DataFrame:
    """``documents`` as byte tokens in sequences of the permitted lengths."""
    return packing.packed(table(spark, folder, "documents").select("doc_id", "text")).withColumnRenamed("id", "doc_id").drop("row")


@query
def op8_url_reputation(spark: SparkSession, folder: str) -> DataFrame:
    """Verdict on every url of ``pages``. The labelled outcome of a page is that of the label row with its number: good is quality 1 and not toxic."""
    labels = table(spark, folder, "labels")
    outcomes = labels.select(F.col("doc_id").alias("id"), F.when((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0), 1).when(F.col("quality").isNotNull(), 0).alias("good"))
    return reputation.judged(table(spark, folder, "pages"), outcomes).select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict")


def _shrunk_sql(name: str, level: str, parent: str, key: str, out: str) -> str:
    return f"""
{name}_rows AS (SELECT l.*, p.mean AS pm FROM {level} l JOIN {parent} p USING ({key})),
{name}_raw AS (SELECT {key}, sum(n * (good / n - pm) * (good / n - pm)) AS ss, sum(n) AS sn, sum(n) - sum(n * n) / sum(n) AS eff, count(*) AS k, first(pm) AS m
  FROM {name}_rows WHERE n > 0 GROUP BY {key}),
{name}_s AS (SELECT {key}, least(greatest(CASE WHEN k < 2 OR m * (1 - m) <= 0 OR eff <= 0 THEN {reputation.STRENGTH}
    WHEN (ss - (k - 1) * m * (1 - m)) / eff <= 0 THEN {reputation.STRONGEST}
    ELSE m * (1 - m) / ((ss - (k - 1) * m * (1 - m)) / eff) - 1 END, {reputation.WEAKEST}), {reputation.STRONGEST}) AS s FROM {name}_raw),
{name} AS (SELECT r.{out}, r.n, coalesce(s.s, {reputation.STRENGTH}) AS s, (r.good + coalesce(s.s, {reputation.STRENGTH}) * r.pm) / (r.n + coalesce(s.s, {reputation.STRENGTH})) AS mean
  FROM {name}_rows r LEFT JOIN {name}_s s USING ({key}))"""


def _op8_sql() -> str:
    rules = sorted(reputation.RULES, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    fits = lambda h, p: f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
    rule = "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{h}{p}'" for _, h, p in rules) + " END"
    action = "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{a}'" for a, h, p in rules) + " END"
    two = ", ".join(f"'{x}'" for x in reputation.TWO_LABEL)
    return f"""
WITH r AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
u AS (SELECT page_id, coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), '{_UPPER}', '{_LOWER}'), '') AS host,
  coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM r),
o AS (SELECT doc_id AS page_id, CASE WHEN quality = 1 AND coalesce(toxic, 0) = 0 THEN 1 ELSE 0 END AS good FROM labels WHERE quality IS NOT NULL),
c AS (SELECT host, count(good)::DOUBLE AS n, coalesce(sum(good), 0)::DOUBLE AS good FROM u LEFT JOIN o USING (page_id) GROUP BY host),
t AS (SELECT *, string_split(host, '.') AS ls FROM c),
t2 AS (SELECT *, CASE WHEN len(ls) > 1 THEN ls[-2] || '.' || ls[-1] ELSE host END AS two FROM t),
h AS (SELECT host, n, good, CASE WHEN two IN ({two}) THEN (CASE WHEN len(ls) <= 3 THEN host ELSE ls[-3] || '.' || two END) ELSE two END AS domain,
  CASE WHEN two IN ({two}) THEN two ELSE ls[-1] END AS suffix FROM t2),
d AS (SELECT domain, suffix, sum(n) AS n, sum(good) AS good FROM h GROUP BY domain, suffix),
x AS (SELECT suffix, 1 AS every, sum(n) AS n, sum(good) AS good FROM d GROUP BY suffix),
w AS (SELECT 1 AS every, (sum(good) + 1) / (sum(n) + 2) AS mean FROM x),
{_shrunk_sql("a", "x", "w", "every", "suffix")},
{_shrunk_sql("b", "d", "a", "suffix", "domain")},
{_shrunk_sql("e", "h", "b", "domain", "host")}
SELECT page_id, host, path, {rule} AS rule,
  coalesce({action}, CASE WHEN e.mean + {reputation.Z} * sqrt(e.mean * (1 - e.mean) / (e.n + e.s + 1)) < {reputation.MIN_GOOD} THEN 'block' ELSE 'allow' END) AS verdict
FROM u JOIN e USING (host)"""


SQL["op8_url_reputation"] = _op8_sql()


@query
def op9_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Groups of equal texts of ``documents``."""
    return cuckoo.deduplicated(table(spark, folder, "documents")).select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


SQL["op9_exact_dedup"] = f"""
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(n.t) AS text_sha256 FROM n JOIN g ON n.t = g.t"""


@query
def op10_main_text(spark: SparkSession, folder: str) -> DataFrame:
    """Main text of every page of ``pages``."""
    return extraction.extracted(table(spark, folder, "pages")).select(
        F.col("id").alias("page_id"), "url", "text", F.char_length("text").cast("long").alias("n_chars"))


@query
def op11_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    """The prefix trie of all ``conversations``, each rebuilt to begin like the first of its twenty."""
    return trie.nodes(*trie.rebuilt(table(spark, folder, "conversations")))


#: Byte-wise CRC-32 in SQL: the table of its 256 remainders, and the checksum of the bytes of a hexadecimal string.
_CRC = """
crc AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(range(0, 8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS v FROM range(0, 256) r(i)))"""


def _crc_of(hexed_text: str) -> str:
    return f"""xor(4294967295, list_reduce(list_transform(range(0, len({hexed_text}) // 2), lambda k: ('0x' || substr({hexed_text}, 2 * k + 1, 2))::BIGINT),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295))"""


def _op11_sql() -> str:
    count = "len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'))"
    return f"""
WITH {_CRC.strip()},
t AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS d
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT c, d, [role, text] AS k, {count} AS w FROM t),
ids AS (SELECT c, c - c % 20 AS base, {_crc_of("x")} % 4 AS h FROM (SELECT DISTINCT c, hex(encode(c::VARCHAR)) AS x FROM own), crc),
lent AS (SELECT i.c, o.d, k, w FROM ids i JOIN own o ON o.c = i.base AND o.d <= i.h),
re AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY part, d) AS d, k, w FROM (
  SELECT c, 0 AS part, d, k, w FROM lent UNION ALL SELECT o.c, 1, o.d, k, w FROM own o JOIN ids i ON o.c = i.c AND o.d > i.h)),
s AS (SELECT i.c, coalesce(list(k ORDER BY d) FILTER (d IS NOT NULL), []) AS ks, coalesce(list(w ORDER BY d) FILTER (d IS NOT NULL), []) AS ws FROM ids i LEFT JOIN re r ON r.c = i.c GROUP BY i.c),
p AS (SELECT c, len(ks) AS size, d, ks[1:d] AS k, CASE WHEN d = 0 THEN 0 ELSE ws[d] END AS w FROM (SELECT *, unnest(range(0, len(ks) + 1)) AS d FROM s)),
n AS (SELECT d, k, min(c) AS c, count(*) AS n, min(w) AS w, coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (size = d), '') AS ends FROM p GROUP BY d, k),
ch AS (SELECT d - 1 AS d, k[1:d-1] AS k, count(*) AS m FROM n WHERE d > 0 GROUP BY 1, 2),
e AS (SELECT n.*, coalesce(m, 0) AS m FROM n LEFT JOIN ch USING (d, k)),
up AS (SELECT unnest(range(0, d + 1)) AS ud, k, n, w, m FROM e),
sub AS (SELECT ud AS d, k[1:ud] AS k, sum((n - 1) * w) AS saved, sum(CASE WHEN m = 0 THEN 1 ELSE 0 END) AS leaves FROM up GROUP BY 1, 2)
SELECT e.c AS conv_id, e.d AS depth, q.c AS parent_conv_id, e.n AS n_convs, e.m AS n_children, leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, sha256(e.ends) AS ends_sha256
FROM e JOIN sub USING (d, k) LEFT JOIN n q ON q.d = e.d - 1 AND q.k = e.k[1:e.d-1]"""


SQL["op11_prefix_trie"] = _op11_sql()


@query
def op12_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    """What a mix of the sources of ``documents`` takes of every document."""
    return mixing.mixed(table(spark, folder, "documents")).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def _op12_sql() -> str:
    n = len(mixing.WEIGHTS)
    weight = "CASE (number - 1) % {} {} END".format(n, " ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(mixing.WEIGHTS)))
    return f"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS number FROM d GROUP BY source),
w AS (SELECT *, {weight} AS weight, source_size * {mixing.EPOCHS} AS cap FROM s),
o AS (SELECT *, sum(source_size) OVER () AS b, sum(weight) OVER () AS ws, sum(cap) OVER f - cap AS c_before, sum(weight) OVER f - weight AS w_before
  FROM w WINDOW f AS (ORDER BY cap / weight, number)),
f AS (SELECT *, (b - c_before) * weight > cap * (ws - w_before) AS is_full FROM o),
g AS (SELECT *, b - coalesce(sum(cap) FILTER (is_full) OVER (), 0) AS rest, ws - coalesce(sum(weight) FILTER (is_full) OVER (), 0) AS free FROM f),
t AS (SELECT source, number, source_size, b, count(*) OVER () AS n_sources, CASE WHEN is_full THEN cap::DOUBLE ELSE weight * rest::DOUBLE / greatest(free, 1)::DOUBLE END AS target FROM g),
q AS (SELECT doc_id, size, source_size, target, number, b, n_sources, floor(target)::BIGINT AS goal, sum(size) OVER h - size AS start, row_number() OVER h AS r
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
  WINDOW h AS (PARTITION BY number ORDER BY md5(coalesce(doc_id::VARCHAR, '')), doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING)),
c AS (SELECT *, e * source_size + start AS lo, e * source_size + start + size AS hi FROM q, range(0, {mixing.EPOCHS}) r(e) WHERE size > 0),
x AS (SELECT number, r, b, target, lo, least(hi, goal) AS hi FROM c WHERE lo < goal
  UNION ALL SELECT number, r, b, target, greatest(lo, goal), hi FROM c WHERE hi > goal AND lo < goal + n_sources),
y AS (SELECT number, r, b, hi - lo AS words, sum(hi - lo) OVER (ORDER BY hi / target, number, hi ROWS UNBOUNDED PRECEDING) AS upto FROM x),
z AS (SELECT number, r, sum(least(words, b - upto + words)) AS taken FROM y WHERE upto - words < b GROUP BY number, r)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken FROM q LEFT JOIN z USING (number, r)"""


SQL["op12_source_mix"] = _op12_sql()


@query
def op13_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    """Spelling variants among the words of whole ``documents``."""
    return variants.variants(table(spark, folder, "documents"))


def _op13_sql() -> str:
    v = variants
    return f"""
WITH RECURSIVE {_CRC.strip()},
runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[A-Za-zÀ-ÿ]+')) AS w FROM documents),
d AS (SELECT doc_id, w, count(*) AS n, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || w)) AS x FROM runs GROUP BY doc_id, w),
c AS (SELECT w, n, {_crc_of("x")} AS h FROM d, crc),
b AS (SELECT CASE WHEN h % {v.DAMAGE} = 0 THEN substr(w, 1, (h % length(w))::BIGINT) || substr(w, (h % length(w))::BIGINT + 2) ELSE w END AS w, n FROM c),
voc AS (SELECT w, sum(n)::BIGINT AS n FROM b WHERE length(w) >= {v.LEAST} GROUP BY w HAVING sum(n) >= {v.OCCURS}),
gap AS (SELECT w, n, i, substr(w, 1, i - 1) AS l, substr(w, i + 1) AS r FROM (SELECT w, n, unnest(range(1, length(w) + 1)) AS i FROM voc)),
pairs AS (SELECT a.w, a.n, z.w AS v, z.n AS m FROM gap a JOIN gap z ON a.i = z.i AND a.l = z.l AND a.r = z.r AND a.w <> z.w
  UNION SELECT g.w, g.n, voc.w, voc.n FROM gap g JOIN voc ON g.l || g.r = voc.w
  UNION SELECT voc.w, voc.n, g.w, g.n FROM gap g JOIN voc ON g.l || g.r = voc.w),
best AS (SELECT w, count(*) AS n_near, list({{'v': v, 'm': m}} ORDER BY m DESC, v)[1] AS f FROM pairs GROUP BY w),
forms AS (SELECT voc.w, voc.n, coalesce(n_near, 0) AS n_near, CASE WHEN f.m >= {v.RATIO} * n THEN f.v END AS form, CASE WHEN f.m >= {v.RATIO} * n THEN f.m END AS form_n FROM voc LEFT JOIN best USING (w)),
walk AS (SELECT w, w AS last, form AS next FROM forms UNION ALL SELECT walk.w, walk.next, forms.form FROM walk JOIN forms ON forms.w = walk.next)
SELECT w AS word, form, last AS root, n, n_near, form_n FROM forms JOIN (SELECT w, last FROM walk WHERE next IS NULL) USING (w)"""


SQL["op13_spelling_variants"] = _op13_sql()
