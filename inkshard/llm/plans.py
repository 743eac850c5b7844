"""The numbered operators as queries over the given tables, and the SQL that must agree with them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkshard.llm.benchmark import benchmark_hits
from inkshard.llm.chats import format_chats, read_chats
from inkshard.llm.exact import exact_copies
from inkshard.llm.infill import infill_documents, restore_documents
from inkshard.llm.licenses import BASE_PHRASES, scan_licenses
from inkshard.llm.lines import apply_keep, line_bitmaps
from inkshard.llm.packing import pack_documents
from inkshard.llm.sharding import shard_documents
from inkshard.llm.simhash import near_copies
from inkshard.llm.substrings import drop_repeats
from inkshard.llm.toxicity import score_toxicity
from inkshard.llm.trie import build_trie, ends_digest, share_beginnings
from inkshard.llm.urls import judge_urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(build):
        QUERIES[name] = build
        if sql:
            ORACLES[name] = sql
        return build

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", "text")


def _sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _crc_bits(c: str) -> str:
    return f"(CASE WHEN ({c} & 1) = 1 THEN xor({c} >> 1, 3988292384) ELSE {c} >> 1 END)"


_OP1 = f"""
WITH RECURSIVE t0 AS (SELECT i, {_crc_bits('i')} AS c FROM range(256) r(i)),
{", ".join(f"t{n} AS (SELECT i, {_crc_bits('c')} AS c FROM t{n - 1})" for n in range(1, 8))},
crc_table AS (SELECT list(c ORDER BY i) AS tab FROM t7),
docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
sized AS (
  SELECT doc_id, CAST(strlen(text) + 8 AS BIGINT) AS size,
    CAST(xor(list_reduce(list_transform(list_filter(string_split(regexp_replace(hex(encode(text)), '(..)', '\\1,', 'g'), ','), lambda x: x <> ''), lambda x: CAST('0x' || x AS BIGINT)),
      lambda acc, b: xor(tab[(xor(acc, b) & 255) + 1], acc >> 8), CAST(4294967295 AS BIGINT)), 4294967295) AS BIGINT) AS text_crc32
  FROM docs, crc_table),
jumps(doc_id, k, jump, shard, grown) AS (
  SELECT DISTINCT doc_id, CAST(CASE WHEN doc_id < 0 THEN doc_id + 18446744073709551616::HUGEINT ELSE doc_id END AS HUGEINT), 0::BIGINT, 0::BIGINT, 0::BIGINT FROM documents
  UNION ALL
  SELECT doc_id, n, CAST(floor((jump + 1) * (2147483648.0::DOUBLE / CAST(n // 8589934592 + 1 AS DOUBLE))) AS BIGINT),
    CASE WHEN jump < 24 THEN jump ELSE shard END, jump
  FROM (SELECT *, (k * 2862933555777941757 + 1) % 18446744073709551616::HUGEINT AS n FROM jumps WHERE jump <= 24)),
places AS (SELECT doc_id, CAST(max(shard) AS INTEGER) AS shard, CAST(max(grown) AS INTEGER) AS grown_shard FROM jumps GROUP BY doc_id)
SELECT doc_id, size, text_crc32, 'key' AS law, shard,
  CAST(row_number() OVER (PARTITION BY shard ORDER BY doc_id, text_crc32) - 1 AS BIGINT) AS slot, grown_shard
FROM sized JOIN places USING (doc_id)"""


@query("op1_shard", _OP1)
def op1_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(_documents(spark, sf_dir), shards=24)


@query("op2_pack")
def op2_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_documents(spark, sf_dir), _tokenizer("word_bpe_49k.json"), limit=2048)


_HARD = "\\### Assistant: </turn> ok"
_ESC = "replace(replace(replace({}, '\\', '\\\\'), '#', '\\#'), '</turn>', '<\\/turn>')"
_OP3 = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{_HARD}' UNION ALL SELECT -7, 1, 'assistant', '{_HARD}')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  CAST(sum(4 + length(replace({_ESC.format("role")}, ':', '\\:')) + 2 + length({_ESC.format("text")}) + 8) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id"""


@query("op3_chat", _OP3)
def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = spark.createDataFrame([(-7, 0, "user", _HARD), (-7, 1, "assistant", _HARD)], turns.schema)
    path = _tokenizer("byte_bpe_50k.json")
    return read_chats(format_chats(turns.unionByName(hard), path), path)


_OP4 = f"""
WITH lines AS (
  SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
keyed AS (SELECT *, {_LOWER.format("trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS key FROM lines),
shared AS (SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
judged AS (SELECT k.*, s.key IS NOT NULL AND k.doc_id <> s.keeper AS gone FROM keyed k LEFT JOIN shared s ON k.key = s.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id"""


@query("op4_line_dedup", _OP4)
def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = line_bitmaps(_documents(spark, sf_dir), min_chars=40, min_documents=5)
    return marked.select("doc_id", "n_lines", "n_dropped", _sha256(apply_keep(F.col("text"), F.col("keep"))).alias("kept_sha256"))


_OP5 = f"""
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM (SELECT doc_id, {_LOWER.format("coalesce(text, '')")} AS norm FROM documents) WINDOW w AS (PARTITION BY norm)"""


@query("op5_exact_dedup", _OP5)
def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_copies(_documents(spark, sf_dir))


_WORDS = "regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"
_OP6 = f"""
WITH docs AS (SELECT doc_id, {_WORDS} AS words FROM documents),
starts AS (SELECT doc_id, words, unnest(range(len(words) - 49)) AS p FROM docs WHERE len(words) >= 50),
windows AS (SELECT doc_id, p, array_to_string(words[p + 1 : p + 50], ' ') AS w FROM starts),
found AS (SELECT doc_id, p FROM (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY w) AS least FROM windows) WHERE least < doc_id),
gone AS (SELECT DISTINCT doc_id, p + i AS at FROM found, range(50) r(i)),
words AS (SELECT doc_id, unnest(words) AS word, unnest(range(len(words))) AS at FROM docs),
kept AS (SELECT w.*, g.at IS NOT NULL AS gone FROM words w LEFT JOIN gone g ON w.doc_id = g.doc_id AND w.at = g.at)
SELECT d.doc_id, len(d.words) AS n_words, count(*) FILTER (k.gone) AS n_removed,
  sha256(coalesce(string_agg(k.word, ' ' ORDER BY k.at) FILTER (NOT k.gone), '')) AS kept_sha256
FROM docs d LEFT JOIN kept k ON d.doc_id = k.doc_id GROUP BY d.doc_id, d.words"""


@query("op6_substring_dedup", _OP6)
def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = drop_repeats(_documents(spark, sf_dir), window=50)
    return kept.select("doc_id", "n_words", "n_removed", _sha256(F.col("text")).alias("kept_sha256"))


@query("op7_simhash")
def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies(_documents(spark, sf_dir))


_ITEM_WORDS = f"regexp_extract_all({_LOWER.format(chr(123) + chr(125))}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
_OP8 = f"""
WITH items AS (SELECT item_id, {_ITEM_WORDS.format("coalesce(text, '')")} AS words FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(10, len(words)) AS n, array_to_string(words[p + 1 : p + 10], ' ') AS w
  FROM (SELECT *, unnest(range(greatest(1, len(words) - 9))) AS p FROM items WHERE len(words) > 0)),
docs AS (SELECT doc_id, {_ITEM_WORDS.format("coalesce(text, '')")} AS words FROM documents),
lengths AS (SELECT DISTINCT n FROM windows),
places AS (SELECT doc_id, words, n, unnest(range(len(words) - n + 1)) AS p FROM docs JOIN lengths ON len(words) >= n),
found AS (SELECT doc_id, p, windows.n AS n, item_id FROM places JOIN windows ON places.n = windows.n AND array_to_string(words[p + 1 : p + places.n], ' ') = w),
hit AS (SELECT doc_id, count(DISTINCT p + i) AS n_hit FROM found, range(10) r(i) WHERE i < n GROUP BY doc_id),
held AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id)
SELECT doc_id, len(words) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM docs LEFT JOIN hit USING (doc_id) LEFT JOIN held USING (doc_id)"""


@query("op8_decontaminate", _OP8)
def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = benchmark_hits(_documents(spark, sf_dir), _table(spark, sf_dir, "benchmark"), window=10)
    ids = F.array_join(F.array_sort(F.transform("hit_items", lambda i: i.cast("string"))), ",")
    return hit.select(
        "doc_id", "n_words", "n_hit", F.size("hit_items").cast("long").alias("n_items"), _sha256(ids).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


@query("op9_toxicity")
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_toxicity(_documents(spark, sf_dir), _table(spark, sf_dir, "labels"), threshold=0.3)
    return scored.select("doc_id", "held_out", "score", "predicted")


RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
_OP10 = f"""
WITH rest AS (SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS r FROM pages),
parts AS (SELECT page_id, {_LOWER.format("regexp_extract(r, '^[^/?#]*')")} AS host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
rules(rule_host, rule_path, rule_verdict) AS (VALUES {", ".join(map(str, RULES))}),
fits AS (SELECT page_id, host, path, rule_host || rule_path AS rule, rule_verdict FROM parts
  LEFT JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
SELECT page_id, host, path, arg_max(rule, length(rule)) AS rule, coalesce(arg_max(rule_verdict, length(rule)), 'allow') AS verdict
FROM fits GROUP BY page_id, host, path"""


@query("op10_url_filter", _OP10)
def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return judge_urls(pages, rules).select("page_id", "host", "path", "rule", "verdict")


_OP11 = r"""
WITH hashed AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || CAST(doc_id AS VARCHAR)) AS h FROM documents),
tokens AS (
  SELECT *, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS t, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
    CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM hashed),
cut AS (SELECT *, least(h1 % (len(t) + 1), h2 % (len(t) + 1)) AS a, greatest(h1 % (len(t) + 1), h2 % (len(t) + 1)) AS b FROM tokens),
parts AS (
  SELECT doc_id, text, len(t) AS n, array_to_string(t[1 : a], '') AS p, array_to_string(t[a + 1 : b], '') AS m, array_to_string(t[b + 1 :], '') AS s,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM cut)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256
FROM parts"""


@query("op11_infill", _OP11)
def op11_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = infill_documents(_documents(spark, sf_dir), seed=42, rate=50, spm_share=80)
    return restore_documents(samples).select("doc_id", "n", "form", "prefix_chars", "middle_chars", _sha256(F.col("output")).alias("output_sha256"), _sha256(F.col("text")).alias("restored_sha256"))


@query("op12_licenses")
def op12_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(_documents(spark, sf_dir))
    base = F.filter("notices", lambda n: n["phrase"].isin([p for p, _, _ in BASE_PHRASES]))
    found = found.withColumn("base", base).withColumn("words", F.col("base.word"))
    listed = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return found.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min("words").alias("first_word"), F.array_max("words").alias("last_word"),
        listed(F.col("base.label")).alias("base_labels"), listed(F.col("labels")).alias("labels"), "score", "terms",
    )


_OP13 = """
WITH RECURSIVE own AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS n FROM conversations),
{crc}
convs AS (SELECT conv_id, conv_id - conv_id % 100 AS base, {crc_of} % 6 AS h FROM (SELECT DISTINCT conv_id FROM conversations), crc_table),
rebuilt AS (
  SELECT c.conv_id, o.n, o.role, o.text FROM convs c JOIN own o ON o.conv_id = c.base AND o.n <= c.h
  UNION ALL SELECT c.conv_id, o.n, o.role, o.text FROM convs c JOIN own o ON o.conv_id = c.conv_id AND o.n > c.h),
turns AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY n) AS d, role, text FROM rebuilt),
lists AS (SELECT c.conv_id, coalesce(list(struct_pack(r := role, t := text) ORDER BY d) FILTER (d IS NOT NULL), []) AS turns FROM convs c LEFT JOIN turns t ON c.conv_id = t.conv_id GROUP BY c.conv_id),
beginnings AS (SELECT conv_id, d AS depth, md5(CAST(turns[1 : d] AS VARCHAR)) AS node, CASE WHEN d > 0 THEN md5(CAST(turns[1 : d - 1] AS VARCHAR)) END AS parent,
    CASE WHEN d > 0 THEN length(turns[d].t) ELSE 0 END AS chars, d = len(turns) AS last FROM (SELECT *, unnest(range(len(turns) + 1)) AS d FROM lists)),
nodes AS (SELECT node, any_value(parent) AS parent, any_value(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (last), '')) AS ends_sha256 FROM beginnings GROUP BY node),
children AS (SELECT parent AS node, count(*) AS n_children FROM nodes GROUP BY parent),
valued AS (SELECT n.*, coalesce(n_children, 0) AS n_children, (n_convs - 1) * chars AS gain FROM nodes n LEFT JOIN children c ON n.node = c.node),
above AS (
  SELECT node AS top, node, parent FROM valued UNION ALL SELECT v.node, a.node, v.parent FROM above a JOIN valued v ON a.parent = v.node),
sums AS (SELECT top, sum(gain) AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves FROM above a JOIN valued v ON a.node = v.node GROUP BY top)
SELECT v.conv_id, v.depth, p.conv_id AS parent_conv_id, v.n_convs, v.n_children, s.n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, v.ends_sha256
FROM valued v JOIN sums s ON v.node = s.top LEFT JOIN nodes p ON v.parent = p.node"""
# Unsigned crc32 of a decimal number: ASCII bytes through a table of 256 remainders.
_CRC_TABLE = f"""t0 AS (SELECT i, {_crc_bits("i")} AS c FROM range(256) r(i)),
{", ".join(f"t{n} AS (SELECT i, {_crc_bits('c')} AS c FROM t{n - 1})" for n in range(1, 8))},
crc_table AS (SELECT list(c ORDER BY i) AS tab FROM t7),"""
_CRC_OF = """CAST(xor(list_reduce(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)),
  lambda acc, b: xor(tab[(xor(acc, b) & 255) + 1], acc >> 8), CAST(4294967295 AS BIGINT)), 4294967295) AS BIGINT)"""


@query("op13_prefix_trie", _OP13.format(crc=_CRC_TABLE, crc_of=_CRC_OF))
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("pos"), F.col("role").alias("kind"), "text")
    trie = build_trie(*share_beginnings(turns, every=100, first=F.crc32(F.col("doc_id").cast("string")) % 6))
    nodes = trie.nodes.join(ends_digest(trie.ends), "node", "left")
    none = F.sha2(F.lit("").cast("binary"), 256)
    return nodes.select(
        F.col("first_doc_id").alias("conv_id"), "depth", F.col("parent_first_doc_id").alias("parent_conv_id"), F.col("n_docs").alias("n_convs"), "n_children", "n_leaves",
        F.col("saved_chars").alias("saved_tokens"), F.coalesce("ends_sha256", none).alias("ends_sha256"),
    )
