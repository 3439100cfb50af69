"""One registered query per operator, over its whole table, with SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabml.llm import chat, conversation_repair, licenses, mixing, packing, quality_rules, rule_ensemble, simhash, token_files, topk, url_filter, warc, whitening
from tabml.llm.common import table
from tabml.llm.repair_sql import REPAIR
from tabml.llm.text_stats import stop_words


def tokenizer_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def op1_warc(spark: SparkSession, folder: str) -> DataFrame:
    manifest, place = warc.archive(table(spark, folder, "pages"))
    return warc.read(manifest, place, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents")).select(F.col("id").alias("doc_id"), "source", "size", "source_size", "target", "taken")


def op3_top_k(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    return topk.exact_top_k(vectors, vectors.where("vec_id % 20 = 0")).withColumnRenamed("id", "vec_id")


def op4_packing(spark: SparkSession, folder: str) -> DataFrame:
    pieces = packing.pack(table(spark, folder, "documents"), tokenizer_path())
    return pieces.select(F.col("id").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op5_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, folder, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"),
                        F.col("component").alias("component_id"))


def op6_chat(spark: SparkSession, folder: str) -> DataFrame:
    told = r"\### Assistant: </turn> ok"
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", told), (-7, 1, "assistant", told)], rows.schema)
    records = chat.records(rows.union(extra))
    done = chat.format_chats(records, records.columns[1:])
    back = done.select("id", "formatted", "loss_spans", chat.read_turns(F.col("formatted")).alias("turns"),
                       chat.masked_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        F.col("id").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"))


def op7_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules.assess(table(spark, folder, "documents")).drop("failed_rules").withColumnRenamed("id", "doc_id")


def op8_licenses(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan(table(spark, folder, "documents")).withColumnRenamed("id", "doc_id")


URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op9_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.judge(table(spark, folder, "pages").select("page_id", "url"), rules).drop("url")


def held_out(id) -> F.Column:
    return F.crc32(id.cast("string").cast("binary")) % 5 == 0


def quality_model(spark: SparkSession, folder: str) -> rule_ensemble.RuleEnsemble:
    """Fitted on labelled documents outside the held-out fold."""
    labels = table(spark, folder, "labels").where(~held_out(F.col("doc_id")))
    return rule_ensemble.fit(table(spark, folder, "documents"), labels)


THRESHOLD = 0.3


def op10_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    scored = rule_ensemble.score(quality_model(spark, folder), table(spark, folder, "documents"))
    return scored.select(F.col("id").alias("doc_id"), F.coalesce(held_out(F.col("id")), F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op11_whitening(spark: SparkSession, folder: str) -> DataFrame:
    found = whitening.whiten(table(spark, folder, "embeddings"))
    return found.withColumnRenamed("id", "vec_id").withColumn("deviation", F.col("deviation").try_cast("long"))


def damaged(rows: DataFrame) -> DataFrame:
    """Conversation rows with faults by their crc: one in twenty is dropped, one emptied, one loses its end
    marks, one is repeated, one becomes a user's."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = rows.select("conv_id", "turn", part("role").alias("role"), part("text").alias("text"),
                       (F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % 20).alias("fault")).where("fault <> 0")
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.explode(F.array_repeat(F.lit(0), F.when(F.col("fault") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), times).drop("col")


def op12_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    reports, turns = conversation_repair.repair(damaged(rows))
    told = reports.join(conversation_repair.digests(turns), ["none", "key"], "left").withColumnRenamed("conv", "id")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return rows.select("conv_id").distinct().join(told, F.col("conv_id").eqNullSafe(F.col("id")), "left").select(
        "conv_id", *map(zero, ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def op13_token_files(spark: SparkSession, folder: str) -> DataFrame:
    files = token_files.store(table(spark, folder, "documents"), tokenizer_path())
    return token_files.read(files, payload=False).drop("ids").withColumnRenamed("id", "doc_id")


QUERIES = {f.__name__: f for f in (op1_warc, op2_mixing, op3_top_k, op4_packing, op5_simhash, op6_chat, op7_quality_rules, op8_licenses,
                                   op9_url_filter, op10_quality_classifier, op11_whitening, op12_conversation_repair, op13_token_files)}

SIZES = r"""
    SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
           ('0x' || substr(md5('mix|' || coalesce(doc_id::VARCHAR, '') || '|' || md5(coalesce(text, ''))), 1, 13))::BIGINT AS key
    FROM documents"""

#: a word's place counts once however many repeated windows hold it
STATS = rf"""
docs AS (SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS text FROM documents),
words AS (SELECT n, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
          [l for l in string_split(text, chr(10)) if regexp_matches(l, '[^\x20\x09-\x0D]')] AS lines FROM docs),
windows AS (SELECT n, i, list_aggregate(w[i:i + 4], 'string_agg', chr(0)) AS g FROM (SELECT n, w, unnest(range(1, len(w) - 3)) AS i FROM words)),
repeated AS (SELECT n, i FROM (SELECT n, i, count(*) OVER (PARTITION BY n, g) AS c FROM windows) WHERE c > 1),
covered AS (SELECT n, count(DISTINCT i + k) AS n_repeat_words FROM repeated, range(0, 5) AS t(k) GROUP BY n),
stats AS (
    SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
           (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
           (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, len(lines) AS n_lines,
           len([x for x in w if list_contains([{', '.join(f"'{x}'" for x in stop_words())}], lower(x))]) AS n_stop_words
    FROM words LEFT JOIN covered USING (n))"""


def _passes(rule: quality_rules.Rule) -> str:
    value = f"CASE WHEN {rule.denominator} > 0 THEN {rule.numerator}::DOUBLE / {rule.denominator} ELSE 0 END"
    tests = [f"{value} >= {rule.least}"] * (rule.least > float("-inf")) + [f"{value} <= {rule.most}"] * (rule.most < float("inf"))
    return f"(n_words < {rule.from_words} OR ({' AND '.join(tests)}))"


SQL = {
    "op12_conversation_repair": REPAIR,
    "op1_warc": """
WITH own AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
hashed AS (SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes, sha1(payload) AS hex FROM own),
told AS (SELECT page_id, payload_bytes, hex, min(page_id) OVER (PARTITION BY hex) AS origin FROM hashed)
SELECT page_id, payload_bytes,
       array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(hex, 5 * (i // 4) + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INT + 1, 1)
                        for i in range(0, 32)], '') AS payload_digest,
       CASE WHEN page_id = origin THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> origin THEN origin END AS refers_to
FROM told""",
    "op7_quality_rules": f"""
WITH {STATS},
based AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM stats)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND {' AND '.join(_passes(r) for r in quality_rules.RULES)} AS kept
FROM based""",
    "op2_mixing": rf"""
WITH rows AS ({SIZES}),
sources AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source IS NULL, source) AS place FROM rows GROUP BY source),
weighed AS (SELECT *, ((place - 1) % 3 + 1)::DOUBLE AS weight, 3 * source_size::DOUBLE AS most FROM sources),
running AS (
    SELECT *, row_number() OVER o AS turn,
           (SELECT sum(source_size) FROM sources)::DOUBLE - coalesce(sum(most) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS remaining,
           (SELECT sum(weight) FROM weighed) - coalesce(sum(weight) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS weights
    FROM weighed WINDOW o AS (ORDER BY most / weight, place)),
opened AS (SELECT * FROM running WHERE most * weights > weight * remaining ORDER BY turn LIMIT 1),
targets AS (
    SELECT r.source, r.source_size,
           CASE WHEN r.turn >= o.turn THEN r.weight * o.remaining / o.weights ELSE r.most END AS target
    FROM running r LEFT JOIN opened o ON true),
budgets AS (
    SELECT *, CASE WHEN source_size > 0 THEN round(target)::BIGINT // source_size ELSE 0 END AS epochs FROM targets),
ordered AS (
    SELECT r.*, b.source_size, b.target, b.epochs, round(b.target)::BIGINT - b.epochs * b.source_size AS budget,
           sum(r.size) OVER (PARTITION BY r.source ORDER BY r.key) - r.size AS before
    FROM rows r JOIN budgets b ON r.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, source, size, source_size, target,
       (epochs * size + greatest(0, least(size, budget - before)))::BIGINT AS taken
FROM ordered""",
    "op3_top_k": """
WITH whole AS (
    SELECT vec_id, [floor(64 * x::DOUBLE) for x in embedding] AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
scored AS (
    SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
    FROM whole q JOIN whole c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20""",
    "op6_chat": r"""
WITH rows AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
shown AS (
    SELECT *, CASE role WHEN 'system' THEN 'System' WHEN 'user' THEN 'User' WHEN 'assistant' THEN 'Assistant'
                   ELSE '@' || regexp_replace(regexp_replace(regexp_replace(role, '<(\\*)/turn>', '<\\\1/turn>', 'g'), '##(\\*)# ', '##\\\1# ', 'g'), ':(\\*) ', ':\\\1 ', 'g') END AS label,
           regexp_replace(regexp_replace(text, '<(\\*)/turn>', '<\\\1/turn>', 'g'), '##(\\*)# ', '##\\\1# ', 'g') AS inside
    FROM rows)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length('### ' || label || ': ' || inside || '</turn>' || chr(10)))::BIGINT AS formatted_chars
FROM shown GROUP BY conv_id""",
    "op9_url_filter": r"""
WITH rules(host, path, verdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
cut AS (
    SELECT page_id, coalesce(CASE WHEN contains(url, '://') THEN split_part(url, '://', 1) || '://' END, '') AS scheme, url FROM pages),
parts AS (
    SELECT page_id, CASE WHEN scheme = '' THEN '' ELSE regexp_extract(substr(url, length(scheme) + 1), '^[^/?#]*') END AS raw_host,
           CASE WHEN scheme = '' THEN '' ELSE substr(url, length(scheme) + 1) END AS rest FROM cut),
own AS (
    SELECT row_number() OVER () AS n, page_id, translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           regexp_extract(substr(rest, length(raw_host) + 1), '^[^?#]*') AS path FROM parts),
fits AS (
    SELECT o.n, r.host || r.path AS rule, r.verdict, row_number() OVER (PARTITION BY o.n ORDER BY length(r.host || r.path) DESC, length(r.host) DESC) AS place
    FROM own o JOIN rules r ON (o.host = r.host OR ends_with(o.host, '.' || r.host)) AND starts_with(o.path, r.path))
SELECT o.page_id, o.host, o.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
FROM own o LEFT JOIN fits f ON f.n = o.n AND f.place = 1""",
}
