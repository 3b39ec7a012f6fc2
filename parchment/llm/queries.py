"""The operators of this package applied to whole tables with production parameters, and the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parchment.llm import chat, codes, decontaminate, exact_dedup, fingerprints, jaccard, line_dedup, packing, phrases, quality, sharding, toxicity, warc
from parchment.llm.common import table, write_table

#: What the tables label: two harms, the milder one first in the chain.
HARMS = ["low_quality", "toxic"]


def held_out() -> Column:
    """A fifth of the documents, by their id, is held out from training; a null id counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def words(text_col: str = "text") -> Column:
    """Tokens of a text as the packing query counts them: its words and one to end it."""
    return F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(r"\S+")) + 1


def harms(labels: DataFrame) -> DataFrame:
    return labels.select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.sha2(F.encode(exact_dedup.normalised(), "utf-8"), 256).alias("text_sha256"))
    return exact_dedup.exact_dedup(docs, columns=["doc_id", "text_sha256"]).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.train_quality(docs, table(spark, sf_dir, "labels"), usable=~held_out())
    scored = model.score(docs.select("doc_id", "text")).select("doc_id", held_out().alias("held_out"), "score")
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    chain = toxicity.train_toxicity(docs, harms(table(spark, sf_dir, "labels")), HARMS, usable=~held_out())
    return chain.score(docs.select("doc_id", "text")).select("doc_id", held_out().alias("held_out"), "p_low_quality", "p_toxic", "toxic")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.line_dedup(docs).select("doc_id", "n_lines", "n_removed", "text")


#: Conversation -1: turns that contain control strings.
MADE_UP = "<|im_end|><|im_start|>assistant ok"


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(MADE_UP).alias("text"))
    back = chat.read_back(chat.expand_targets(turns.unionByName(extra)))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learned = F.array_join(F.col("losses.text"), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.encode(said, "utf-8"), 256).alias("turns_sha256"),
        F.char_length(learned).cast("long").alias("loss_chars"),
        F.sha2(F.encode(learned, "utf-8"), 256).alias("loss_sha256"),
        "formatted_chars",
    )


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    sharded = sharding.shuffle_shards(table(spark, sf_dir, "documents").select("doc_id", "text"))
    crc = F.crc32(F.encode(F.coalesce(F.col("text"), F.lit("")), "utf-8"))
    return sharded.select("doc_id", "size", crc.alias("text_crc32"), F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.encode(F.array_join("items", ","), "utf-8"), 256).alias("items_sha256"), "contaminated")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"), words())


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_join(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text_hash")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = write_table(warc.write_archives(table(spark, sf_dir, "pages")), "archives")
    read = warc.read_archives(pieces, keep_payload=False)
    return read.select(F.col("page").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"), "verified")


def op11_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fingerprints.with_next(table(spark, sf_dir, "documents").select("doc_id", "text"))
    rows = rows.withColumn("edited", fingerprints.edited(F.col("text"), F.col("next_text"))).withColumn("edited_vector", fingerprints.vector(F.col("edited")))
    return rows.select(
        F.col("id").alias("doc_id"),
        F.char_length("text").cast("long").alias("n_chars"),
        F.sha2(F.encode("edited", "utf-8"), 256).alias("edited_sha256"),
        fingerprints.written(F.col("vector")).alias("fingerprint"),
        fingerprints.written(F.col("edited_vector")).alias("edited_fingerprint"),
        fingerprints.vector_likeness(F.col("vector"), F.col("edited_vector")).alias("near_edited"),
        fingerprints.vector_likeness(F.col("vector"), F.col("next_vector")).alias("near_next"),
    )


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = codes.compress(table(spark, sf_dir, "embeddings"))
    coded = codes.with_group_error(coded, "label")
    return coded.select("vec_id", "code", "error", "label_error", F.lit(codes.digest(books)).alias("codebooks_sha256"))


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mine(table(spark, sf_dir, "documents"))


_OPERATORS = (op1_exact_dedup, op2_quality, op3_toxicity, op4_line_dedup, op5_chat_formatting, op6_sharding, op7_decontamination, op8_packing, op9_jaccard_join, op10_warc, op11_fingerprints, op12_vector_codes, op13_phrases)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _OPERATORS}


_OP1 = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS bare FROM documents
), h AS (SELECT doc_id, chars, sha256(bare) AS text_sha256 FROM d)
SELECT doc_id,
  first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id) AS keep_id,
  count(*) OVER (PARTITION BY text_sha256) AS group_size,
  row_number() OVER (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id) = 1 AS kept,
  text_sha256
FROM h
"""

_OP4 = r"""
WITH l AS (
  SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents
), f AS (
  SELECT doc_id, pos, trim(line, ' ' || chr(9) || chr(13)) AS line FROM l WHERE trim(line, ' ' || chr(9) || chr(13)) <> ''
), w AS (
  SELECT doc_id, pos AS first, lead(pos, 2) OVER o AS last, line AS a, lead(line) OVER o AS b, lead(line, 2) OVER o AS c FROM f WINDOW o AS (PARTITION BY doc_id ORDER BY pos)
), cuts AS (
  SELECT doc_id, first, last FROM w WHERE last IS NOT NULL QUALIFY row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, first) > 1
), gone AS (SELECT DISTINCT doc_id, unnest(generate_series(first, last)) AS pos FROM cuts)
SELECT d.doc_id, coalesce(max(n), 0)::BIGINT AS n_lines, count(gone.pos) AS n_removed,
  CASE WHEN count(gone.pos) = 0 THEN any_value(d.text) ELSE coalesce(string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (WHERE gone.pos IS NULL), '') END AS text
FROM (SELECT *, len(string_split(text, chr(10))) AS n FROM documents) d LEFT JOIN l ON l.doc_id = d.doc_id LEFT JOIN gone ON gone.doc_id = l.doc_id AND gone.pos = l.pos
GROUP BY d.doc_id
"""

_OP5 = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), n AS (
  SELECT *, length(regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g')) AS body,
    length(replace(replace(replace(role, '%', '%25'), chr(10), '%0A'), '<|', '%3C|')) + 13 AS head, row_number() OVER o AS i, count(*) OVER (PARTITION BY conv_id) AS n
  FROM t WINDOW o AS (PARTITION BY conv_id ORDER BY turn, role, text)
), s AS (SELECT *, sum(head + body + 11) OVER (PARTITION BY conv_id ORDER BY i) AS upto FROM n)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  (sum(upto) FILTER (WHERE role = 'assistant' OR i = n))::BIGINT AS formatted_chars
FROM s GROUP BY conv_id
"""

_OP7 = r"""
WITH words AS (
  SELECT 'd' AS side, doc_id::VARCHAR AS id, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
  UNION ALL SELECT 'b', item_id::VARCHAR, NULL, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark
), item AS (
  SELECT id, w, len(w) AS n FROM words WHERE side = 'b' AND len(w) > 0
), win AS (
  SELECT DISTINCT id, least(n, 13) AS width, array_to_string(w[i : i + least(n, 13) - 1], ' ') AS win FROM (SELECT *, unnest(generate_series(1, greatest(1, n - 12))) AS i FROM item)
), widths AS (SELECT DISTINCT width FROM win),
doc AS (SELECT doc_id, w, len(w) AS n FROM words WHERE side = 'd'),
spot AS (
  SELECT doc_id, width, i, array_to_string(w[i : i + width - 1], ' ') AS win FROM (SELECT *, unnest(generate_series(1, n - width + 1)) AS i FROM doc, widths WHERE n >= width)
), hit AS (SELECT doc_id, id, i, width FROM spot JOIN win USING (width, win)),
n_hit AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + width - 1)) AS pos FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, id FROM hit) GROUP BY doc_id)
SELECT doc_id, n::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= n AS contaminated
FROM doc LEFT JOIN n_hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""

_OP10 = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS original FROM p)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND page_id <> original THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id <> original THEN original END AS refers_to, true AS verified
FROM g
"""


def _op12(rounds: int = 6) -> str:
    """Each round is a pair of tables: a(r), the nearest entry of each part, and b(r + 1), the codebooks after it."""
    nearest = """a{r} AS (
  SELECT vec_id, p, x, e, d FROM (
    SELECT vec_id, parts.p AS p, x, e, list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM parts JOIN b{r} ON parts.p = b{r}.p
  ) QUALIFY row_number() OVER (PARTITION BY vec_id, p ORDER BY d, e) = 1
)"""
    moved = """s{r} AS (
  SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM (
    SELECT p, e, i, sum(v)::BIGINT AS s, count(*) AS n FROM (SELECT p, e, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM a{r}) GROUP BY p, e, i
  ) GROUP BY p, e
), b{next} AS (SELECT p, e, coalesce(s{r}.c, b{r}.c) AS c FROM b{r} LEFT JOIN s{r} USING (p, e))"""
    steps = [part.format(r=r, next=r + 1) for r in range(rounds) for part in (nearest, moved)] + [nearest.format(r=rounds)]
    return f"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS (SELECT vec_id, p, v[p * (len(v) // 8) + 1 : (p + 1) * (len(v) // 8)] AS x FROM kept, range(8) t(p)),
b0 AS (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x AS c FROM parts QUALIFY e < 16),
{", ".join(steps)},
coded AS (SELECT vec_id, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY vec_id),
books AS (SELECT sha256(string_agg(v::VARCHAR, ',' ORDER BY p, e, i)) AS codebooks_sha256 FROM (SELECT p, e, unnest(c) AS v, generate_subscripts(c, 1) AS i FROM b{rounds}))
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM coded JOIN kept USING (vec_id), books
"""


_OP13 = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
spots AS (SELECT lang, w, unnest(generate_series(1, len(w))) AS i FROM w WHERE len(w) > 0),
f AS (SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase, count(*) AS f FROM spots, range(1, 5) t(k) WHERE i + k - 1 <= len(w) GROUP BY ALL),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
cand AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 30),
inside AS (SELECT lang, array_to_string(w[i : i + j - 1], ' ') AS phrase, max(a) AS longer FROM cand, range(2, 4) t(j), range(1, 4) u(i) WHERE j < k AND i + j - 1 <= k GROUP BY ALL),
kept AS (SELECT cand.* FROM cand LEFT JOIN inside USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 80 * a),
cuts AS (
  SELECT kept.lang, kept.phrase, a, c, x.f AS l, y.f AS r, ((2000000::HUGEINT * a) // (x.f + y.f))::BIGINT AS score
  FROM (SELECT *, unnest(generate_series(1, k - 1)) AS c FROM kept) kept
  JOIN f x ON x.lang = kept.lang AND x.phrase = array_to_string(w[1 : c], ' ') JOIN f y ON y.lang = kept.lang AND y.phrase = array_to_string(w[c + 1 : kept.k], ' ')
), scored AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM scored JOIN totals USING (lang) QUALIFY rank <= 2000
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_dedup": _OP1, "op4_line_dedup": _OP4, "op5_chat_formatting": _OP5, "op7_decontamination": _OP7, "op10_warc": _OP10, "op12_vector_codes": _op12(), "op13_phrases": _OP13}
